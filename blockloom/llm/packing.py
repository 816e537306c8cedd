"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. Pieces are placed longest first: into the open bin they fill best, else into a
new bin whose length costs least per token that the pieces still waiting can put into it. At the end each bin is
cut down to the shortest permitted length that holds its contents. A text longer than the longest length is
split into pieces; its last piece is packed like any other.

Rows: a null doc_id is packed like any other. Null, empty and blank texts have no tokens: one row with n_tokens 0 and no bin. Repeated rows are packed
once each; ties go to the smaller doc_id. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Scratch
from .mixing import n_tokens

LENGTHS = (512, 1024, 2048, 4096)
#: Tokens that opening a bin costs beside its length.
BIN_COST = 16
#: Pieces packed together: bounds a task's memory, and loses at most a few part-filled bins a shard.
SHARD_PIECES = 20_000


def pack(lengths: Sequence[int], permitted: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each piece, final length of each bin)."""
    permitted = sorted(permitted)
    longest = permitted[-1]
    waiting = [0] * (longest + 1)
    for n in lengths:
        waiting[n] += 1
    mask = 0
    for n in range(1, longest + 1):
        if waiting[n]:
            mask |= 1 << n
    place: list[tuple[int, int]] = [(-1, -1)] * len(lengths)
    filled: list[int] = []
    size: list[int] = []
    open_: dict[int, list[int]] = defaultdict(list)
    rooms = 0

    def fill(room: int) -> int:
        """Tokens that waiting pieces can put into the room, longest first."""
        got, used = 0, {}
        while room > 0:
            low = mask & ((1 << (room + 1)) - 1)
            n = low.bit_length() - 1
            while n > 0 and waiting[n] <= used.get(n, 0):
                low &= (1 << n) - 1
                n = low.bit_length() - 1
            if n <= 0:
                break
            k = min(room // n, waiting[n] - used.get(n, 0))
            used[n] = used.get(n, 0) + k
            got += k * n
            room -= k * n
        return got

    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        waiting[n] -= 1
        if not waiting[n]:
            mask &= ~(1 << n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            best = min((c for c in permitted if c >= n), key=lambda c: ((c + bin_cost) / (n + fill(c - n)), -c))
            b, room = len(size), best
            size.append(best)
            filled.append(0)
        place[i] = (b, filled[b])
        filled[b] += n
        if room - n:
            open_[room - n].append(b)
            rooms |= 1 << (room - n)
    return place, [next(c for c in permitted if c >= f) for f in filled]


def pack_documents(docs: DataFrame, permitted: Sequence[int] = LENGTHS, bin_cost: int = BIN_COST, seed: int = 5) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_length, bin_offset of each piece."""
    scratch = Scratch(docs.sparkSession)
    longest = max(permitted)
    # a null id travels as the smallest number with a mark, as pandas knows no null among whole numbers
    counted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), n_tokens(F.col("text")).alias("tokens"))
    pieces = counted.select("doc_id", "no_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / longest).cast("int") - 1))).alias("piece"))
    pieces = scratch.keep(pieces.select("doc_id", "no_id", "piece", F.least(F.lit(longest), F.col("tokens") - F.col("piece").cast("long") * longest).cast("int").alias("n_tokens")))
    shards = 1 + pieces.count() // SHARD_PIECES
    lengths, cost = tuple(permitted), bin_cost

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        place, final = pack(pdf["n_tokens"].tolist(), lengths, cost)
        pdf["bin_id"] = [f"{s}-{b}" for s, (b, _) in zip(pdf["shard"], place, strict=True)]
        pdf["bin_length"] = [final[b] for b, _ in place]
        pdf["bin_offset"] = [o for _, o in place]
        return pdf.drop(columns="shard")

    schema = "doc_id long, no_id boolean, piece int, n_tokens int, bin_id string, bin_length int, bin_offset int"
    dealt = pieces.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(shard, schema)
    none = pieces.filter("n_tokens = 0").select("doc_id", "no_id", "piece", "n_tokens", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(none).withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")

