"""N-gram Jaccard self-join with two-level PartEnum signatures.

A text is the set of its distinct word shingles. Equal sets are one class from the start: a class has one row, whatever the
number of its copies. Classes are put into size bands such that similar ones stand in the same or neighbouring bands; an
instance of the join holds one band and what may match it from the band below. Similar sets of an instance differ in at
most k features. The feature domain is cut by hash into n1 partitions and each of these into n2 cells, and every choice of
n2 - k2 cells of a partition makes a signature of the features in them. At least n1 - k / (k2 + 1) partitions hold at most
k2 of the differences, and in each of those similar sets share the signature of cells without one. n1, n2 and k2 are chosen
for each band by the least number of signatures and expected candidates.

A signature of empty cells would say nothing and isn't made. Similar sets still share one unless both have many partitions
with signatures of empty cells; such sets are signed again with other partitions.

The classes of a signature's bucket are candidates of each other. Buckets with the same smallest class make one family, and a
family whose smallest class stands in another one joins it, so that classes which share many buckets meet once and not in
each of them. A family is compared on whole sets, in blocks of
bounded size; a pair that meets in several families counts in the first. A block gives a row for a class, not for a
pair: its number of links, and a class that it is held together with.

Rows: null, empty and blank texts have the empty set, no links, and their own doc_id as component. Fewer words than a shingle
are one feature. Each row is a document of its own: rows that repeat a doc_id have the component of their own text, and a row
with a null doc_id links like any other, while only a doc_id can name a component (null: none is reachable). Sets are
compared by 64-bit hashes of their shingles. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._runtime import Scratch, lean, text_bytes, with_row
from .components import connected_components

_U = np.uint64
#: Bytes of signatures or sets of one group, read by one task.
GROUP_BYTES = 6 << 20
#: Rows up to this many are looked up by broadcast (at most some 100 bytes each); more by shuffle.
BROADCAST_ROWS = 200_000
#: Classes, and bytes of their sets, of one side of a block.
BLOCK, BLOCK_BYTES = 1024, 6 << 20
#: In the choice of partitions: the share of features that unrelated texts may have in common, and the signatures a candidate costs.
COMMON, CANDIDATE = 0.3, 400
#: Times that sets with many empty cells are signed, and the most of a band's sets that may need the next time.
TIMES, MOST_BARE = 10, 0.2


def _above(mean: float, n: int) -> float:
    """The chance that a Poisson number of this mean is above n."""
    if mean > 50:
        return math.erfc((n + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    return max(0.0, 1 - sum(math.exp(-mean + j * math.log(max(mean, 1e-300)) - math.lgamma(j + 1)) for j in range(min(n, 400) + 1)))


class Bands:
    """Size bands and their partitions for a threshold of percent / 100, up to a largest size."""

    def __init__(self, percent: int, largest: int) -> None:
        self.percent = percent
        names = ("lo", "hi", "k", "n1", "n2", "k2", "spare")
        rows, lo = [], 1
        while not rows or rows[-1][0] <= largest:
            hi = lo * 100 // percent
            k = 2 * hi * (100 - percent) // (100 + percent)
            rows.append((lo, hi, k, *(self._partitions(lo, k) if k else (0, 1, 0, 0))))
            lo = hi + 1
        for name, column in zip(names, zip(*rows, strict=True), strict=True):
            setattr(self, name, np.array(column))

    def _partitions(self, lo: int, k: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, partitions with signatures of empty cells that a set may have) of least cost."""
        least = -(-lo * self.percent // 100)
        best = None
        for k2, more, extra in itertools.product(range(min(k, 2) + 1), range(1, 5), (*range(12), *(x / 32 for x in range(1, 17)))):
            n2, spoilt = (k2 + more if k2 else 1), k // (k2 + 1)
            spare = extra if isinstance(extra, int) else math.ceil(extra * spoilt)
            n1 = spoilt + 1 + spare
            bare = _above(n1 * math.comb(n2, k2) * (1 - (n2 - k2) / (n1 * n2)) ** least, spare)
            if bare > MOST_BARE:
                continue
            signatures, features = n1 * math.comb(n2, k2) / (1 - bare), lo * (n2 - k2) / (n1 * n2)
            cost = signatures * (1 + CANDIDATE * COMMON**features)
            if best is None or cost < best[0]:
                best = cost, (n1, n2, k2, spare)
        return best[1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, sizes, "right") - 1


def sets_of(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of distinct shingles in order, features of each row, fingerprint of each row's set."""
    n = len(offs) - 1
    row, h = _text.word_hashes(data, offs)
    row, h = _text.distinct(*_text.shingles(h, row, n, size))
    counts = _text.counts_by_row(row, n)
    total = np.zeros(n, _U)
    np.add.at(total, row, _text.mix(h ^ _U(0x5851F42D4C957F2D)))
    return row, h, counts, _text.mix(total + counts.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(row: np.ndarray, h: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each set in its own instance and, where it may match the next band, in that one."""
    own = bands.of(np.maximum(counts, 1))
    rows, sigs = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for step in (0, 1):
        inst = np.minimum(own + step, len(bands.lo) - 1)
        on = (counts > 0) & (bands.n1[inst] > 0)
        if step:
            on &= (inst > own) & (counts * 100 // bands.percent >= bands.lo[inst])
        for time in range(TIMES):
            if not on.any():
                break
            last = time == TIMES - 1
            r, s, bare = _signed(row, h, counts, inst, on, bands, time, last)
            rows.append(r)
            sigs.append(s)
            on = bare
    return np.concatenate(rows), np.concatenate(sigs)


def _signed(row: np.ndarray, h: np.ndarray, counts: np.ndarray, inst: np.ndarray, on: np.ndarray, bands: Bands, time: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) by the partitions of one time, and which sets have too many signatures of empty cells; ``last`` makes those too."""
    n2, k2 = bands.n2[inst], bands.k2[inst]
    cells = np.where(on, bands.n1[inst] * n2, 0)
    base = np.cumsum(cells) - cells
    use = on[row]
    r, f = row[use], _text.mix(h[use] + _U((0x2545F4914F6CDD1D * (2 * time + 1)) & ((1 << 64) - 1)))
    cell = base[r] + (((f >> _U(32)) * cells[r].astype(_U)) >> _U(32)).astype(np.int64)
    total = int(cells.sum())
    value, filled = np.zeros(total, _U), np.zeros(total, bool)
    np.add.at(value, cell, _text.mix(f ^ _U(0x1F83D9ABFB41BD6B)))
    filled[cell] = True
    owner = np.repeat(np.arange(len(counts)), cells)
    place = np.arange(total) - base[owner]
    value = _text.mix(value + _text.mix((inst[owner].astype(_U) << _U(40)) + (place.astype(_U) << _U(4)) + _U(time)))
    rows, sigs, thin = [], [], np.zeros(len(counts), np.int64)
    for m2, q2 in {(int(a), int(b)) for a, b in zip(n2[on], k2[on], strict=True)}:
        mine = np.flatnonzero((n2[owner] == m2) & (k2[owner] == q2))
        v, there, of = value[mine].reshape(-1, m2), filled[mine].reshape(-1, m2), owner[mine[::m2]]
        np.add.at(thin, of, there.sum(1) <= q2)
        for c, chosen in enumerate(itertools.combinations(range(m2), m2 - q2)):
            some = np.ones(len(of), bool) if last else there[:, chosen].any(1)
            rows.append(of[some])
            sigs.append(_text.mix(v[some][:, chosen].sum(1, dtype=_U) + _U(c + 1)))
    return np.concatenate(rows), np.concatenate(sigs), on & (thin > bands.spare[inst])


def shared(many: list[np.ndarray], step: int = 1024) -> np.ndarray:
    """How many features each two sets have in common."""
    owner = np.repeat(np.arange(len(many)), [len(x) for x in many])
    _, f, often = np.unique(np.concatenate(many), return_inverse=True, return_counts=True)
    some = (often > 1) & (often < len(many))
    names = np.cumsum(some) - 1
    use = some[f]
    owner, f = owner[use], names[f[use]]
    order = np.argsort(f, kind="stable")
    owner, f = owner[order], f[order]
    both = np.full((len(many), len(many)), np.float32((often == len(many)).sum()))
    for s in range(0, int(f[-1]) + 1 if len(f) else 0, step):
        i, j = np.searchsorted(f, [s, s + step])
        m = np.zeros((len(many), min(step, int(f[-1]) + 1 - s)), np.float32)
        m[owner[i:j], f[i:j] - s] = 1
        both += m @ m.T
    return both


def _linked(family: int, side: np.ndarray | None, n: np.ndarray, copies: np.ndarray, families: list[np.ndarray], many: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one block: links of each class by the others' copies, and the first class that it is held together with.

    ``side``: only classes of different sides are compared. A pair that shares an earlier family counts there.
    """
    both = shared(many)
    earlier = [x[x < family] for x in families]
    elsewhere = shared(earlier) if any(map(len, earlier)) else None
    if elsewhere is not None:  # families that all have, or one only, aren't names there
        elsewhere = elsewhere > 0
    ok = np.empty(both.shape, bool)
    for s in range(0, len(n), 256):
        k = both[s : s + 256]
        ok[s : s + 256] = 100 * k >= percent * (n[s : s + 256, None] + n[None] - k)
    del both
    np.fill_diagonal(ok, False)
    if side is not None:
        ok &= side[:, None] != side[None]
    if elsewhere is not None:
        ok &= ~elsewhere
    links, first = np.zeros(len(n), np.int64), np.arange(len(n))
    for s in range(0, len(n), 256):
        links[s : s + 256] = (ok[s : s + 256] * copies).sum(1)
    while True:
        near = first.copy()
        for s in range(0, len(n), 256):
            near[s : s + 256] = np.minimum(near[s : s + 256], np.where(ok[s : s + 256], first, len(n)).min(1, initial=len(n)))
        near = near[near]
        if (near == first).all():
            return links, first
        first = near


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, n_links (the other rows it is similar to), component_id for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    bands = Bands(percent, 1 << 31)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, -(-text_bytes(docs) * 3 // (2 * GROUP_BYTES)))  # about 1.5 bytes of signatures for each byte of text

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    # The set of each row, and the classes of equal sets.
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in _text.slices(b.column("text")):
                _, _, counts, node = sets_of(data, offs, size)
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(counts), pa.array(node)], names=["row", "doc_id", "n", "node"])

    described = scratch.keep(docs.mapInArrow(describe, "row long, doc_id long, n long, node long"))
    filled = described.filter("n > 0")
    classes = scratch.keep(filled.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    copied = scratch.keep(described.join(classes.select("row"), "row", "left_anti").select(F.col("row").alias("_row")))

    # One row a class gives its signatures, dealt into groups; those of a slice for a group are one packed row.
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in _text.slices(b.column("text")):
                row, h, counts, node = sets_of(data, offs, size)
                r, sig = signatures(row, h, counts, bands)
                p = ((_text.mix(sig) >> _U(32)) * _U(groups)) >> _U(32)
                order = np.lexsort((r, p))
                p, r, sig = p[order], r[order], sig[order]
                run = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])][: len(p)])
                times = np.diff(np.append(run, len(p))).astype(np.uint32)
                owners, group = node[r[run]], p[run]
                cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
                ends = np.append(cut[1:], len(group))[: len(cut)]
                at = np.append(run, len(p))
                blobs = lambda x, a, z: pa.array([x[i:j].tobytes() for i, j in zip(a, z, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(group[cut].astype(np.int32)), blobs(sig, at[cut], at[ends]), blobs(owners, cut, ends), blobs(times, cut, ends)], names=["p", "sigs", "nodes", "times"])

    def buckets(table: pa.Table) -> pa.Table:
        """Families (smallest class of a bucket) and their other classes."""
        whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
        sig, node = whole("sigs", np.int64), np.repeat(whole("nodes", np.int64), whole("times", np.uint32))
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        times = np.diff(np.append(head, len(sig)))
        family = np.repeat(np.minimum.reduceat(node, head), times)
        other = family != node
        order = np.lexsort((node[other], family[other]))
        family, node = family[other][order], node[other][order]
        new = np.r_[True, (family[1:] != family[:-1]) | (node[1:] != node[:-1])][: len(node)]
        out = pa.table({"family": family[new], "node": node[new]})
        del sig, node, family, order, other
        lean()
        return out

    signed = docs.select("_row", "text").join(small(copied), "_row", "left_anti").mapInArrow(sign, "p int, sigs binary, nodes binary, times binary")
    others = scratch.keep(signed.groupBy("p").applyInArrow(buckets, "family long, node long").distinct())
    # A family whose smallest class stands in another family joins the first of those: near copies then meet in one.
    first_of = scratch.keep(others.join(others.select(F.col("family").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.min("family").alias("first")))
    whole = others.unionByName(others.select("family", F.col("family").alias("node")).distinct())
    whole = whole.join(small(first_of.withColumnRenamed("node", "family")), "family", "left")
    members = scratch.keep(whole.select(F.coalesce("first", "family").alias("family"), "node").distinct())

    # Families too large for one block are cut by hash; each two of their parts make a block.
    sized = scratch.keep(members.join(classes.select("node", "n"), "node"))
    by_class, by_bytes = F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)
    large = scratch.keep(sized.groupBy("family").agg(F.greatest(by_class, by_bytes).cast("int").alias("parts")).filter("parts > 1"))
    sized = scratch.keep(sized.join(small(large), "family", "left").fillna(1, ["parts"]))
    load = sized.agg(F.sum((F.col("n") * 8 + 64) * F.col("parts"))).first()[0] or 0
    groups_of_blocks = max(least, -(-load // GROUP_BYTES))
    asked = sized.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("family", "parts"))).alias("families"), F.max("n").alias("n")).join(classes.select("node", "row", "copies"), "node")
    # A class of several families that hang together is sent once, where all of them fit into one block.
    hung = connected_components(members.select(F.col("family").alias("a"), F.col("node").alias("b")), scratch)
    asked = asked.join(hung, "node")
    light = asked.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("features")).filter((F.col("m") <= BLOCK) & (F.col("features") * 8 <= BLOCK_BYTES)).select("component", F.pmod(F.xxhash64("component"), F.lit(groups_of_blocks)).cast("int").alias("home"))
    asked = scratch.keep(asked.join(light, "component", "left").select(F.col("row").alias("_row"), "copies", "families", "home"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole set of each class for every block it stands in."""
        names = ("p", "family", "lo", "hi", "part", "node", "n", "copies", "families", "features")
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            lists = b.column("families")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            every, parts = flat.field("family").to_numpy(), flat.field("parts").to_numpy(zero_copy_only=False)
            copies, homes = b.column("copies").to_numpy(), b.column("home").to_pylist()
            for first, _, data, offs in _text.slices(b.column("text")):
                _, h, counts, node = sets_of(data, offs, size)
                ends, out, held = np.cumsum(counts), [], 0
                for i, c in enumerate(counts):
                    own = slice(bounds[first + i], bounds[first + i + 1])
                    features, known = h[ends[i] - c : ends[i]].tobytes(), every[own].tobytes()
                    mine = _text.mix(every[own].view(_U) ^ _text.mix(node[i : i + 1].view(_U)))
                    if homes[first + i] is not None:
                        out.append((homes[first + i], None, 0, 0, 0, int(node[i]), int(c), int(copies[first + i]), known, features))
                        held += len(features) + len(known) + 80
                        continue
                    for family, m, x in zip(every[own].tolist(), parts[own].tolist(), mine.tolist(), strict=True):
                        part = x % m
                        for k in range(m):
                            lo, hi = min(part, k), max(part, k)
                            p = hash((family, lo, hi)) % groups_of_blocks
                            out.append((p, family, lo, hi, part, int(node[i]), int(c), int(copies[first + i]), known, features))
                            held += len(features) + len(known) + 80
                            if held > GROUP_BYTES:
                                yield pack(out)
                                out, held = [], 0
                if out:
                    yield pack(out)

    def compare(table: pa.Table) -> pa.Table:
        known, features = ([np.frombuffer(v.as_buffer(), kind) for v in table.column(c)] for c, kind in (("families", np.int64), ("features", _U)))
        # a row without a family stands for all of its families
        whole_row = table.column("family").is_null().to_numpy()
        times = np.where(whole_row, [len(x) for x in known], 1)
        at = np.repeat(np.arange(table.num_rows), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        one = pc.fill_null(table.column("family"), 0).to_numpy()
        family = np.array([known[i][k] if whole_row[i] else one[i] for i, k in zip(at, nth, strict=True)], np.int64)
        lo, hi, part, node, n, copies = (table.column(c).to_numpy()[at] for c in ("lo", "hi", "part", "node", "n", "copies"))
        order = np.lexsort((node, hi, lo, family))
        at, family, lo, hi, part, node, n, copies = (x[order] for x in (at, family, lo, hi, part, node, n, copies))
        head = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        outs = []
        for s, e in zip(head, np.append(head[1:], len(node)), strict=True):
            if e - s > 1:
                mine = at[s:e]
                links, first = _linked(family[s], part[s:e] if lo[s] < hi[s] else None, n[s:e], copies[s:e], [known[i] for i in mine], [features[i] for i in mine], percent)
                hit = np.flatnonzero(links)
                outs.append((node[s:e][hit], links[hit], node[s:e][first[hit]]))
        out = [np.concatenate(c) for c in zip(*outs, strict=True)] if outs else [np.zeros(0, np.int64)] * 3
        lean()
        return pa.table(dict(zip(("node", "links", "with"), out, strict=True)))

    blocks = docs.select("_row", "text").join(small(asked), "_row").mapInArrow(deal, "p int, family long, lo int, hi int, part int, node long, n long, copies long, families binary, features binary")
    found = scratch.keep(blocks.groupBy("p").applyInArrow(compare, "node long, links long, `with` long"))

    held = connected_components(found.select(F.col("node").alias("a"), F.col("with").alias("b")), scratch)
    named = classes.join(held, "node", "left").withColumn("component", F.coalesce("component", "node")).join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.keep(named.join(least_id, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    scratch.drop(copied, others, first_of, members, sized, large, asked, found, classes)
    # A class may hold a third of all rows: the adaptive plan cuts such a partition of this join.
    out = filled.join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "n_links", "component_id")
    return out.unionByName(described.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")))
