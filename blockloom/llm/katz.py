"""Language-model scores by Katz backoff over word bigrams.

Counts are discounted by Good-Turing up to DISCOUNTED, and what the seen continuations of a context leave is spread over the
others by a weight that makes every context's probabilities add up to 1. Unigrams leave their mass to one unknown word.

Texts are dealt into batches. A batch sends its distinct words and bigrams, with training counts, to tables that are
partitioned by key; each partition adds up its keys and answers every batch that asked. With the answers a batch
evaluates its tokens: a seen bigram at once; for an unseen one it goes down to the unigram and asks the partition of the
context for the backoff weight, which is made from sums over the context's bigrams, each of them sent by one batch only.

Rows: null, empty and blank texts are one end token. Repeated rows are documents of their own; a null doc_id belongs to the
training rows. Words are told apart by 64-bit hashes. Without training rows every token has probability 1. Extra columns
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._fit import held_out
from ._runtime import Scratch, text_bytes

_U = np.uint64
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Share of every context that is kept for unseen words even where Good-Turing leaves none.
FLOOR = 1e-4
#: Bytes of texts of a batch, and about that of the keys of a partition.
BATCH_TEXT = 8 << 20
END, BEGIN = _U(0x0123456789ABCDEF), _U(0xFEDCBA9876543210)


def discounts(n: list[int]) -> np.ndarray:
    """Factors of counts 0 to DISCOUNTED + 1 (for that and all above), from the numbers of types seen 1, 2, ... times.

    Good-Turing as they are; if that gives no factors between 0 and 1, with the numbers smoothed by a power law; if
    there is none, half a count less for each.
    """
    r = np.arange(1, DISCOUNTED + 1)
    d = np.ones(DISCOUNTED + 2)
    d[1:-1] = (r - 0.5) / r
    few = np.array(n[: DISCOUNTED + 1], float)
    if (few > 0).all():
        slope, height = np.polyfit(np.log(np.arange(1, DISCOUNTED + 2)), np.log(few), 1)
        for types in (few, np.exp(height + slope * np.log(np.arange(1, DISCOUNTED + 2)))):
            a = (DISCOUNTED + 1) * types[DISCOUNTED] / types[0]
            turing = ((r + 1) * types[1:] / types[:-1] / r - a) / (1 - a) if a < 1 else np.zeros(DISCOUNTED)
            if ((turing > 0) & (turing <= 1)).all():
                d[1:-1] = turing
                break
    d *= 1 - FLOOR
    d[0] = 0
    return d


class Batch:
    """The tokens of a batch, their distinct words and bigrams in the order of their hashes."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        n, parts, rows = table.num_rows, [], []
        for lo, _, data, offs in _text.slices(table.column("text")):
            starts, ends, row = _text.words(data, offs)
            parts.append(_text.span_hashes(data, starts, ends))
            rows.append(row + lo)
        row = np.concatenate([*rows, np.arange(n)]) if n else np.zeros(0, np.int64)
        w = np.concatenate([*parts, np.full(n, END, _U)])
        order = np.argsort(row, kind="stable")  # the end stands after the words of its row
        self.n, self.row, w = n, row[order], w[order]
        h = np.empty_like(w)
        if len(w):
            h[1:] = w[:-1]
            h[np.r_[True, self.row[1:] != self.row[:-1]]] = BEGIN
        self.train = ~table.column("held_out").to_numpy(zero_copy_only=False)[self.row] if n else np.zeros(0, bool)
        self.words, self.word = np.unique(w, return_inverse=True)
        b = _text.mix(_text.mix(h) + w * _U(0x9E3779B97F4A7C15))
        self.bigrams, first, self.bigram = np.unique(b, return_index=True, return_inverse=True)
        self.head, self.last = h[first], self.word[first]
        self.head_at = np.where(self.head == BEGIN, -1, self.word[np.maximum(first - 1, 0)])

    def counts(self, which: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(which[self.train], minlength=n).astype(np.uint32)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` ranges of the hash begins in sorted keys."""
    return np.searchsorted(((keys >> _U(32)) * _U(parts)) >> _U(32), np.arange(parts + 1).astype(_U))


def score_documents(docs: DataFrame, m: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; trained on rows outside the fold."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = text_bytes(docs)
    batches = max(1, -(-size // BATCH_TEXT))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(m, remainder))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64(F.lit(9), "doc_id", F.length("text")), F.lit(batches)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        b = Batch(table)
        p, kind, keys, counts = [], [], [], []
        for k, (names, which) in enumerate(((b.words, b.word), (b.bigrams, b.bigram))):
            n = b.counts(which, len(names))
            cut = _cuts(names, parts)
            for i in np.flatnonzero(np.diff(cut)):
                s, e = cut[i], cut[i + 1]
                p.append(i)
                kind.append(k)
                keys.append(names[s:e].tobytes())
                counts.append(n[s:e].tobytes())
        return pa.table({"p": pa.array(p, pa.int32()), "kind": pa.array(kind, pa.int32()), "batch": pa.array([key[0].as_py()] * len(p), pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        keys = [np.frombuffer(x.as_buffer(), _U) for x in table.column("keys")]
        mine = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, mine, len(names)).astype(np.int64)
        owner = np.full(len(names), len(at))
        held = np.flatnonzero(mine > 0)
        np.minimum.at(owner, at[held], held)  # of the batches that hold a key in training, one speaks for it
        value = total[at] * 2 + (owner[at] == np.arange(len(at)))
        ends = np.cumsum([len(k) for k in keys])
        stats = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int(total.sum()), int((total > 0).sum())]
        n = table.num_rows
        return pa.table({"batch": table.column("batch"), "p": table.column("p"), "kind": table.column("kind"), "values": pa.array([value[e - len(k) : e].astype(np.uint64).tobytes() for k, e in zip(keys, ends, strict=True)], pa.binary()), "stats": pa.array([stats] + [None] * (n - 1), pa.list_(pa.int64()))})

    asked = dealt.groupBy("batch").applyInArrow(ask, "p int, kind int, batch int, keys binary, counts binary")
    answers = scratch.keep(asked.groupBy("p", "kind").applyInArrow(answer, "batch int, p int, kind int, values binary, stats array<bigint>"))
    sums = {r["kind"]: r["s"] for r in answers.filter("stats is not null").groupBy("kind").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(DISCOUNTED + 3)]).alias("s")).collect()}
    none = [0] * (DISCOUNTED + 3)
    one, two = sums.get(0, none), sums.get(1, none)
    tokens, types = one[-2], one[-1]
    d1, d2 = discounts(one), discounts(two)
    top = DISCOUNTED + 1
    left = 1 - (sum(d1[r] * r * one[r - 1] for r in range(1, top)) + d1[top] * (tokens - sum(r * one[r - 1] for r in range(1, top)))) / tokens if tokens else 1.0
    base = np.log10(tokens + types + 1)

    def evaluate(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = Batch(table)
        replies = replies.sort_by([("kind", "ascending"), ("p", "ascending")])
        kinds = replies.column("kind").to_numpy()
        got = [np.frombuffer(b"".join(x for x, k in zip(replies.column("values").to_pylist(), kinds, strict=True) if k == kind), _U).astype(np.int64) for kind in (0, 1)]
        c1, c2, own = got[0] >> 1, got[1] >> 1, (got[1] & 1).astype(bool)
        p1 = np.where(c1 > 0, d1[np.minimum(c1, top)] * c1 / max(1, tokens), left)
        begun = c1[np.searchsorted(b.words, END)] if b.n else 0
        ch = np.where(b.head_at < 0, begun, c1[b.head_at])
        part2 = d2[np.minimum(c2, top)] * c2
        lead = np.log10(np.where(c2 > 0, part2 / np.maximum(1, ch), p1[b.last]))
        # each token as far as this batch can tell
        n_tokens = np.bincount(b.row, minlength=b.n)
        known = np.bincount(b.row, c1[b.word] > 0, b.n)
        base_score = np.bincount(b.row, np.log10(c1[b.word] + 1) - base, b.n)
        score = np.bincount(b.row, lead[b.bigram], b.n)
        # contexts: what their bigrams take, for those that this batch speaks for
        at = np.flatnonzero(own & (c2 > 0))
        heads, ctx = np.unique(b.head[at], return_inverse=True)
        lower = np.bincount(ctx, p1[b.last[at]], len(heads))
        taken = np.bincount(ctx, part2[at] / ch[at], len(heads)) if len(at) else np.zeros(0)
        # tokens that need a backoff weight
        need = np.flatnonzero((c2 == 0)[b.bigram] & (ch > 0)[b.bigram])
        want, row = b.head[b.bigram[need]], b.row[need]
        order = np.argsort(want, kind="stable")
        want, row = want[order], row[order]
        cut, cut2 = _cuts(heads, parts), _cuts(want, parts)
        use, use2 = np.flatnonzero(np.diff(cut)), np.flatnonzero(np.diff(cut2))
        blobs = lambda x, c, u: [x[c[i] : c[i + 1]].tobytes() for i in u]
        n, m1, m2 = b.n, len(use), len(use2)
        col = lambda a, x, y, t: pa.array([*(a if a is not None else [None] * n), *(x if x is not None else [None] * m1), *(y if y is not None else [None] * m2)], t)
        return pa.table({
            "batch": col([key[0].as_py()] * n, [key[0].as_py()] * m1, [key[0].as_py()] * m2, pa.int32()),
            "row": col(range(n), None, None, pa.int32()),
            "doc_id": col(table.column("doc_id").to_pylist(), None, None, pa.int64()),
            "held_out": col(table.column("held_out").to_pylist(), None, None, pa.bool_()),
            "n_tokens": col(n_tokens.tolist(), None, None, pa.int64()),
            "n_known": col(known.astype(np.int64).tolist(), None, None, pa.int64()),
            "base_score": col(base_score.tolist(), None, None, pa.float64()),
            "part": col(score.tolist(), None, None, pa.float64()),
            "p": col(None, use.tolist(), use2.tolist(), pa.int32()),
            "contexts": col(None, blobs(heads, cut, use), blobs(want, cut2, use2), pa.binary()),
            "lower": col(None, blobs(lower, cut, use), None, pa.binary()),
            "taken": col(None, blobs(taken, cut, use), None, pa.binary()),
            "rows": col(None, None, blobs(row.astype(np.int32), cut2, use2), pa.binary()),
        })

    schema = "batch int, row int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, part double, p int, contexts binary, lower binary, taken binary, rows binary"
    seen = scratch.keep(dealt.groupBy("batch").cogroup(answers.select("batch", "p", "kind", "values").groupBy("batch")).applyInArrow(evaluate, schema))

    def weigh(table: pa.Table) -> pa.Table:
        made = table.filter(pa.compute.is_valid(table.column("taken"))).sort_by("batch")
        asks = table.filter(pa.compute.is_valid(table.column("rows")))
        read = lambda t, c, k: np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(c)]) if t.num_rows else np.zeros(0, k)
        names, at = np.unique(read(made, "contexts", _U), return_inverse=True)
        if not asks.num_rows or not len(names):
            return pa.table({"batch": pa.array([], pa.int32()), "rows": pa.array([], pa.binary()), "weights": pa.array([], pa.binary())})
        lower, taken = np.bincount(at, read(made, "lower", np.float64), len(names)), np.bincount(at, read(made, "taken", np.float64), len(names))
        alpha = np.log10((1 - taken) / (1 - lower))
        want = read(asks, "contexts", _U)
        i = np.minimum(np.searchsorted(names, want), len(names) - 1)
        value = np.where(names[i] == want, alpha[i], 0)
        rows = [len(x.as_buffer()) // 4 for x in asks.column("rows")]
        key = np.repeat(asks.column("batch").to_numpy().astype(np.int64), rows) << 32 | read(asks, "rows", np.int32)
        who, at = np.unique(key, return_inverse=True)
        sums, of = np.bincount(at, value, len(who)), who >> 32
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ends = np.append(cut[1:], len(who))
        return pa.table({"batch": of[cut].astype(np.int32), "rows": pa.array([(who[i:j] & 0xFFFFFFFF).astype(np.int32).tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()), "weights": pa.array([sums[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        """A batch's answers from all partitions, added up for each row."""
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("rows")])
        sums = np.bincount(rows, np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("weights")]))
        has = np.unique(rows)
        return pa.table({"batch": np.full(len(has), key[0].as_py(), np.int32), "row": has, "weight": sums[has]})

    weights = seen.filter("p is not null").select("batch", "p", "contexts", "lower", "taken", "rows").groupBy("p").applyInArrow(weigh, "batch int, rows binary, weights binary")
    weights = weights.groupBy("batch").applyInArrow(total, "batch int, row int, weight double")
    out = seen.filter("p is null").join(weights, ["batch", "row"], "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", (F.col("part") + F.coalesce("weight", F.lit(0.0))).alias("score"))
