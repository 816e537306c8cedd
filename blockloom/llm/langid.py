"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed into BUCKETS features; term frequencies are shares of the text's
n-grams and document frequencies cover every training document. Weights come from follow-the-regularised-leader with an
elastic-net penalty over at most FIT_DOCS training rows and FIT_BYTES of text, and a temperature fitted on documents kept from
training calibrates the probabilities.

Rows: a null text or one without a letter is ``und`` with score 0. Only non-null lang of training rows is learned; without
any, everything is ``und``; of languages with equal scores the first by name. Rows that repeat an id are fitted on once (its first
language by name, its smallest text) and scored once each. Long texts are read a part at a time. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import bounded_rows, held_out
from ._runtime import crc_mod, prepare

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Training documents that the weights are fitted on, at most.
FIT_DOCS = 4000
CHARS = 1 << 20
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _grams_of(parts: list[str], starts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each n-gram, feature of each n-gram, whether each row has a letter); only n-grams that begin before ``starts``."""
    lens = np.array([len(p) for p in parts])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    row = np.repeat(np.arange(len(parts)), lens)
    has = np.bincount(row, letter, len(parts)) > 0
    feats, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    h = np.zeros(len(code), np.uint32)
    for k in ORDERS:
        m = len(code) - k + 1
        if m <= 0:
            break
        h = h[:m] + (code[k - 1 :] + np.uint32(k)) * _MULTIPLIERS[k - 1]
        ok = letter[:m] | letter[k - 1 :]
        ok &= row[:m] == row[k - 1 :]
        at = np.flatnonzero(ok[:starts])
        x = h[at]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(2246822519)
        feats.append((x >> np.uint32(32 - BITS)).astype(np.int32))
        rows.append(row[at])
    return np.concatenate(rows), np.concatenate(feats), has


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first row, end row, row of each n-gram, feature of each, whether each row has a letter, times of each) in runs of bounded size.

    Times are None for 1 each. A text of more than CHARS characters stands alone; its n-grams are added up by feature, a
    part of it at a time.
    """
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (not parts or size + len(texts[hi] or "") <= CHARS):
            parts.append((texts[hi] or "").lower())
            size += len(parts[-1])
            hi += 1
        if size <= CHARS:
            row, feat, has = _grams_of(parts)
            yield lo, hi, row, feat, has, None
        else:
            times, letter, reach = np.zeros(BUCKETS, np.int64), False, max(ORDERS) - 1
            for s in range(0, size, CHARS):
                _, feat, has = _grams_of([parts[0][s : s + CHARS + reach]], CHARS)
                times += np.bincount(feat, minlength=BUCKETS)
                letter |= bool(has[0])
            feat = np.flatnonzero(times)
            yield lo, hi, np.zeros(len(feat), np.int64), feat.astype(np.int32), np.array([letter]), times[feat]
        lo = hi


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each feature) over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for lo, hi, row, feat, *_ in grams(b.column("text").to_pylist()):
                n += hi - lo
                order = np.argsort(row, kind="stable")
                row, feat = row[order], feat[order]
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                seen = np.zeros(BUCKETS, bool)
                for i, j in zip(cut, cut[1:], strict=False):
                    f = feat[i:j]
                    seen[f] = True
                    hit = np.flatnonzero(seen) if j - i > BUCKETS // 8 else np.unique(f)
                    df[hit] += 1
                    seen[hit] = False
        df[BUCKETS] = n
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for v in b.column("df"):
                df += np.frombuffer(v.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["df"])

    # One row of fixed size a task, added up in 16 tasks: what reaches the driver doesn't grow.
    parts = docs.select("text").mapInArrow(count, "df binary").repartition(16).mapInArrow(add, "df binary").collect()
    df = sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(BUCKETS + 1, np.int64))
    return int(df[BUCKETS]), df[:BUCKETS]


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3, seed: int = 2) -> np.ndarray:
    """Follow-the-regularised-leader: (BUCKETS + 1, classes) weights, the last row the bias; most weights are exactly 0."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            f, v = docs[i]
            w = weights(f)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            root = np.sqrt(n[f])
            n[f] += g * g
            z[f] += g - (np.sqrt(n[f]) - root) / alpha * w
    return weights(np.arange(BUCKETS + 1))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the least log loss."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def _vector(feat: np.ndarray, times: np.ndarray | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, c = (feat, times) if times is not None else np.unique(feat, return_counts=True)
    v = c / max(1, c.sum()) * idf[f] * SCALE
    return np.append(f, BUCKETS), np.append(v, 1.0)


#: Brings shares of n-grams to the size of the bias.
SCALE = 10.0


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 29) -> dict:
    prepare(docs.sparkSession)
    learn = docs.filter(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", 5), F.lit(0)) != 0) & F.col("doc_id").isNotNull())
    n, df = document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = learn.groupBy("doc_id").agg(F.min(F.col("lang").cast("string")).alias("lang")).orderBy(order, "doc_id").limit(fit_docs)
    got = bounded_rows(learn, picked, order, fit_docs).toPandas().sort_values("doc_id")
    vectors, y, names = [], [], sorted(set(got["lang"]))
    texts, langs = got["text"].tolist(), got["lang"].tolist()
    for lo, hi, row, feat, has, times in grams(texts):
        by = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[by], np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if has[k]:
                vectors.append(_vector(feat[by[cut[k] : cut[k + 1]]], times, idf))
                y.append(names.index(langs[lo + k]))
    y = np.array(y, int)
    if not len(y):
        return {"names": []}
    kept = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    w = fit([v for v, k in zip(vectors, kept, strict=True) if not k], y[~kept], len(names))
    scores = np.array([v @ w[f] for (f, v), k in zip(vectors, kept, strict=True) if k]).reshape(-1, len(names))
    t = temperature(scores, y[kept])
    return {"names": names, "w": (w[:-1] * (idf * SCALE)[:, None]).astype(np.float32), "bias": w[-1], "t": t, "nonzero": int((w != 0).sum())}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model["names"], "und"], object)
        for b in batches:
            best, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            for lo, hi, row, feat, has, times in grams(b.column("text").to_pylist()) if model["names"] else ():
                total = np.maximum(1, np.bincount(row, times, hi - lo))
                said = lambda w, f=feat, t=times: w[f] if t is None else w[f] * t
                s = np.stack([np.bincount(row, said(model["w"][:, k]), hi - lo) / total + model["bias"][k] for k in range(len(names) - 1)], 1) / model["t"]
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[lo:hi] = np.where(has, p.argmax(1), len(names) - 1)
                score[lo:hi] = np.where(has, p.max(1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    return identify(docs, train(docs, fit_docs)).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
