"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage enters as the mean embedding of its words (a learned table of hashed
words) beside its character-class bigrams and word statistics, all of them of the passage alone. Gated attention, learned
from document labels alone, weighs the encoded passages, and the weighted representation is scored. Every passage of the
whole text is encoded.

Rows: null, empty and blank texts are a bag of one empty passage; long texts are read in pieces of whole passages. Labels come
from at most FIT_DOCS rows and FIT_BYTES of text outside the held-out fold; with no labels of one class the score is the
smoothed share of ones (0.5 without labels). Repeated rows are scored once each. Extra columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._fit import Adam, held_out, labelled_sample, sigmoid
from ._runtime import prepare

PASSAGE = 64
#: Labelled documents that the model is fitted on, at most.
FIT_DOCS = 6000
#: Words of a long text that are read at a time: whole passages.
PIECE_WORDS = PASSAGE << 10
HIDDEN, EMBEDDING, WORD_BITS = 24, 8, 12
_CLASSES = 9
#: space, line end, lower case, upper case, digit, sentence mark, bar, loud mark, byte of a longer character
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[0x20, 0x09, 0x0B, 0x0C]] = 0
_CLASS[[0x0A, 0x0D]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 8
FEATURES = _CLASSES * _CLASSES + 5


class Bags(NamedTuple):
    """Passages of some documents: document and counts of each, and the hashed words of all, with how many each has."""

    doc: np.ndarray
    x: np.ndarray
    word: np.ndarray
    size: np.ndarray


def passages(data: np.ndarray, offs: np.ndarray) -> Bags:
    n = len(offs) - 1
    starts, ends, row = _text.words(data, offs)
    counts = _text.counts_by_row(row, n)
    per = np.maximum(1, -(-counts // PASSAGE))
    base = np.cumsum(per) - per
    doc = np.repeat(np.arange(n), per)
    first = np.cumsum(counts) - counts
    at = base[row] + (np.arange(len(row)) - first[row]) // PASSAGE
    p = len(doc)
    x = np.zeros((p, FEATURES), np.float32)
    if not len(starts):
        return Bags(doc, x, np.zeros(0, np.uint16), np.zeros(p, np.int64))
    # a passage owns the bytes from its first word to the next passage's first word
    lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    owner = np.full(len(data), -1, np.int64)
    span_end = np.minimum(np.append(starts[lead][1:], len(data)), offs[row[lead] + 1])
    span = span_end - starts[lead]
    pos = np.repeat(starts[lead] - (np.cumsum(span) - span), span) + np.arange(span.sum())
    owner[pos] = np.repeat(at[lead], span)
    c = _CLASS[data].astype(np.int64)
    inside = np.flatnonzero((owner[:-1] >= 0) & (owner[:-1] == owner[1:])) if len(data) > 1 else np.zeros(0, np.int64)
    big = np.bincount(owner[inside] * (_CLASSES * _CLASSES) + c[inside] * _CLASSES + c[inside + 1], minlength=p * _CLASSES * _CLASSES).reshape(p, -1)
    x[:, : _CLASSES * _CLASSES] = np.sqrt(big / np.maximum(1, big.sum(1))[:, None])
    h = _text.span_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    words = np.bincount(at, minlength=p)
    m = np.maximum(1, words)
    mean = np.bincount(at, length, p) / m
    group, _ = _text.distinct(at, h)
    x[:, -5] = mean / 10
    x[:, -4] = np.sqrt(np.maximum(0, np.bincount(at, length * length, p) / m - mean * mean)) / 10
    x[:, -3] = np.bincount(group, minlength=p) / m
    x[:, -2] = words / PASSAGE
    x[:, -1] = np.bincount(at, length <= 3, p) / m
    return Bags(doc, x, (h >> np.uint64(64 - WORD_BITS)).astype(np.uint16), words)


def encode(p: dict[str, np.ndarray], bags: Bags) -> np.ndarray:
    """What a passage enters as: the mean embedding of its words beside its counts."""
    mean = np.zeros((len(bags.x), EMBEDDING))
    some = np.flatnonzero(bags.size)
    if len(some):
        begin = (np.cumsum(bags.size) - bags.size)[some]
        mean[some] = np.add.reduceat(p["E"][bags.word], begin, 0) / bags.size[some][:, None]
    return np.concatenate([(bags.x - p["mean"]) / p["std"], mean], 1)


def forward(p: dict[str, np.ndarray], bags: Bags, n: int) -> dict[str, np.ndarray]:
    x, doc = encode(p, bags), bags.doc
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, e)
    a = np.exp(e - top[doc])
    a /= np.bincount(doc, a, n)[doc]
    z = np.stack([np.bincount(doc, a * h[:, k], n) for k in range(h.shape[1])], 1)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": z @ p["c"] + p["d"]}


def gradients(p: dict[str, np.ndarray], bags: Bags, n: int, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss; ``p`` holds the fixed mean and std as well."""
    f, doc = forward(p, bags, n), bags.doc
    ds = (sigmoid(f["s"]) - y) / n
    dz = ds[:, None] * p["c"]
    da = (dz[doc] * f["h"]).sum(1)
    de = f["a"] * (da - np.bincount(doc, f["a"] * da, n)[doc])
    dtg = de[:, None] * p["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    dmean = (dx @ p["W"][FEATURES:].T) / np.maximum(1, bags.size)[:, None]
    each = np.repeat(dmean, bags.size, 0)
    dE = np.stack([np.bincount(bags.word, each[:, k], 1 << WORD_BITS) for k in range(EMBEDDING)], 1)
    return {"E": dE, "W": f["x"].T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def start(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "E": rng.normal(0, 0.1, (1 << WORD_BITS, EMBEDDING)), "W": rng.normal(0, 0.15, (FEATURES + EMBEDDING, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, 12)),
        "U": rng.normal(0, 0.2, (HIDDEN, 12)), "w": rng.normal(0, 0.2, 12), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
    }


def joined(bags: list[Bags]) -> Bags:
    return Bags(np.repeat(np.arange(len(bags)), [len(b.x) for b in bags]), *(np.concatenate([b[k] for b in bags]) for k in (1, 2, 3)))


def fit(bags: list[Bags], y: np.ndarray, epochs: int = 25, batch: int = 256, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    every = np.concatenate([b.x for b in bags])
    p, fixed = start(seed), {"mean": every.mean(0), "std": every.std(0) + 0.02}
    adam = Adam(p, 0.01)
    batch = min(batch, max(32, len(bags) // 8))
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for s in range(0, len(order), batch):
            ids = order[s : s + batch]
            adam.step(gradients(p | fixed, joined([bags[i] for i in ids]), len(ids), y[ids]))
    return p | fixed


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 23) -> dict[str, np.ndarray]:
    """The model; {"prior": share} where labels of one class are missing."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in _text.slices(b.column("text")):
                got = passages(data, offs)
                cut = np.searchsorted(got.doc, np.arange(hi - lo + 1))
                word = np.r_[0, np.cumsum(got.size)][cut]
                blobs = lambda x, c: pa.array([np.ascontiguousarray(x[i:j]).tobytes() for i, j in zip(c, c[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), blobs(got.x, cut), blobs(got.word, word), blobs(got.size, cut)], names=["doc_id", "y", "x", "word", "size"])

    prepare(docs.sparkSession)
    got = labelled_sample(docs, labels, "quality", fit_docs, 3, 1, seed).mapInArrow(bags, "doc_id long, y int, x binary, word binary, size binary").toPandas().sort_values("doc_id")
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return {"prior": np.array((y.sum() + 1) / (len(y) + 2))}
    read = lambda r: Bags(None, np.frombuffer(r.x, np.float32).reshape(-1, FEATURES), np.frombuffer(r.word, np.uint16), np.frombuffer(r.size, np.int64))
    return fit([read(r) for r in got[["x", "word", "size"]].itertuples(index=False, name="Row")], y)


def score(docs: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` (doc_id, text and any others) with a column ``name`` of scores; a column of this name is replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, long_ = np.zeros(b.num_rows), {}
            for lo, hi, data, offs, more in _text.word_pieces(b.column("text"), PIECE_WORDS):
                if "prior" in model:
                    out[lo:hi] = model["prior"]
                    continue
                got = passages(data, offs)
                if more:  # a piece of a long text: its passages join those of the pieces before
                    got = long_[lo] = joined([long_[lo], got])
                    got = got._replace(doc=np.zeros(len(got.x), np.int64))
                elif hi - lo == 1:
                    long_ = {lo: got}
                out[lo:hi] = sigmoid(forward(model, got, hi - lo)["s"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    return docs.mapInArrow(rows, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels, fit_docs))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
