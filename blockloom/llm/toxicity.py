"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is read in overlapping windows of WINDOW words, one every STRIDE words, over its whole length. A word enters as
the embedding of a learned vocabulary (unknown words share one) beside the mean of its hashed character trigrams. The
network is trained in numpy on document labels alone: a document scores as its most toxic window.

Rows: null, empty and blank texts are one window without words; long texts are read in overlapping pieces. Labels come from at
most FIT_DOCS toxic and twice as many other rows, and FIT_BYTES of text, outside the held-out fold; with labels of one class only, the score is the smoothed share of ones (0.5 without labels).
Repeated rows are scored once each. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._fit import Adam, held_out, labelled_sample, sigmoid
from ._runtime import prepare

WINDOW, STRIDE = 32, 16
#: Words of a long text that are read at a time; a multiple of STRIDE, so that the windows are those of the whole text.
PIECE_WORDS = 1 << 16
#: Toxic documents that the model is fitted on, at most; of others, twice as many.
FIT_DOCS = 1500
VOCABULARY = 4096
TRIGRAMS = 4096
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 6, 8, 8
#: Passes over the documents; few documents get smaller batches and more passes, for about as many steps.
EPOCHS, STEPS = 10, 400
_F = np.float32


def word_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, its distinct-word number, hashes of distinct words, their trigrams, first trigram of each)."""
    starts, ends, row = _text.words(data, offs)
    h = _text.span_hashes(data, starts, ends)
    uniq, first, number = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    # trigrams of " word ": as many as the word has bytes
    low = np.r_[np.uint8(32), _text.LOWER[data], np.uint8(32)].astype(np.uint32)
    size = e - s
    begin = np.cumsum(size) - size
    pos = np.repeat(s - begin, size) + np.arange(size.sum())
    head, tail = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    head[begin] = True
    tail[begin + size - 1] = True
    a, b, c = np.where(head, np.uint32(32), low[pos]), low[pos + 1], np.where(tail, np.uint32(32), low[pos + 2])
    tri = (a * np.uint32(2654435761) + b * np.uint32(2246822519) + c * np.uint32(3266489917)) >> np.uint32(20)
    return row, number.astype(np.int64), uniq, tri.astype(np.int64), begin


def windows(row: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each window, its words padded with -1 as (windows, WINDOW), windows of each row)."""
    counts = _text.counts_by_row(row, n)
    per = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(n), per)
    at = (np.arange(len(doc)) - (np.cumsum(per) - per)[doc]) * STRIDE
    first = np.cumsum(counts) - counts
    pos = at[:, None] + np.arange(WINDOW)
    ok = pos < counts[doc][:, None]
    ids = np.full(pos.shape, -1, np.int64)
    ids[ok] = number[(first[doc][:, None] + pos)[ok]]
    return doc, ids, per


def inputs(p: dict[str, np.ndarray], vocab: np.ndarray, uniq: np.ndarray, tri: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input of each distinct word and, last, of no word; its vocabulary number)."""
    at = np.minimum(np.searchsorted(vocab, uniq), len(vocab) - 1)
    known = np.where(vocab[at] == uniq, at, len(vocab)) if len(vocab) else np.zeros(len(uniq), np.int64)
    x = np.zeros((len(uniq) + 1, WORD_DIM + CHAR_DIM), _F)
    x[:-1, :WORD_DIM] = p["words"][known]
    if len(uniq):
        x[:-1, WORD_DIM:] = np.add.reduceat(p["chars"][tri], begin) / np.diff(np.append(begin, len(tri)))[:, None]
    return x, known


def recur(gates: np.ndarray, u: np.ndarray, ids: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """One direction: (hidden state at each word as (WINDOW, windows, HIDDEN), what the gradient needs)."""
    m = len(ids)
    out, past = np.zeros((WINDOW, m, HIDDEN), _F), []
    h = np.zeros((m, HIDDEN), _F)
    for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
        here = ids[:, t]
        g = gates[here]
        a = h @ u
        rz = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])))
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        live = (here >= 0)[:, None]
        new = np.where(live, new, h)
        if keep:
            past.append((t, h, r, z, n, a[:, 2 * HIDDEN :], live))
        h = out[t] = new
    return out, past


def network(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, keep: bool = False) -> dict:
    """Scores of windows (before the logistic), and what the gradient needs."""
    f, fp = recur(x @ p["Wf"] + p["bf"], p["Uf"], ids, False, keep)
    b, bp = recur(x @ p["Wb"] + p["bb"], p["Ub"], ids, True, keep)
    h = np.concatenate([f, b], 2)
    t = np.tanh(h @ p["A"])
    e = t @ p["a"]
    live = ids.T >= 0
    e = np.where(live, e, -1e9)
    w = np.exp(e - e.max(0))
    w = np.where(live, w, 0)
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * h).sum(0)
    return {"s": pooled @ p["c"] + p["d"], "pooled": pooled, "h": h, "t": t, "w": w, "past": (fp, bp)}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, known: np.ndarray, tri: np.ndarray, begin: np.ndarray, ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    o = network(p, x, ids, True)
    ds = ((sigmoid(o["s"]) - y) * (1 + y) / len(y)).astype(_F)  # a missed toxic window costs twice
    g = {"c": o["pooled"].T @ ds, "d": ds.sum(keepdims=True)}
    dpool = ds[:, None] * p["c"]
    dw = (o["h"] * dpool).sum(2)
    de = o["w"] * (dw - (o["w"] * dw).sum(0))
    dt = de[:, :, None] * p["a"] * (1 - o["t"] ** 2)
    g["a"] = (o["t"] * de[:, :, None]).sum((0, 1))
    g["A"] = np.einsum("tmh,tma->ha", o["h"], dt)
    dh_all = o["w"][:, :, None] * dpool + dt @ p["A"].T
    dx = np.zeros_like(x)
    for way, (u, w, b), past in (("f", ("Uf", "Wf", "bf"), o["past"][0]), ("b", ("Ub", "Wb", "bb"), o["past"][1])):
        part = dh_all[:, :, :HIDDEN] if way == "f" else dh_all[:, :, HIDDEN:]
        dh = np.zeros(part.shape[1:], _F)
        du = np.zeros_like(p[u])
        dgates = np.zeros((len(x), 3 * HIDDEN), _F)
        for t, before, r, z, n, an, live in reversed(past):
            dh = dh + part[t]
            on = np.where(live, dh, 0)
            dn = on * (1 - z) * (1 - n * n)
            dz = on * (before - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dg = np.concatenate([dr, dz, dn], 1)
            da = np.concatenate([dr, dz, dn * r], 1)
            du += before.T @ da
            np.add.at(dgates, ids[:, t], dg)
            dh = np.where(live, on * z, dh) + da @ p[u].T
        dgates[-1] = 0
        g[u], g[w], g[b] = du, x.T @ dgates, dgates.sum(0)
        dx += dgates @ p[w].T
    words, chars = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(words, known, dx[:-1, :WORD_DIM])
    size = np.diff(np.append(begin, len(tri)))
    np.add.at(chars, tri, np.repeat(dx[:-1, WORD_DIM:] / size[:, None], size, 0))
    return g | {"words": words, "chars": chars}


def fit(texts: list[str], y: np.ndarray, seed: int = 4) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    batch = 256 if len(y) >= 2000 else 32
    epochs = max(EPOCHS, min(4 * EPOCHS, STEPS * batch // max(1, len(y))))
    loaded = []
    for lo, hi, data, offs in _text.slices(pa.array(texts, pa.large_string())):  # bounded: FIT_BYTES in all
        row, number, uniq, tri, begin = word_table(data, offs)
        loaded.append((lo, hi, row, number, uniq, tri, begin))
    # vocabulary: words of at least 3 documents that tell the classes apart best; their log odds start the embedding
    pairs = [np.unique(np.stack([lo + row, number]), axis=1) for lo, hi, row, number, *_ in loaded]
    word = np.concatenate([x[4][q[1]] for x, q in zip(loaded, pairs, strict=True)])
    mark = np.concatenate([y[q[0]] for q in pairs])
    names, at = np.unique(word, return_inverse=True)
    ones, all_ = np.bincount(at, mark, len(names)), np.bincount(at, minlength=len(names))
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((all_ - ones + 0.5) / ((1 - y).sum() + 1))
    often = np.flatnonzero(all_ >= 3)
    weight = np.abs(odds[often]) * np.sqrt(all_[often])
    top = np.sort(often[np.lexsort((often, -weight))[:VOCABULARY]])
    vocab = names[top]
    d = 2 * HIDDEN
    p = {"words": rng.normal(0, 0.05, (len(vocab) + 1, WORD_DIM)), "chars": rng.normal(0, 0.1, (TRIGRAMS, CHAR_DIM)), "A": rng.normal(0, 0.3, (d, ATTEND)), "a": rng.normal(0, 0.3, ATTEND), "c": rng.normal(0, 0.3, d), "d": np.array([-1.0])}
    for w, u, b in (("Wf", "Uf", "bf"), ("Wb", "Ub", "bb")):
        p |= {w: rng.normal(0, 0.3, (WORD_DIM + CHAR_DIM, 3 * HIDDEN)), u: rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), b: np.zeros(3 * HIDDEN)}
    p["words"][:-1, 0] = np.clip(odds[top], -3, 6) / 2
    p = {k: v.astype(_F) for k, v in p.items()}
    adam = Adam(p, 0.01, 1e-5)
    cut = [(*x, *windows(x[2], x[3], x[1] - x[0])) for x in loaded]
    lead, latest = {}, {}
    for lo, _, _, _, uniq, _, _, doc, ids, _ in cut:
        k = np.minimum(np.searchsorted(vocab, uniq), max(0, len(vocab) - 1))
        o = np.append(np.where(vocab[k] == uniq, np.clip(odds[top][k], 0, 6), 0), 0) if len(vocab) else np.zeros(len(uniq) + 1)
        lead[lo] = o[ids].max(1)
    for epoch in range(epochs):
        adam.rate = 0.012 * (1 - epoch / epochs) + 0.001
        for lo, hi, row, number, uniq, tri, begin, doc, ids, per in cut:
            if epoch == 0:
                s = lead[lo]
            elif epoch % 2 == 0:
                s = latest[lo]
            else:
                x, _ = inputs(p, vocab, uniq, tri, begin)
                s = latest[lo] = np.concatenate([network(p, x, ids[i : i + 4096])["s"] for i in range(0, len(ids), 4096)])
            order = np.lexsort((-s, doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            yd = y[lo:hi]
            # the most toxic window of each document, and of clean ones two more
            use = order[(rank == 0) | ((rank < 3) & (yd[doc[order]] == 0))]
            use = rng.permutation(use)
            for i in range(0, len(use), batch):
                j = use[i : i + batch]
                need, new = np.unique(ids[j], return_inverse=True)
                new = new.reshape(len(j), WINDOW)
                if len(need) and need[0] < 0:
                    need, new = need[1:], new - 1
                size = np.diff(np.append(begin, len(tri)))[need]
                b = np.cumsum(size) - size
                tr = tri[np.repeat(begin[need] - b, size) + np.arange(size.sum())]
                x, known = inputs(p, vocab, uniq[need], tr, b)
                adam.step(gradients(p, x, known, tr, b, new, yd[doc[j]]))
    return p | {"vocab": vocab}


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, seed: int = 31) -> dict[str, np.ndarray]:
    prepare(docs.sparkSession)
    got = labelled_sample(docs, labels, "toxic", fit_docs, 5, 0, seed, per_class=True).toPandas()
    got["text"] = got["text"].fillna("")
    got = got.sort_values(["doc_id", "text"], kind="stable")
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return {"prior": np.array((y.sum() + 1) / (len(y) + 2))}
    return fit(got["text"].tolist(), y)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score of each row: the logistic of its most toxic window."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, data, offs, more in _text.word_pieces(b.column("text"), PIECE_WORDS, WINDOW - STRIDE, 1 << 20):
                if "prior" in model:
                    out[lo:hi] = model["prior"]
                    continue
                row, number, uniq, tri, begin = word_table(data, offs)
                x, _ = inputs(model, model["vocab"], uniq, tri, begin)
                doc, ids, per = windows(row, number, hi - lo)
                s = np.concatenate([network(model, x, ids[i : i + 4096])["s"] for i in range(0, len(ids), 4096)])
                top = sigmoid(np.maximum.reduceat(s, np.cumsum(per) - per))
                out[lo:hi] = np.maximum(out[lo:hi], top) if more else top
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    out = score(docs, train(docs, labels, fit_docs))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
