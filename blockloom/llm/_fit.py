"""Bounded, hash-ordered samples of labelled documents, and small numpy pieces that models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import crc_mod


def held_out(m: int, remainder: int):
    return F.coalesce(crc_mod("doc_id", m) == remainder, F.lit(False))


#: Bytes of texts that a model is fitted on, at most.
FIT_BYTES = 48 << 20


def bounded_rows(docs: DataFrame, picked: DataFrame, order, most: int, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, and what ``picked`` says) of at most ``most`` rows and ``most_bytes`` bytes of text; null texts are empty.

    ``picked`` has at most ``most`` ids. Of the rows that repeat an id, the smallest text is taken. Documents are taken in
    ``order`` as long as they fit; one that alone is larger is left out. Bounded numbers come to the driver, no texts.
    """
    others = [c for c in picked.columns if c != "doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", *others).agg(F.min("text").alias("text"))
    sizes = rows.select("doc_id", F.octet_length("text").alias("n"), order.alias("k")).orderBy("k", "doc_id").limit(most).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["n"] <= most_bytes:
            taken.append((r["doc_id"],))
            total += r["n"]
    if len(taken) == len(sizes):
        return rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, rows.select("doc_id").schema)), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, m: int, remainder: int, seed: int = 23, per_class: bool = False) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows (if per_class: ``most`` ones and twice as many zeros) outside the held-out fold.

    Rows come in the order of a seeded hash of the id, up to FIT_BYTES of text. A document labelled more than once counts once,
    with its largest label; null labels and ids don't count.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    fold = named.filter(crc_mod("doc_id", m) != remainder)
    order = F.xxhash64(F.lit(seed), "doc_id")
    if per_class:
        picked = fold.filter("y = 1").orderBy(order, "doc_id").limit(most).unionByName(fold.filter("y = 0").orderBy(order, "doc_id").limit(2 * most))
    else:
        picked = fold.orderBy(order, "doc_id").limit(most)
    return bounded_rows(docs, picked, order, 3 * most if per_class else most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4) -> None:
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
