"""Near-duplicate embeddings by random-hyperplane sign hashing.

Several tables of sign bits propose candidates, exact cosines in double precision decide, and distributed
connected components name the groups. Identical vectors of a label are one class, so copies cost no pairs. A
bucket is compared in blocks of bounded size, however many rows it holds, and emits only per-vector link counts and a
spanning forest.

Rows: only equal, non-null labels are compared. Null, empty, zero and null-holding or non-finite vectors link with
nothing, nor do vectors of different dimensions, nor rows without an id. Rows that repeat a vec_id count as vectors of their own with a
shared result row each. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Scratch
from ._vectors import clean_vectors, dtype_of
from .components import connected_components

#: Chance to miss a link that is exactly at the threshold; nearer links are missed less.
MISS = 1e-6
#: Vectors of one side of a comparison block.
BLOCK = 1024


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table, tables): buckets of about 128 vectors, tables enough for the miss rate."""
    bits = max(2, min(30, round(math.log2(max(n, 1) / 128)) if n > 128 else 2))  # 30: keys are whole numbers of 32 bits
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - hit))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of n nodes."""
    at = np.arange(n)
    while True:
        new = at.copy()
        np.minimum.at(new, a, at[b])
        np.minimum.at(new, b, at[a])
        new = np.minimum(new, new[new])
        if (new == at).all():
            return at
        at = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    scratch = Scratch(vectors.sparkSession)
    kind = dtype_of(vectors, vec_col)
    usable = scratch.keep(clean_vectors(vectors.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()), id_col, vec_col, label_col))
    classes = scratch.keep(usable.groupBy("label", "vec").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, threshold)

    def hashed(batches):
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            out = []
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                x = np.frombuffer(b"".join(part["vec"]), kind).reshape(len(part), -1).astype(np.float64)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((x.shape[1], tables * bits))
                sign = (x @ planes[dim] > 0).reshape(len(part), tables, bits)
                keys = (sign @ (1 << np.arange(bits))).astype(np.int32)
                m = len(part)
                out.append(pd.DataFrame({
                    "label": np.repeat(part["label"].to_numpy(), tables), "dim": np.int32(x.shape[1]), "t": np.tile(np.arange(tables, dtype=np.int32), m), "key": keys.ravel(),
                    "cid": np.repeat(part["cid"].to_numpy(), tables), "n": np.repeat(part["n"].to_numpy(), tables),
                    "vec": np.repeat(part["vec"].to_numpy(), tables), "keys": np.repeat(np.array([k.tobytes() for k in keys], object), tables),
                }))
            for x in out:
                yield x

    bucket = ["label", "dim", "t", "key"]
    dealt = classes.mapInPandas(hashed, "label string, dim int, t int, key int, cid long, n long, vec binary, keys binary")
    large = scratch.keep(dealt.groupBy(*bucket).count().filter(F.col("count") > BLOCK).select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = dealt.join(large, bucket, "left").fillna(1, ["blocks"])
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}).drop("blocks", "other")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, lo, hi = key[2], key[-2], key[-1]
        none = pd.DataFrame({"cid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if len(pdf) < 2:
            return none
        pdf = pdf.sort_values("cid", kind="stable", ignore_index=True)
        x = np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1).astype(np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        keys = np.frombuffer(b"".join(pdf["keys"]), np.int32).reshape(len(pdf), -1)
        blk, n = pdf["blk"].to_numpy(), pdf["n"].to_numpy()
        first, second = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        a, b = [], []
        for s in range(0, len(first), 256):
            i, j = np.nonzero(x[first[s : s + 256]] @ x[second].T >= threshold)
            i, j = first[s : s + 256][i], second[j]
            ok = (i < j) if lo == hi else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            for e in range(0, len(i), 65536):
                p, q = i[e : e + 65536], j[e : e + 65536]
                new = ~(keys[p, :t] == keys[q, :t]).any(1)  # else an earlier table has counted it
                a.append(p[new])
                b.append(q[new])
        a, b = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (a, b))
        if not len(a):
            return none
        links = np.bincount(a, n[b], len(pdf)) + np.bincount(b, n[a], len(pdf))
        at = roots(len(pdf), a, b)
        hit = np.flatnonzero(links)
        cid = pdf["cid"].to_numpy()
        return pd.DataFrame({"cid": cid[hit], "links": links[hit].astype(np.int64), "root": cid[at[hit]]})

    found = scratch.keep(dealt.groupBy(*bucket, "lo", "hi").applyInPandas(compare, "cid long, links long, root long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    result = classes.join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    result = result.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    members = usable.join(result, ["label", "vec"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return rows.join(members, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")
    )
