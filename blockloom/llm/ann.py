"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt into shards of bounded size. In each shard, greedy searches over the growing graph propose a
node's neighbours and relaxed distance pruning keeps diverse ones; a beam search answers queries in every shard and
the best of all shards are merged. For inner products, vectors get one more coordinate that makes all norms equal, so
that the nearest by distance is the largest product.

Rows: null, empty, zero, null-holding and non-finite vectors take no part, nor do null ids and vectors of another dimension
than the most common one. Identical vectors of different ids share a graph node and are all returned; of equal scores the
smaller id comes first. Rows that repeat an id and its vector are one row; where an id has several vectors, each can be
found, and the smallest by its bytes asks. A query never finds rows of its own id. Extra columns don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import Scratch
from ._vectors import clean_vectors, dtype_of

SHARD = 4096
#: Queries of one packed row, and rows of them that visit a shard together: a shard is sent once for each so many.
QUERY_BLOCK, VISIT = 1024, 32
DEGREE = 32
BEAM = 96
#: Relaxation of the pruning: an edge goes only if a kept neighbour is this much nearer to its end.
ALPHA = 1.2
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``width`` nearest found of each query, nearest first; -1 pads."""
    m, n = len(q), len(x)
    width = max(width, len(entries))
    ids = np.full((m, width), -1, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    seen = np.zeros((m, n), bool)
    e = len(entries)
    ids[:, :e] = entries
    dist[:, :e] = ((q[:, None, :] - x[entries][None]) ** 2).sum(2)
    open_[:, :e] = True
    seen[:, entries] = True
    live = np.arange(m)
    while len(live):
        d = np.where(open_[live], dist[live], np.inf)
        at = d.argmin(1)
        ok = np.isfinite(d[np.arange(len(live)), at])
        live, at = live[ok], at[ok]
        if not len(live):
            break
        open_[live, at] = False
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        dn = np.full(near.shape, np.inf, np.float32)
        diff = x[near[r, c]] - q[live[r]]
        dn[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_d = np.concatenate([dist[live], dn], 1)
        best = np.argpartition(all_d, width - 1, 1)[:, :width]
        row = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)[row, best]
        open_[live] = np.concatenate([open_[live], fresh], 1)[row, best]
        dist[live] = all_d[row, best]
    order = dist.argsort(1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (-1 pads) keep the nearest, drop those it covers, and so on: (nodes, degree), -1 pads."""
    d = ((x[cand] - x[nodes][:, None]) ** 2).sum(2)
    d[(cand < 0) | (cand == nodes[:, None])] = np.inf
    order = d.argsort(1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    d[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
    out = np.full((len(nodes), degree), -1, np.int64)
    row = np.arange(len(nodes))
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[row, best])
        if not ok.any():
            break
        pick = cand[row, best]
        out[ok, k] = pick[ok]
        between = ((x[cand] - x[pick][:, None]) ** 2).sum(2)
        d[alpha * alpha * between <= d] = np.inf
        d[row, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry points): nodes join in seeded batches, each searched for in the graph so far."""
    n = len(x)
    slack = degree + degree // 2
    graph = np.full((n, slack), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[start], order[order != start]])
    entries = np.array([start])
    done = 1
    while done < n:
        new = order[done : done + min(BATCH, done)]
        found, _ = beam_search(x, graph, entries, x[new], width)
        mates = np.tile(new[: min(len(new), 64)], (len(new), 1))  # those of its batch it couldn't find yet
        graph[new, :degree] = robust_prune(x, new, np.concatenate([found, mates], 1), degree, alpha)
        src = np.repeat(new, degree)
        dst = graph[new, :degree].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = dst.argsort(kind="stable")
        src, dst = src[by], dst[by]
        ends = np.flatnonzero(np.r_[dst[1:] != dst[:-1], True]) + 1
        full, lists, s = [], [], 0
        for e in ends:
            v = dst[s]
            have = graph[v][graph[v] >= 0]
            want = np.unique(np.concatenate([have, src[s:e]]))
            if len(want) > slack:
                full.append(v)
                lists.append(want)
            else:
                graph[v] = -1
                graph[v, : len(want)] = want
            s = e
        if full:
            cand = np.full((len(full), max(map(len, lists))), -1, np.int64)
            for i, w in enumerate(lists):
                cand[i, : len(w)] = w
            for s in range(0, len(full), BATCH):
                v = np.array(full[s : s + BATCH])
                graph[v] = -1
                graph[v, :degree] = robust_prune(x, v, cand[s : s + BATCH], degree, alpha)
        done += len(new)
    reached = np.zeros(n, bool)
    front = entries
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~reached[front]]
        if reached.all():
            return graph, entries
        front = np.flatnonzero(~reached)[:1]
        entries = np.concatenate([entries, front])


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = dtype_of(vectors, vec_col)
    usable = scratch.keep(clean_vectors(vectors.filter(F.col(id_col).isNotNull()), id_col, vec_col))
    dims = usable.groupBy(F.octet_length("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    usable = usable.filter(F.octet_length("vec") == dims["dim"])
    if not usable.groupBy("vec_id").count().filter("count > 1").isEmpty():
        usable = scratch.keep(usable.dropDuplicates(["vec_id", "vec"]))
    shards = max(1, -(-dims["count"] // SHARD))

    def norm2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1).astype(np.float64)
                yield pd.DataFrame({"n2": [(x * x).sum(1).max()]})

    top = usable.select("vec").mapInPandas(norm2, "n2 double").agg(F.max("n2")).first()[0]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec", "vec_id"], kind="stable", ignore_index=True)
        first = (pdf["vec"] != pdf["vec"].shift()).to_numpy()
        raw = np.frombuffer(b"".join(pdf["vec"][first]), kind).reshape(int(first.sum()), -1)
        x = raw.astype(np.float64)
        scale = 1 / np.sqrt(top)
        x = np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1) * scale
        graph, entries = build_graph(x.astype(np.float32), degree, width, alpha, seed)
        ids, begin = pdf["vec_id"].to_numpy(np.int64), np.r_[np.flatnonzero(first), len(pdf)]
        return pd.DataFrame({"shard": [key[0]], "ids": [ids.tobytes()], "begin": [begin.astype(np.int64).tobytes()], "raw": [raw.tobytes()], "x": [x.astype(np.float32).tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entries": [entries.astype(np.int64).tobytes()]})

    index = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, ids binary, begin binary, raw binary, x binary, graph binary, entries binary")
    index = scratch.keep(index)
    asked = usable.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q": [b"".join(pdf["vec"])]})

    packed = scratch.keep(asked.groupBy("block").applyInPandas(pack, "block long, qids binary, q binary"))
    # Every query visits every shard, in packed rows; a shard is sent once for VISIT of them.
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("round", upto(-(-blocks // VISIT)))
    right = packed.withColumn("round", F.floor(F.col("block") / VISIT)).withColumn("shard", upto(shards))

    def visit(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for r in shard.to_pylist():
            ids, begin = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["begin"], np.int64)
            n = len(begin) - 1
            raw, x = np.frombuffer(r["raw"], kind).reshape(n, -1).astype(np.float64), np.frombuffer(r["x"], np.float32).reshape(n, -1)
            graph, entries = np.frombuffer(r["graph"], np.int32).reshape(n, -1).astype(np.int64), np.frombuffer(r["entries"], np.int64)
            for qids, q in zip(queries.column("qids"), queries.column("q"), strict=True):
                qids, q = np.frombuffer(qids.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), kind).reshape(-1, raw.shape[1]).astype(np.float64)
                for s in range(0, len(q), BATCH):
                    part = np.concatenate([q[s : s + BATCH] / np.sqrt(top), np.zeros((len(q[s : s + BATCH]), 1))], 1).astype(np.float32)
                    found, _ = beam_search(x, graph, entries, part, width)
                    out += [nearest(qids[s + i], q[s + i], row[row >= 0], ids, begin, raw) for i, row in enumerate(found)]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    def nearest(query: int, q: np.ndarray, hit: np.ndarray, ids: np.ndarray, begin: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # copies beyond k + 1 can't be among the k, as ties go to the smaller id
        members = [ids[begin[h] : min(begin[h + 1], begin[h] + k + 1)] for h in hit]
        vid, score = np.concatenate([ids[:0], *members]), np.repeat((raw[hit] * q).sum(1), [len(m) for m in members])
        own = vid != query
        best = np.lexsort((vid[own], -score[own]))[:k]
        return np.full(len(best), query), vid[own][best], score[own][best]

    found = left.groupBy("shard", "round").cogroup(right.groupBy("shard", "round")).applyInArrow(visit, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
