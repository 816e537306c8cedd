"""Graph search and embedding dedup against brute force, with odd rows."""

import numpy as np
import pytest

from blockloom.llm import ann, embed_dedup
from tests.llm.conftest import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n=600, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, 16))
    x *= rng.uniform(0.5, 2, (n, 1))
    x[50:80] = x[50]  # copies
    x[100:130] = x[100] + 0.01 * rng.normal(size=(30, 16))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = made()
    rows = [(i, [float(v) for v in r], i % 4 if i % 9 else None) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] + [1.0] * 15, 1), (1005, [1.0, 2.0], 1), (1020, None, 2), (None, [1.0] * 16, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("shard, block, visit", [(4096, 1024, 32), (100, 7, 2)])
def test_search_recall_and_scores(vectors, monkeypatch, shard, block, visit):
    """One shard; several of them, visited by several rows of queries."""
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    monkeypatch.setattr(ann, "VISIT", visit)
    x = made().astype(float)
    got = ann.search(clashing(vectors)).toPandas()
    asked = [i for i in range(600) if i % 20 == 0]
    assert sorted(got.query_id.unique()) == asked and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        part = part.sort_values("rank")
        hits += len(set(best) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21))
        assert np.allclose(part.score, s[part.vec_id]) and part.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == part.vec_id.tolist()
    assert hits / (20 * len(asked)) >= 0.95


def test_search_of_little(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(few).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_of_repeated_ids_and_ties(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [2.0, 0.0], 0), (5, [2.0, 1.0], 0), (5, [2.0, 1.0], 0), (6, [2.0, 3.0], 0), (6, [9.0, 3.0], 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(20, 1, 6, 9.0), (20, 2, 4, 2.0), (20, 3, 5, 2.0), (20, 4, 6, 2.0), (20, 5, 3, 1.0)]


def test_every_node_can_be_reached():
    x = made(500, 4)
    graph, entries = ann.build_graph(x)
    found, _ = ann.beam_search(x, graph, entries, x[:64], 500)
    assert all(set(row[row >= 0]) == set(range(500)) for row in found)


def brute(rows, threshold):
    use = [(i, np.array(v, float), lab) for i, v, lab in rows]
    links = {i: set() for i, *_ in use}
    for i, v, lab in use:
        for j, w, other in use:
            if i < j and lab is not None and lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                for k in links[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            out.update(dict.fromkeys(seen, i))
    return {i: (len(links[i]), out[i], out[i] == i) for i in links}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(vectors, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)  # 16: buckets are compared in several blocks
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(clashing(vectors)).collect()}
    want = brute([(i, r, i % 4 if i % 9 else None) for i, r in enumerate(made())], 0.93)
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1020)) and got[None] == (0, None, True)


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
