"""Mixing and packing against direct versions; the pipeline from end to end."""

import importlib
import random
from collections import defaultdict
from collections.abc import Mapping

import pytest
from pyspark.sql import functions as F

from blockloom.llm import mixing, packing
from blockloom.llm.mixing import LEAF, Mix, mix_sources
from blockloom.llm.queries import TARGETS
from tests.llm.conftest import DOC, clashing, corpus


def solve(supply: Mapping[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], float]:
    """Tokens granted to each leaf, one node of the tree after the other."""
    room: dict[tuple[str, ...], float] = {}
    tokens: dict[tuple[str, ...], float] = {}
    below: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for leaf, n in supply.items():
        for d in range(len(leaf) + 1):
            room[leaf[:d]] = room.get(leaf[:d], 0) + n * mix.max_epochs
            tokens[leaf[:d]] = tokens.get(leaf[:d], 0) + n
            if d:
                below.setdefault(leaf[: d - 1], set()).add(leaf[:d])
    granted: dict[tuple[str, ...], float] = {}

    def grant(node: tuple[str, ...], budget: float) -> None:
        if node in supply:
            granted[node] = min(budget, room[node])
            return
        open_, left, share = sorted(below[node]), min(budget, room[node]), {}
        heft = {}
        named = [k for k in open_ if k in mix.weights]
        rest = sum(tokens[k] for k in open_ if k not in mix.weights)
        spare, scale = 1.0 - sum(w for k, w in mix.weights.items() if k[:-1] == node), 1.0
        if spare < 1e-9:  # the weights leave nothing: children without one keep their natural share, the others split the rest
            spare = rest / tokens[node] if tokens[node] else 0.0
            scale = (1.0 - spare) / (sum(mix.weights[k] for k in named) or 1.0)
        for k in open_:
            heft[k] = scale * mix.weights[k] if k in mix.weights else (spare if named else 1.0) * (tokens[k] / rest if rest else 0.0)
        while open_:
            total = sum(heft[k] for k in open_)
            if total <= 0:
                heft.update({k: float(room[k]) for k in open_})
                total = sum(heft[k] for k in open_)
                if total <= 0:
                    share.update(dict.fromkeys(open_, 0.0))
                    break
            full = [k for k in open_ if room[k] <= left * heft[k] / total]
            if not full:
                share.update({k: left * heft[k] / total for k in open_})
                break
            for k in full:
                share[k] = float(room[k])
            left = max(0.0, left - sum(room[k] for k in full))
            open_ = [k for k in open_ if k not in full]
        for k, b in share.items():
            grant(k, b)

    if supply:
        grant((), mix.budget if mix.budget is not None else mix.budget_fraction * tokens[()])
    return granted


def granted(spark, supply, mix):
    """What the plan grants, which must be what the direct version grants."""
    leaves = spark.createDataFrame([(*k, n) for k, n in supply.items()], ", ".join(f"{c} string" for c in LEAF) + ", tokens long")
    got = {tuple(r[c] for c in LEAF): r.granted for r in mixing.budgets(leaves, mix).collect()}
    want = solve(supply, mix)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    return got


def test_a_hand_worked_tree(spark):
    """Half to each domain; w's a is short of 30, which b takes; k is short of 10, which goes to w: 5 to each language."""
    supply = {("w", "en", "a"): 10, ("w", "en", "b"): 200, ("w", "de", "c"): 200, ("k", "en", "d"): 90}
    weights = {("w",): 0.5, ("k",): 0.5, ("w", "en"): 0.5, ("w", "de"): 0.5, ("w", "en", "a"): 0.8, ("w", "en", "b"): 0.2}
    assert granted(spark, supply, Mix(weights, budget=200)) == pytest.approx({("w", "en", "a"): 10, ("w", "en", "b"): 45, ("w", "de", "c"): 55, ("k", "en", "d"): 90})
    rows = [(i, "t " * 10, "en", "a", 0) for i in range(1)] + [(100 + i, "t " * 10, "en", "b", 0) for i in range(20)] + [(200 + i, "t " * 10, "de", "c", 0) for i in range(20)] + [(300 + i, "t " * 10, "en", "d", 0) for i in range(9)]
    domain = lambda s: F.when(s == "d", "k").otherwise("w")
    taken = defaultdict(int)
    for r in mix_sources(spark.createDataFrame(rows, DOC), Mix(weights, budget=200, domain=domain)).collect():
        taken[r.source] += r._copies * r._tokens
    assert taken == {"a": 10, "b": 40, "c": 50, "d": 90}  # whole documents of ten tokens


def test_random_trees(spark):
    rng = random.Random(9)
    for _ in range(6):
        supply = {(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{k}"): rng.choice([0, 5, 40, 300]) for k in range(14)}
        nodes = {k[:n] for k in supply for n in (1, 2, 3)} | {("gone",), ("d0", "gone")}
        weights = {k: rng.choice([0.0, 0.1, 0.3, 0.5]) for k in nodes if rng.random() < 0.5}
        granted(spark, supply, Mix(weights, budget_fraction=rng.choice([0.2, 0.8, 1.5]), max_epochs=rng.choice([1, 2])))


def test_shortages_go_to_siblings_before_ancestors(spark):
    supply = {("w", "en", "a"): 10, ("w", "en", "b"): 100, ("w", "de", "c"): 100, ("k", "en", "d"): 100}
    even = {("w",): 0.5, ("k",): 0.5, ("w", "en"): 0.5, ("w", "de"): 0.5, ("w", "en", "a"): 0.5, ("w", "en", "b"): 0.5}
    got = granted(spark, supply, Mix(even, budget=160))
    assert got == pytest.approx({("w", "en", "a"): 10, ("w", "en", "b"): 30, ("w", "de", "c"): 40, ("k", "en", "d"): 80})
    got = granted(spark, supply, Mix(even, budget=260))  # k is short of 30, which goes to w
    assert got[("k", "en", "d")] == 100 and sum(got.values()) == pytest.approx(260) and got[("w", "de", "c")] == 80
    assert sum(granted(spark, supply, Mix(even, budget=9999)).values()) == 310 and granted(spark, {}, Mix()) == {}
    assert sum(granted(spark, supply, Mix(even, budget=600, max_epochs=3)).values()) == pytest.approx(600)


def test_weights_that_add_up_to_one_leave_the_others_their_share(spark):
    supply = {("web", "en", "src1"): 500, ("books", "en", "src9"): 300, ("forums", "en", "src15"): 150, ("other", "en", "odd"): 30, ("other", "unknown", "unknown"): 20}
    got = granted(spark, supply, Mix(TARGETS, budget_fraction=0.8, max_epochs=2))
    assert got[("other", "en", "odd")] + got[("other", "unknown", "unknown")] == pytest.approx(40) and sum(got.values()) == pytest.approx(800)
    assert got[("web", "en", "src1")] == pytest.approx(380) and got[("books", "en", "src9")] == pytest.approx(228)
    got = granted(spark, {k: n for k, n in supply.items() if k[0] != "books"}, Mix(TARGETS, budget=350))  # nor do weights of what isn't there
    assert got[("other", "en", "odd")] == pytest.approx(350 * 30 / 700)
    rows = [(i, "a b c d", "en", ["src1", "src9", "src15", "odd", None][i % 5], 7) for i in range(500)]
    copies = defaultdict(int)
    for r in mix_sources(spark.createDataFrame(rows, DOC), Mix(TARGETS, budget_fraction=0.5)).collect():
        copies[r.source] += r._copies
    assert copies["odd"] == copies[None] == 50


@pytest.mark.parametrize("epochs, share, bucket", [(1, 0.5, 1000), (1, 0.7, 3), (3, 1.8, 2)])
def test_selection_is_a_prefix_of_the_seeded_order(docs, monkeypatch, epochs, share, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    mix = Mix({("web",): 0.6}, budget_fraction=share, max_epochs=epochs, seed=3)
    rows = mix_sources(clashing(docs), mix).collect()
    assert len(rows) == len(corpus())
    supply, members = defaultdict(int), defaultdict(list)
    for r in rows:
        leaf = (r._domain, r._lang, r._source)
        supply[leaf] += r._tokens
        members[leaf].append(r)
    given = solve(supply, mix)
    for leaf, own in members.items():
        b, s = int(given[leaf] + 1e-6), supply[leaf]
        full = min(epochs, b // s) if s else epochs
        rest = b - full * s if full < epochs else 0
        keys = {r.doc_id: k for r, k in zip(own, _keys(docs, own, mix.seed, full))}
        total = 0
        for r in sorted(own, key=lambda r: (keys[r.doc_id], r.doc_id)):
            total += r._tokens
            assert r._copies == full + (rest > 0 and total <= rest), (leaf, r.doc_id)


def _keys(docs, own, seed, full):
    spark = docs.sparkSession
    df = spark.createDataFrame([(i, r.doc_id) for i, r in enumerate(own)], "i int, d long")
    return [r.k for r in df.select("i", F.xxhash64(F.lit(seed), F.lit(int(full)).cast("int"), F.col("d")).alias("k")).orderBy("i").collect()]


def test_mix_of_odd_rows(spark):
    assert mix_sources(spark.createDataFrame([], DOC), Mix()).count() == 0
    rows = [(None, "a b", None, None, 0), (None, "a b", None, None, 0), (4, None, "en", "src1", 0), (5, "", "en", "src1", 0)]
    assert mix_sources(spark.createDataFrame(rows, DOC), Mix(budget_fraction=1.0)).count() == 4


def test_pack_is_best_fit_and_downsized():
    place, final = packing.pack([300, 200, 700, 60, 60], (512, 1024), 0)
    fill = defaultdict(list)
    for (b, o), n in zip(place, [300, 200, 700, 60, 60]):
        fill[b].append((o, n))
    for b, parts in fill.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == o for (a, n), (o, _) in zip(parts, parts[1:]))
        used = sum(n for _, n in parts)
        assert final[b] == min(c for c in (512, 1024) if c >= used)
    assert sorted(final) == [512, 1024]
    rng = random.Random(1)
    many = [rng.randrange(1, 4097) for _ in range(3000)]
    _, final = packing.pack(many)
    assert sum(many) / sum(final) > 0.97


def test_pack_documents(docs, spark):
    out = packing.pack_documents(clashing(docs), (64, 128, 256)).toPandas()
    want = {i: len((t or "").split()) for i, t in corpus()}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want
    placed = out.dropna(subset=["bin_id"])
    used = placed.groupby(["bin_id", "bin_length"]).n_tokens.sum().reset_index()
    assert used.bin_id.is_unique and (used.n_tokens <= used.bin_length).all() and set(used.bin_length) <= {64, 128, 256}
    for _, part in placed.sort_values("bin_offset").groupby("bin_id"):
        assert part.bin_offset.tolist() == [0, *part.n_tokens.cumsum().tolist()[:-1]]
    assert out[out.n_tokens == 0].bin_id.isna().all()
    assert packing.pack_documents(spark.createDataFrame([], DOC)).count() == 0
    big = 2**62 + 1
    odd = packing.pack_documents(spark.createDataFrame([(None, "a", "", "", 0), (big, "b", "", "", 0), (big, "b", "", "", 0)], DOC)).collect()
    assert sorted(r.doc_id or 0 for r in odd) == [0, big, big]


def directly(lengths, permitted, cost):
    """Best fit as it reads: bins as a list, every choice looked for among all."""
    waiting = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, touched = [], 0  # [length, filled, when it was last touched]
    place = {}
    while waiting:
        i, *waiting = waiting
        n = lengths[i]
        fits = [b for b in bins if b[0] - b[1] >= n]
        touched += 1
        if fits:
            b = min(fits, key=lambda b: (b[0] - b[1], -b[2]))
        else:
            def price(c):
                room = c - n
                for j in waiting:  # longest first
                    room -= lengths[j] if lengths[j] <= room else 0
                return (c + cost) / (c - room), -c

            b = [min((c for c in permitted if c >= n), key=price), 0, 0]
            bins.append(b)
        place[i] = (bins.index(b), b[1])
        b[1], b[2] = b[1] + n, touched
    return [place[i] for i in range(len(lengths))], [min(c for c in permitted if c >= b[1]) for b in bins]


@pytest.mark.parametrize("seed", range(25))
def test_pack_against_a_direct_version(seed):
    rng = random.Random(seed)
    permitted, cost = rng.choice([((8, 16), 1), ((10, 25, 60), 3), ((64,), 16), ((5, 6, 7, 50), 0)])
    lengths = [rng.randrange(1, max(permitted) + 1) if rng.random() < 0.5 else rng.randrange(1, 6) for _ in range(rng.randrange(1, 60))]
    place, final = packing.pack(lengths, permitted, cost)
    want_place, want_final = directly(lengths, permitted, cost)
    assert final == want_final and place == want_place


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in corpus()]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_text", "mixture", "packing"] and pipeline.ORACLE_SQL is None
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    kept = pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2} <= ids and not ids & {40, 43, 46}  # exact copies of 0, 1 and 2


def removed_texts(rows, length=100):
    """Of (id, text) in order: what is left of each."""
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"x" * length
            seen.add(raw[k : k + length])
        out[i] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline_stages_against_direct_versions(spark, tmp_path):
    from tests.llm.test_text_dedup import components

    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in corpus()]
    docs = clashing(spark.createDataFrame(rows, DOC))
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in components(corpus()).items() if c == i}
    left = {r.doc_id: r for r in pipeline.repeated_text_stage(spark, docs, "").collect()}
    want = removed_texts(sorted(corpus()))
    assert {i: r.text for i, r in left.items()} == want and all(r.n_chars == len(r.text) and r._doc == "_doc" for r in left.values())
    mixed = pipeline.mixture_stage(spark, docs, "").collect()
    supply, taken = defaultdict(int), defaultdict(int)
    for i, t, lang, source, _ in rows:
        leaf = ({0: "web", 1: "books", 2: "forums"}[min(2, int(source[3:]) // 7)], lang, source)
        supply[leaf] += len((t or "").split())
        taken[leaf] += len((t or "").split()) if i in {r.doc_id for r in mixed} else 0
    given = solve(supply, Mix(TARGETS, budget_fraction=pipeline.BUDGET))
    assert all(taken[k] <= given[k] + 1e-6 for k in supply) and all(r._tokens == "_tokens" for r in mixed)
    packed = pipeline.packing_stage(spark, docs, "").collect()
    assert sum(r.n_tokens for r in packed) == sum(supply.values())


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, nulls in every column, columns named like what operators add."""
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_ = " ".join(f"w{i}" for i in range(40))
    odd = [(None, None, None, None, None), (None, long_, None, None, None), (5, long_, "en", "src1", 1), (5, "other words", "en", "src1", 1), (7, "", None, None, 0), (7, "", None, None, 0)]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], DOC), str(tmp_path)).count() == 0, name
        docs = clashing(spark.createDataFrame(odd, DOC)).withColumn("_score", F.lit(7.0)).withColumn("_domain", F.lit("mine"))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert 0 < len(got) <= len(odd) and all(r._score == 7.0 and r._domain == "mine" and r.score == "score" for r in got), name
    assert pipeline.packing_stage(spark, spark.createDataFrame([], DOC), "").count() == 0
    assert pipeline.packing_stage(spark, clashing(spark.createDataFrame(odd, DOC)), "").count() == 6
    two = pipeline.near_duplicate_stage(spark, spark.createDataFrame(odd, DOC), "").collect()
    assert sorted((r.doc_id is None, r.text or "") for r in two) == sorted([(True, ""), (True, long_), (False, long_), (False, "other words"), (False, ""), (False, "")])
