"""Katz backoff exactly; language, toxicity and quality by held-out accuracy; odd rows for each."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockloom.llm import katz, langid, quality, toxicity
from tests.llm.conftest import DOC, clashing, corpus

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def tokens(text):
    return [*SPLIT.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())), "end"]


class Model:
    def __init__(self, texts):
        self.one, self.two, self.seen = Counter(), Counter(), defaultdict(set)
        for t in texts:
            self.one.update(t)
            for h, w in zip(["begin", *t[:-1]], t):
                self.two[h, w] += 1
                self.seen[h].add(w)
        self.n = sum(self.one.values())
        coc = lambda c: katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.DISCOUNTED + 2)])
        self.d1, self.d2 = coc(self.one), coc(self.two)
        self.heads = Counter()
        for (h, _), r in self.two.items():
            self.heads[h] += r
        self.left = 1 - sum(self.cut(self.d1, r) for r in self.one.values()) / self.n

    @staticmethod
    def cut(d, r):
        return d[min(r, len(d) - 1)] * r

    def p1(self, w):
        return self.cut(self.d1, self.one[w]) / self.n if w in self.one else self.left

    def p2(self, w, h):
        if (h, w) in self.two:
            return self.cut(self.d2, self.two[h, w]) / self.heads[h]
        return self.alpha(h) * self.p1(w)

    def alpha(self, h):
        if h not in self.heads:
            return 1.0
        return (1 - sum(self.cut(self.d2, self.two[h, w]) for w in self.seen[h]) / self.heads[h]) / (1 - sum(map(self.p1, self.seen[h])))


def test_katz_scores(docs):
    rows = corpus()
    model = Model([tokens(t) for i, t in rows if crc(i, 7) != 2])
    types = len(model.one)
    got = {r.doc_id: r for r in katz.score_documents(clashing(docs)).collect()}
    for i, t in rows:
        w, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(w), sum(x in model.one for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.one[x] + 1) / (model.n + types + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(model.p2(x, h)) for h, x in zip(["begin", *w[:-1]], w)))


def test_katz_contexts_add_up_to_one():
    model = Model([tokens(t) for _, t in corpus()])
    for h in ["begin", *list(model.heads)[:40]]:
        assert sum(model.p2(w, h) for w in [*model.one, "unknown"]) == pytest.approx(1.0)


def test_katz_odd_tables(spark):
    assert katz.score_documents(spark.createDataFrame([], DOC)).count() == 0
    held = next(i for i in range(99) if crc(i, 7) == 2)
    only = katz.score_documents(spark.createDataFrame([(held, "a b", "", "", 0)], DOC)).first()
    assert (only.held_out, only.train_tokens, only.base_score, only.score) == (True, 0, 0.0, 0.0)
    assert katz.score_documents(spark.createDataFrame([(None, None, "", "", 0), (3, "a", "", "", 0), (3, "a", "", "", 0)], DOC)).count() == 3


def spoken(n=400, seed=2):
    rng = random.Random(seed)
    parts = {"en": "the and ing tion with that".split(), "de": "der und schaft lich über für".split(), "fr": "le et ment eau où était".split()}
    return [(i, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(rng.randrange(3, 60))), lang) for i in range(n) for lang in [list(parts)[i % 3]]]


def test_language_id(spark):
    rows = [(i, t, lang, None, 0) for i, t, lang in spoken()] + [(900, None, "en", None, 0), (901, "123 ...", "de", None, 0), (902, "the and with that", None, None, 0), (None, "der und lich", None, None, 0)]
    got = {r.doc_id: r for r in langid.languages(clashing(spark.createDataFrame(rows, DOC))).collect()}
    held = [(i, lang) for i, _, lang in spoken() if crc(i, 5) == 0]
    assert all(got[i].held_out for i, _ in held) and np.mean([got[i].lang_pred == lang for i, lang in held]) >= 0.97
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred, got[None].lang_pred) == ("und", "und", "en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    none = spark.createDataFrame([], DOC)
    assert langid.languages(none).count() == 0
    assert langid.languages(spark.createDataFrame([(1, "abc", None, None, 0)], DOC)).first().lang_pred == "und"


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    docs, y = [], rng.integers(0, 2, 300)
    for k in y:
        f = np.unique(np.r_[rng.integers(0, 50, 8), 100 + k])
        docs.append((np.append(f, langid.BUCKETS), np.ones(len(f) + 1)))
    w = langid.fit(docs, y, 2)
    assert (w == 0).mean() > 0.99 and np.mean([(v @ w[f]).argmax() == k for (f, v), k in zip(docs, y)]) > 0.95
    scores = rng.normal(size=(500, 2)) * 5
    truth = (rng.random(500) < 1 / (1 + np.exp((scores[:, 0] - scores[:, 1]) / 3))).astype(int)
    assert 2 < langid.temperature(scores, truth) < 4.5


def labelled(spark, n=700, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 150))]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vileword"]))
        text = " ".join(w).capitalize() + "."
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None, None, None, 0), (9001, "", None, None, 0), (9002, " ", None, None, 0), (None, "word", None, None, 0), (9003, "word " * 30000, None, None, 0), (3, docs[3][1], None, None, 0)]
    labels += [(None, 1, 1), (9000, None, None), (5, None, None), (3, 1, 0)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, column, m, rest", [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_classifiers(spark, score, column, m, rest):
    docs, labels = labelled(spark)
    got = score(clashing(docs), labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.dropna(subset=["doc_id"]).merge(labels.toPandas().dropna(), on="doc_id")
    held = both[both.held_out]
    assert (held.doc_id.astype(int).map(lambda i: crc(i, m)) == rest).all() and (held.predicted == held[column]).mean() >= 0.93


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_without_labels(spark, score):
    docs, _ = labelled(spark, 10)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(docs, none).collect()} == {0.5} and score(spark.createDataFrame([], DOC), none).count() == 0
    ones = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in score(docs, ones).collect())


def test_attention_and_recurrence_gradients():
    """The hand-written gradients against differences."""
    rng = np.random.default_rng(0)
    f = np.float64
    d = 2 * toxicity.HIDDEN
    p = {"words": rng.normal(size=(4, toxicity.WORD_DIM)), "chars": rng.normal(size=(toxicity.TRIGRAMS, toxicity.CHAR_DIM)), "A": rng.normal(size=(d, toxicity.ATTEND)), "a": rng.normal(size=toxicity.ATTEND), "c": rng.normal(size=d), "d": np.zeros(1)}
    for w, u, b in (("Wf", "Uf", "bf"), ("Wb", "Ub", "bb")):
        p |= {w: 0.3 * rng.normal(size=(toxicity.WORD_DIM + toxicity.CHAR_DIM, 3 * toxicity.HIDDEN)), u: 0.3 * rng.normal(size=(toxicity.HIDDEN, 3 * toxicity.HIDDEN)), b: np.zeros(3 * toxicity.HIDDEN)}
    p = {k: v.astype(f) for k, v in p.items()}
    tri, begin = np.array([1, 2, 3, 4]), np.array([0, 1, 3])
    vocab, uniq = np.array([5, 6, 7], np.uint64), np.array([5, 7, 9], np.uint64)
    ids = np.full((2, toxicity.WINDOW), -1)
    ids[0, :5], ids[1, :3] = [0, 1, 2, 1, 0], [2, 2, 1]
    y = np.array([0.0, 0.0])
    before = toxicity._F
    toxicity._F = f
    try:
        def loss(p):
            x, _ = toxicity.inputs(p, vocab, uniq, tri, begin)
            return np.log1p(np.exp(toxicity.network(p, x, ids)["s"])).mean()

        x, known = toxicity.inputs(p, vocab, uniq, tri, begin)
        g = toxicity.gradients(p, x, known, tri, begin, ids, y)
        for k, at in (("A", (3, 2)), ("a", (1,)), ("c", (4,)), ("Uf", (2, 5)), ("Ub", (1, 20)), ("Wf", (3, 9)), ("Wb", (9, 2)), ("bf", (3,)), ("words", (2, 1)), ("chars", (3, 2))):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += 1e-5
            up = loss(q)
            q[k][at] -= 2e-5
            assert g[k][at] == pytest.approx((up - loss(q)) / 2e-5, rel=2e-3, abs=1e-7), k
    finally:
        toxicity._F = before


def test_quality_gradients():
    """The hand-written gradients of the gated attention and of the words against differences."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefg"), int(rng.integers(1, 9)))) for _ in range(3)] + [""]
    bags = [quality.passages(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts]
    bags += [quality.passages(np.frombuffer(("w x yy " * 70).encode(), np.uint8), np.array([0, 490]))]  # several passages
    whole, y = quality.joined(bags), np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    p = quality.start(3) | {"mean": whole.x.mean(0), "std": whole.x.std(0) + 0.1}
    loss = lambda q: np.logaddexp(0, np.where(y > 0, -1, 1) * quality.forward(q, whole, 5)["s"]).mean()
    g = quality.gradients(p, whole, 5, y)
    word = int(whole.word[-1])
    for k, at in (("E", (word, 2)), ("W", (quality.FEATURES + 1, 3)), ("W", (20, 5)), ("b", (4,)), ("V", (3, 2)), ("U", (1, 7)), ("w", (5,)), ("c", (2,)), ("d", (0,))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-4, abs=1e-9), k


def test_long_texts_score_as_if_read_at_once(spark, monkeypatch):
    """Texts of several pieces; each operator against its own kernel over the whole text."""
    docs, labels = labelled(spark, 200)
    rng = random.Random(8)
    long_ = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(230_000)) + " vileword"
    data, offs = np.frombuffer(long_.encode(), np.uint8), np.array([0, len(long_)])
    table = spark.createDataFrame([(1, "short"), (2, long_), (3, "short")], "doc_id long, text string")
    monkeypatch.setattr(quality, "PIECE_WORDS", 64 * 300)
    model = quality.train(docs, labels)
    want = quality.sigmoid(quality.forward(model, quality.passages(data, offs), 1)["s"])[0]
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert got[2] == pytest.approx(want) and got[1] == got[3]
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 16 * 500)
    model = toxicity.train(docs, labels)
    row, number, uniq, tri, begin = toxicity.word_table(data, offs)
    x, _ = toxicity.inputs(model, model["vocab"], uniq, tri, begin)
    ids = toxicity.windows(row, number, 1)[1]
    want = toxicity.sigmoid(max(toxicity.network(model, x, ids[i : i + 4096])["s"].max() for i in range(0, len(ids), 4096)))
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert got[2] == pytest.approx(float(want), rel=1e-5) and got[1] == got[3]
    monkeypatch.setattr(langid, "CHARS", 1000)
    parts = langid._grams_of([long_[:50_000].lower()])
    _, _, _, feat, has, times = next(langid.grams([long_[:50_000]]))
    assert has[0] and np.array_equal(np.bincount(parts[1], minlength=langid.BUCKETS), np.bincount(feat, times, langid.BUCKETS))


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from blockloom.llm._fit import bounded_rows, labelled_sample

    rows = [(i % 50, f"{i:03d}" + "x" * 97) for i in range(500)] + [(99, "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 20, 3, 1).collect()
    assert len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    assert all(r.text == f"{r.doc_id:03d}" + "x" * 97 for r in got if r.doc_id < 50)  # of repeated ids the smallest text
    few = bounded_rows(docs, labels.select("doc_id"), F.col("doc_id"), 100, most_bytes=1050).collect()
    assert sorted(r.doc_id for r in few) == list(range(10))
