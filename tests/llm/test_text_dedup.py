"""Jaccard join and suffix dedup against brute force, with odd rows."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import _text, ngram_join, suffix_dedup
from tests.llm.conftest import DOC, clashing, corpus

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = SPLIT.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def removed(rows, length):
    """Of rows in order: (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                mark[k] += 1
                mark[k + length] -= 1
            seen.add(raw[k : k + length])
        gone = np.cumsum(mark)[: len(raw)] > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_jaccard_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(clashing(docs)).collect()}
    assert got == components(corpus())


def test_families_at_the_edge(spark):
    """Chains whose ends aren't similar, and a passage that many texts share."""
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join([*(f"u{k}x{j}" for j in range(k * 2)), *base[k * 2 :]])) for k in range(12)]
    rows += [(100 + k, " ".join([*base, *(f"v{k}x{j}" for j in range(k % 15))])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == components(rows)


def drifting(families=30, steps=12, words=100):
    """Chains of texts of one size; each differs from the one before in a word, and only near ones are similar."""
    rows = []
    for f in range(families):
        text = [f"f{f}w{i}" for i in range(words)]
        for k in range(steps):
            rows.append((f * steps + k, " ".join(text)))
            text[7 + k * 7] = f"f{f}s{k}"
    return rows


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = drifting(8)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows * 3, "doc_id long, text string")).collect()
    assert len(got) == 3 * len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_numbers_of_links(spark, monkeypatch, block):
    """All links of each row, also those within a group that fewer would hold together; copies and repeated rows count."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # 2: several blocks a family
    rows = [*drifting(6), *[(1000 + i, t) for i, t in corpus()]]
    rows += [rows[3], rows[3], (2000, rows[5][1]), (None, rows[5][1]), (None, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [(i, shingle_set(t)) for i, t in rows]
    similar = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    want = [(i or -1, len(a), sum(similar(a, b) for _, b in sets) - bool(a)) for i, a in sets]
    assert sorted((r.doc_id or -1, r.n_shingles, r.n_links) for r in got) == sorted(want)


def test_null_and_repeated_ids_link_like_others(spark):
    text = [f"t{i}" for i in range(40)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(text))
    ends = [near(), near(3), near(3, 37)]  # the first and the last aren't similar
    assert sorted(c for _, c in components([(1, ends[0]), (3, ends[2])]).values()) == [1, 3]
    for middle in (9, None):
        got = ngram_join.jaccard_components(spark.createDataFrame([(1, ends[0]), (middle, ends[1]), (3, ends[2])], "doc_id long, text string")).collect()
        assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(1, 1, 1), (middle, 1, 2), (3, 1, 1)}
    got = ngram_join.jaccard_components(spark.createDataFrame([(5, ends[0]), (5, "other words"), (1, ends[0]), (None, "alone"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 1, 0), (1, 36, 1), (5, 1, 5), (5, 36, 1)]


def test_signatures_are_shared_by_similar_sets():
    """The pigeonhole itself: pairs at the threshold share a signature, whatever their sizes and however their features fall."""
    rng = np.random.default_rng(3)
    bands = ngram_join.Bands(80, 5000)
    pairs = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400)) if rng.random() < 0.7 else int(rng.integers(1, 30))
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = rng.integers(0, 2**63, n // 4).astype(np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.r_[both, extra[:cut]]), np.unique(np.r_[both, extra[cut:]])
        if 100 * n < 80 * (len(a) + len(b) - n) or (len(a) == len(b) == n):
            continue
        sigs = [set(ngram_join.signatures(np.zeros(len(x), np.int64), x, np.array([len(x)]), bands)[1].tolist()) for x in (a, b)]
        assert sigs[0] & sigs[1]
        pairs += 1
    assert pairs > 500


def test_subsets_of_cells_are_enumerated():
    """The number of signatures is that of two-level enumeration; unrelated sets share none."""
    bands = ngram_join.Bands(80, 5000)
    assert (bands.k2 > 0).any() and (bands.n1 >= bands.k // (bands.k2 + 1) + 1)[bands.k > 0].all()
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (40, 300, 300, 2000)]
    row, h = np.repeat(np.arange(4), [len(x) for x in rows]), np.concatenate(rows)
    counts = np.array([len(x) for x in rows])
    owner, sigs = ngram_join.signatures(row, h, counts, bands)
    for i, n in enumerate(counts):
        own = int(bands.of(np.array([n]))[0])
        most = sum(int(bands.n1[j]) * math.comb(int(bands.n2[j]), int(bands.k2[j])) for j in (own, own + 1) if j == own or n * 100 // 80 >= bands.lo[j])
        assert 0.9 * most <= (owner == i).sum() <= 2 * most
    assert len(np.unique(sigs)) == len(sigs)


def test_sets_with_many_empty_cells_are_signed_again(monkeypatch):
    """Features that all fall into one partition: similar sets share a signature of other partitions."""
    bands = ngram_join.Bands(80, 5000)
    salt = np.uint64(0x2545F4914F6CDD1D)
    pool = np.arange(1, 400_000, dtype=np.uint64)
    pool = pool[ngram_join._text.mix(pool + salt) >> np.uint64(58) == 0][:60]
    a, b = pool[:50], np.r_[pool[:45], pool[50:55]]
    sigs = [set(ngram_join.signatures(np.zeros(len(x), np.int64), x, np.array([len(x)]), bands)[1].tolist()) for x in (a, b)]
    assert len(a) == len(b) == 50 and sigs[0] & sigs[1]


def test_odd_ids_and_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert ngram_join.jaccard_components(none).count() == 0 and suffix_dedup.digest(none).count() == 0
    out = suffix_dedup.digest(spark.createDataFrame([(None, "q" * 150, "", "", 0), (5, "q" * 150, "", "", 0), (5, "r" * 150, "", "", 0), (5, "r" * 150, "", "", 0)], DOC))
    assert sorted((r.doc_id or 0, r.n_removed) for r in out.collect()) == [(0, 149), (5, 149), (5, 150), (5, 150)]


@pytest.mark.parametrize("hot, block, span", [(20_000, 1 << 19, 8 << 20), (1, 1 << 19, 8 << 20), (20_000, 300, 500), (1, 300, 1)])
def test_suffix_dedup(docs, monkeypatch, hot, block, span):
    """Whole; buckets of several variants dealt by window before the shuffle; blocks of two segments, spans of a text."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "SPAN", span)
    rows = sorted(corpus())
    out = suffix_dedup.remove_repeats(clashing(docs), hot=hot)
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, hashlib.sha256(bytes(r._kept)).hexdigest()) for r in out.collect()}
    assert [got[i] for i, _ in rows] == removed(rows, 100)
    text = {r.doc_id: r._kept for r in suffix_dedup.remove_repeats(docs, as_text=True).select("doc_id", "_kept").collect()}
    assert all("�" not in t for t in text.values())


def test_long_texts_come_in_pieces(spark, monkeypatch):
    """Texts many times longer than what is read at a time; one passage in every text."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    passage = letters(900)
    rows = [(i, letters(int(rng.integers(0, 9000))) + passage + letters(2000)) for i in range(12)] + [(20, "z" * 5000), (21, passage * 3), (22, None)]
    out = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert [got[i] for i, _ in rows] == removed(rows, 100)


def test_words_are_hashed_in_parts():
    rng = np.random.default_rng(6)
    for _ in range(100):
        texts = ["".join(rng.choice(list("ab C\n"), int(rng.integers(0, 40)))) for _ in range(5)]
        for _, _, data, offs in _text.slices(pa.array(texts)):
            starts, ends, row = _text.words(data, offs)
            for most in (1, 3, 7, 1000):
                rows, h = _text.word_hashes(data, offs, most)
                assert rows.tolist() == row.tolist() and h.tolist() == _text.span_hashes(data, starts, ends).tolist()


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4):
        body = rng.integers(97, 97 + letters, 700).astype(np.uint8)
        text = np.r_[body, np.zeros(264, np.uint8)]
        starts = np.arange(600)
        bucket = rng.integers(0, 3, 600)
        order = suffix_dedup.suffix_order(text, starts, bucket, 100)
        keys = [(bucket[i], text[starts[i] : starts[i] + 100].tobytes()) for i in order]
        assert keys == sorted(keys)
        order, cls = suffix_dedup.equal_classes(text, starts, bucket, 100)
        assert [a == b for a, b in zip(keys, keys[1:])] == (cls[1:] == cls[:-1]).tolist()


def test_the_cover_meets_every_pair():
    for i in range(suffix_dedup.PERIOD):
        for j in range(suffix_dedup.PERIOD):
            d = suffix_dedup._DELTA[i, j]
            assert {(i + d) % suffix_dedup.PERIOD, (j + d) % suffix_dedup.PERIOD} <= set(suffix_dedup.COVER)
