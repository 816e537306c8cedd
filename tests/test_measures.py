"""Measures against gold headings, drafts of gold, trainers' readers and accuracy."""

import json
import os
import random

import pyarrow as pa
import pytest

from blockloom import queries as Q
from blockloom.operators import evaluation, headings, training
from blockloom.operators.looks import Raw
from tests.oracle import by_sql, rows

BLOCKS = [("d", i, k, t, lv) for i, (k, t, lv) in enumerate([("heading", "1. Kirish", 1), ("paragraph", "Birinchi matn shu yerda turadi.", None), ("heading", "1.1. Maqsad", 2), ("paragraph", "Ikkinchi matn boshqa joyda turadi.", None), ("heading", "2. Yakun", 1), ("paragraph", "Uchinchi matn oxirida turadi.", None)])]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(BLOCKS, "document_id string, pos int, type string, text string, level int")


def chunk_rows(spark, *paths):
    texts = ["1. Kirish\n\nBirinchi matn shu yerda turadi.", "1.1. Maqsad\n\nIkkinchi matn boshqa joyda turadi.", "2. Yakun\n\nUchinchi matn oxirida turadi."]
    return spark.createDataFrame([("d", i, t, p, 9, "uz") for i, (t, p) in enumerate(zip(texts, paths))], "document_id string, chunk_index int, text string, heading_path array<string>, token_count long, language string")


GOLD = [("d", 0, 1, "1 Kirish", False), ("d", 1, 2, "1.1. MAQSAD", False), ("d", 2, 2, "Yoʻq sarlavha", True), ("d", 3, 1, "2. Yakun", False)]


def test_paths_against_gold(spark, blocks):
    gold = spark.createDataFrame(GOLD, "document_id string, pos int, level int, text string, optional boolean")
    assert sorted((r.pos, r.level) for r in evaluation.gold_positions(gold, blocks).collect()) == [(0, 1), (2, 2), (4, 1)]
    chunks = chunk_rows(spark, ["1. Kirish"], ["1. Kirish", "1.1. Maqsad"], ["1. Kirish", "2. Yakun"])
    assert sorted((r.chunk_index, r.pos) for r in evaluation.chunk_starts(blocks, chunks).collect()) == [(0, 0), (1, 2), (2, 4)]
    got = evaluation.path_accuracy(gold, blocks, chunks).first()
    assert (got.chunks, got.right) == (3, 2) and got.accuracy == pytest.approx(2 / 3)
    source = spark.createDataFrame([("d", "\n".join(t for _, _, _, t, _ in BLOCKS))], "document_id string, text string")
    row = evaluation.report(source, blocks, chunks, gold).first()
    assert (row.fidelity, row.order, row.chunks, row.path_accuracy) == (1.0, 1.0, 3, pytest.approx(2 / 3)) and row.recall == 1.0


def test_near_pairs_of_two_texts(monkeypatch):
    """Short and long texts alike give what all pairs of the source give; words of one or two letters are none."""
    rng = random.Random(7)
    for n, m in ((0, 0), (0, 9), (1, 6), (2, 1), (3, 0), (40, 45), (300, 305)):
        words, out = ([rng.choice(("bir", "ikki", "uch", "yoʻl", "тўрт", "bo", "kitob", "qalam")) for _ in range(size)] for size in (n, m))
        source, kept = ", ".join(words), "\n".join(out)
        w, o = (evaluation._WORD.findall(t) for t in (source, kept))
        near = {p for k in range(1, 4) for p in zip(w, w[k:])}
        for long_ in (-1, 1 << 16):
            monkeypatch.setattr(evaluation, "_LONG", long_)
            assert evaluation._near(pa.scalar(source), pa.scalar(kept), 3) == (len(o), sum(p in near for p in zip(o, o[1:])))


def test_order_in_rows_is_order_kept(spark):
    """Also for a key of several rows and for null keys; the frame may hold other columns and another type of key."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(("alfa", "beta", "gamma", "delta", "Omega")) for _ in range(n))
    data = [(i, text(i % 9), text(i % 7), i) for i in range(60)] + [(60, "alfa", "beta gamma delta", 0), (60, None, None, 0), (61, None, text(5), 0), (62, text(5), None, 0)]
    data += [(63, "alfa beta gamma", "gamma alfa beta", 0)] * 3 + [(None, text(9), text(9), 0), (None, text(5), text(3), 0)]
    df = spark.createDataFrame(data, "key long, a string, b string, more int")
    side = lambda c: df.selectExpr("key", f"{c} as text")
    got, want = evaluation.order_in_rows(df, "key", "a", "b", 2), evaluation.order_kept(side("a"), side("b"), "key", 2)
    assert rows(got.toPandas()) == rows(want.toPandas()) and got.dtypes == want.dtypes
    assert {r.key: r.pairs for r in got.filter("key is null or key > 60").collect()} == {None: 11, 61: 4, 63: 8}


def test_order_pairs_of_repeated_and_missing_ids(spark, tmp_path):
    docs = [(1, "bir ikki uch\ntoʻrt besh"), (2, None), (3, "bir"), (4, ""), (None, "bir ikki\nuch"), (None, "besh olti"), (5, "bir ikki\nuch toʻrt\nbir uch"), (5, "bir ikki\nuch toʻrt\nbir uch"), (6, "Besh Olti\r\n\nYetti " * 50)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.read.parquet(str(tmp_path / "docs")).toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    got = rows(Q.order_pairs(spark, str(tmp_path)).toPandas())
    assert got == by_sql(Q.oracle_sql()["order_pairs"], str(tmp_path)) and len(got) == 4


def test_order_pairs_shuffles_less_than_its_input(spark):
    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = written()
    assert len(Q.order_pairs(spark, "/root/testdata/sf0.01").collect()) > 900
    assert 0 < written() - before < 0.1 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")


def test_drafts_and_sources(spark, blocks):
    assert [h["text"] for h in json.loads(evaluation.draft_gold(blocks).first().json)["headings"]] == ["1. Kirish", "1.1. Maqsad", "2. Yakun"]
    lines = spark.createDataFrame([("d", 1, 1, "b", None), ("d", 1, 0, "a", "A"), ("d", 2, 0, "c", "c")], "document_id string, page int, pos int, text string, original string")
    assert {(r.page, r.text) for r in evaluation.source_text(lines).collect()} == {(1, "A\nb"), (2, "c")}


def test_tags_that_name_no_heading():
    raws = [Raw("Kirish qismi", heading_level=1, heading_source="tags"), Raw("x = 1", heading_level=2, heading_source="tags"), Raw("Oddiy", heading_level=None), Raw("Uslub", heading_level=1, heading_source="style")]
    assert headings.tag_failures(raws) == (2, 1) and headings.tag_failures([]) == (0, 0)


def test_readers_of_training_texts(spark):
    lines = spark.createDataFrame([("# sent_id = 1",), ("# text = Bir gap.",), ("1\tBir",), ("# text = Ikki.",)], "value string")
    assert [r.text for r in training.conllu_sentences(lines).collect()] == ["Bir gap.", "Ikki."]
    books = spark.createDataFrame([("a", "x" * 50 + "\nqisqa\n" + "y" * 60), ("b", "z" * 50 + "\n" + "w" * 50), ("c", "v" * 50)], "book string, text string")
    assert sorted(r.text[0] for r in training.book_lines(books, most=170).collect()) == ["x", "y", "z"]


def test_held_out_accuracy(spark):
    texts = [("en", "the thing with that"), ("de", "der schaft und lich")] * 5
    df = spark.createDataFrame(texts, "lang string, text string")
    table, floors = training.model(df, "lang")
    held = spark.createDataFrame([("en", "that thing"), ("de", "und der"), ("de", "with the")], "lang string, text string")
    got = {r.words: (r.texts, r.accuracy) for r in training.held_out_accuracy(table, floors, held, "lang").collect()}
    assert got == {k: (3, pytest.approx(2 / 3)) for k in (0, 1, 2, 3, 5)}
