"""Every registered query runs; those with SQL give its rows."""

import pytest

from blockloom import plans
from blockloom import queries as Q
from blockloom.functions import hyphens, language, normalize, sentences
from blockloom.operators import chunking, structure, training
from blockloom.sources import text as readers
from tests.oracle import by_sql, rows

FOLDER = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got = Q.queries()[name](spark, FOLDER).toPandas()
    assert rows(got) == by_sql(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_runs(spark, name):
    """All rows are made, and the same ones a second time in the same session."""
    got = [rows(Q.queries()[name](spark, FOLDER).toPandas()) for _ in range(2)]
    assert got[0] and got[0] == got[1]


def _texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_text_functions_over_whole_texts(spark):
    """The columns give what the functions give for one text at a time."""
    texts = _texts(spark)
    Q.compound_pairs(spark, FOLDER).collect()  # the order in which queries run makes no difference
    assert {r.doc_id: r.text for r in Q.repaired_texts(spark, FOLDER).collect()} == {i: None if t is None else hyphens.repair(t, hyphens.compounds([t])) for i, t in texts.items()}
    assert {r.doc_id: r.sentences for r in Q.sentence_counts(spark, FOLDER).collect() if texts[r.doc_id] is not None} == {i: len(sentences.split(t)) for i, t in texts.items() if t is not None}
    for r in Q.detected_languages(spark, FOLDER).collect():
        assert texts[r.doc_id] is None or (r.language, r.script) == language.detect(texts[r.doc_id])[:2]
    for r in Q.clean_texts(spark, FOLDER).collect():
        assert texts[r.doc_id] is None or r.text == normalize.clean(texts[r.doc_id])[0]


def test_whole_rows_and_grouped_blocks_agree(spark):
    """Documents that come as one row give the chunks and blocks that their lines, shuffled together again, give."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    a, b = (rows(df.select("chunk_id", "document_id", "text", "language", "chunk_index", "token_count").toPandas()) for df in (plans.chunk_texts(docs), chunking.chunk(chunking.paragraphs(docs))))
    assert a == b
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    whole, grouped = plans.html_blocks(pages), structure.build_blocks(readers.html_blocks(pages), structure.StructureOptions(page_layout=False))
    columns = ("document_id", "pos", "type", "text", "level", "heading_source")
    assert rows(whole.select(*columns).toPandas()) == rows(grouped.select(*columns).toPandas())
    one, other = plans.chunk_html(pages), plans.blocks_to_chunks(grouped)
    columns = ("chunk_id", "document_id", "text", "language", "script", "token_count")
    assert rows(one.select(*columns).toPandas()) == rows(other.select(*columns).toPandas())


def test_entry_works_alone(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_model_is_the_whole_one(spark):
    """As many grams as training.model keeps by default, or all there are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang is not null").select("lang", "text")
    there = training.counts(docs, "lang").select("n", "gram").distinct().count()
    assert Q.ngram_model(spark, FOLDER).select("n", "gram").distinct().count() == min(there, training.GRAMS) > 2000
