"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. quality: documents that the attention classifier rejects go.
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. repeated_text: bytes covered by a 100-byte string that starts earlier go from the texts; characters cut in two go too.
4. mixture: sources are brought to target weights.
5. packing: what is left is packed into sequences.

Stages 1 and 3 judge each row by itself. In stages 2 and 4 rows that repeat a doc_id share one decision: in stage 2 an id goes
only if all its rows would, in stage 4 its rows have one place in the order. A null doc_id always stays in stage 2. Empty
texts are judged like others; empty tables pass through. Columns beside those of documents keep their values under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import mixing, ngram_join, packing, quality, suffix_dedup
from blockloom.llm._runtime import Scratch
from blockloom.llm.queries import TARGETS

#: What documents consist of; columns of other names pass through, whatever they are called.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture may take in all.
BUDGET = 0.9
#: Dropped ids up to this many are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000


def _by_itself(work: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``work`` on documents whose other columns have names that no operator uses; the result has the names of ``docs``."""
    names = {c: c if c in COLUMNS else f"_column_{k}" for k, c in enumerate(docs.columns)}
    out = work(docs.toDF(*names.values()))
    return out.select(*[F.col(f"`{own}`").alias(c) for c, own in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # at most quality.FIT_DOCS labelled documents are fitted on; every document is scored
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _by_itself(lambda own: quality.score(own, model, "_score").filter("_score >= 0.5"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    groups = ngram_join.jaccard_components(docs)
    gone = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays").select("doc_id")
    gone = scratch.keep(gone)
    small = F.broadcast if gone.count() <= BROADCAST_IDS else lambda df: df
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def work(own: DataFrame) -> DataFrame:
        return suffix_dedup.remove_repeats(own, as_text=True).withColumns({"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")})

    return _by_itself(work, docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _by_itself(lambda own: mixing.mix_sources(own, mixing.Mix(TARGETS, budget_fraction=BUDGET)).filter("_copies > 0"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: Not expressible in SQL (a classifier, seeded epochs, packing). Tests hold stages 2 to 5 against direct versions, stage 1 against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
