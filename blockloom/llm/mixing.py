"""Mixing sources to target weights by hierarchical budgeting.

The tree is root > domain > language > source. A node's budget goes to its children by weight; a child that
holds less than its share gives the shortage back to its siblings first, and only what a whole subtree cannot
use reaches the siblings of its ancestor. A leaf takes full seeded epochs and then a token prefix of the next one,
in the order of a seeded hash.

Rows: a null domain, lang or source is the leaf ``unknown``; a null or empty text has 0 tokens; rows that repeat a
doc_id stand and fall together; a null doc_id hashes like any other value and its rows stand together too. Extra
columns pass through untouched. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._runtime import Scratch

LEAF = ("_domain", "_lang", "_source")
#: Names of this operator; a column of such a name is replaced.
_OWN = (*LEAF, "_tokens", "_copies", "_id", "_key", "_full", "_rest", "_buckets", "_range", "_edge", "_cut")
#: Leaves up to this many are broadcast as a lookup; more are joined by shuffle.
BROADCAST_LEAVES = 10_000
#: Rows of one leaf summed up in one task.
BUCKET_ROWS = 1_000


def default_domain(source: Column) -> Column:
    """Sources named with a number belong to three domains by that number; anything else is ``other``."""
    n = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.when(n.isNull(), "other").when(n < 7, "web").when(n < 14, "books").otherwise("forums")


@dataclass
class Mix:
    """weights: by path, ("web",), ("web", "en") or ("web", "en", "src1").

    Nodes without one share by their tokens what the weights of their siblings leave of 1. Where that is nothing, they keep
    their natural share of the parent and the weights divide the rest.
    """

    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    budget: float | None = None
    budget_fraction: float = 0.9
    max_epochs: int = 1
    seed: int = 17
    domain: Callable[[Column], Column] = default_domain


def _poured(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent columns, budget of the parent, heft, room) with granted: by heft, and what one has no room for to its siblings.

    Children fill up in the order of room by heft; at one place in that order the rest of the budget no longer fills them.
    Children without heft get what all others together have no room for, by their room.
    """
    every, heavy = Window.partitionBy(*parent), F.col("heft") > 0
    order = Window.partitionBy(*parent).orderBy(F.when(heavy, F.col("room") / F.col("heft")).asc_nulls_last(), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    weigh = lambda c: F.sum(F.when(heavy, c).otherwise(0.0))
    out = children.withColumn("left", F.least("budget", F.sum("room").over(every)))
    out = out.withColumn("full", heavy & ((F.col("left") - F.coalesce(weigh(F.col("room")).over(before), F.lit(0.0))) * F.col("heft") >= F.col("room") * (weigh(F.col("heft")).over(every) - F.coalesce(weigh(F.col("heft")).over(before), F.lit(0.0)))))
    rest = F.greatest(F.lit(0.0), F.col("left") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(every))
    open_ = F.sum(F.when(heavy & ~F.col("full"), F.col("heft")).otherwise(0.0)).over(every)
    light = F.sum(F.when(~heavy, F.col("room")).otherwise(0.0)).over(every)
    share = F.when(F.col("full"), F.col("room")).when(heavy, rest * F.col("heft") / open_).when((open_ > 0) | (light <= 0), 0.0).otherwise(rest * F.col("room") / light)
    return out.withColumn("granted", F.least(F.col("room"), share))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(leaf columns, tokens, granted) of ``leaves`` (leaf columns, tokens): budgets down the tree, one level at a time.

    Children with a weight share their parent's budget by it; those without one have their natural share of what the weights
    leave. If the weights leave nothing, those without one keep their natural share, and the others split the rest. A
    parent's children are one window; no leaf comes to the driver.
    """
    spark = leaves.sparkSession
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(F.lit(float(mix.budget) if mix.budget is not None else None).cast("double").alias("given"), "t")
    level = total.select(F.coalesce("given", F.col("t") * F.lit(mix.budget_fraction)).alias("budget"), F.lit("").alias("root"))
    for depth, column in enumerate(LEAF, 1):
        parent, own = ["root", *LEAF[: depth - 1]], LEAF[:depth]
        weights = [(*k, float(w)) for k, w in mix.weights.items() if len(k) == depth]
        told = spark.createDataFrame(weights, ", ".join(f"{c} string" for c in own) + ", weight double")
        promised = told.withColumn("root", F.lit("")).groupBy(*parent).agg(F.sum("weight").alias("promised"))
        nodes = leaves.groupBy(*own).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("root", F.lit(""))
        nodes = nodes.join(F.broadcast(told), list(own), "left").join(F.broadcast(promised), parent, "left").join(level.drop("tokens"), parent)
        siblings = Window.partitionBy(*parent)
        plain = F.sum(F.when(F.col("weight").isNull(), F.col("tokens")).otherwise(0.0)).over(siblings)
        named, all_ = F.coalesce(F.sum("weight").over(siblings), F.lit(0.0)), F.sum("tokens").over(siblings)
        spare = 1 - F.coalesce("promised", F.lit(0.0))
        natural = F.when(all_ > 0, plain / all_).otherwise(0.0)
        nodes = nodes.withColumns({"_plain": plain, "_named": named, "_tight": spare < 1e-9, "_any": F.count("weight").over(siblings) > 0, "_spare": F.when(spare < 1e-9, natural).otherwise(spare)})
        scale = F.when(F.col("_tight"), (1 - F.col("_spare")) / F.when(F.col("_named") == 0, 1.0).otherwise(F.col("_named"))).otherwise(1.0)
        share = F.when(F.col("_any"), F.col("_spare")).otherwise(1.0) * F.when(F.col("_plain") > 0, F.col("tokens") / F.col("_plain")).otherwise(0.0)
        nodes = nodes.withColumns({"heft": F.when(F.col("weight").isNotNull(), scale * F.col("weight")).otherwise(share), "room": F.col("tokens") * mix.max_epochs, "node": F.col(column)})
        level = _poured(nodes, parent).select("root", *own, "tokens", F.col("granted").alias("budget"))
    return level.select(*LEAF, F.col("tokens").cast("long").alias("tokens"), F.col("budget").alias("granted"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with _domain, _lang, _source, _tokens and _copies: how many epochs of its leaf took the row (0: left out)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop(*_OWN)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    named = docs.withColumns({"_domain": mix.domain(known("source")), "_lang": known("lang"), "_source": known("source"), "_tokens": n_tokens(F.col("text"))})
    slim = scratch.keep(named.select(*LEAF, F.col("doc_id").alias("_id"), "_tokens"))
    leaves = scratch.keep(slim.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    whole = F.floor(F.col("granted") + 1e-6).cast("long")
    full = F.when(F.col("tokens") > 0, F.least(F.lit(mix.max_epochs), F.floor(whole / F.col("tokens")))).otherwise(F.lit(mix.max_epochs)).cast("int")
    rest = F.when(F.col("_full") < mix.max_epochs, whole - F.col("_full") * F.col("tokens")).otherwise(0).cast("long")
    plan = budgets(leaves, mix).join(leaves.select(*LEAF, "n"), list(LEAF)).withColumn("_full", full).withColumn("_rest", rest)
    plan = scratch.keep(plan.select(*LEAF, "_full", "_rest", (1 + F.floor(F.col("n") / BUCKET_ROWS)).cast("long").alias("_buckets")))
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda df: df
    key = F.xxhash64(F.lit(mix.seed), F.col("_full"), F.col("_id"))
    # A leaf's order is dealt into ranges of its key, so that no task sees a whole leaf.
    keyed = slim.join(small(plan.filter("_rest > 0")), list(LEAF)).withColumn("_key", key)
    keyed = keyed.withColumn("_range", F.floor((F.col("_key").cast("double") / F.lit(2.0**64) + 0.5) * F.col("_buckets")))
    by_range = keyed.groupBy(*LEAF, "_range", "_rest").agg(F.sum("_tokens").alias("_sum"))
    w = Window.partitionBy(*LEAF).orderBy("_range")
    before = by_range.withColumn("_before", F.sum("_sum").over(w) - F.col("_sum"))
    # Only the range in which the budget ends decides the threshold.
    edge = scratch.keep(before.filter("_before <= _rest").groupBy(*LEAF).agg(F.max_by(F.struct("_range", "_before"), "_range").alias("e")).select(*LEAF, "e._range", "e._before"))
    last = keyed.join(small(edge), [*LEAF, "_range"])
    cum = F.sum("_tokens").over(Window.partitionBy(*LEAF, "_range").orderBy("_key", "_id"))  # the default frame counts peers
    cut = last.withColumn("_cum", cum + F.col("_before")).filter("_cum <= _rest").groupBy(*LEAF).agg(F.max(F.struct("_key", F.coalesce("_id", F.lit(-(2**63))).alias("_cut_id"))).alias("_cut"))
    edges = scratch.keep(plan.join(edge, list(LEAF), "left").join(cut, list(LEAF), "left").select(*LEAF, "_full", "_rest", "_buckets", F.col("_range").alias("_edge"), "_cut"))
    out = named.join(small(edges), list(LEAF), "left").withColumn("_id", F.col("doc_id")).withColumn("_key", key)
    at = F.floor((F.col("_key").cast("double") / F.lit(2.0**64) + 0.5) * F.col("_buckets"))
    taken = (F.col("_rest") > 0) & ((at < F.col("_edge")) | F.coalesce((at == F.col("_edge")) & (F.struct(F.col("_key"), F.coalesce("_id", F.lit(-(2**63))).alias("_cut_id")) <= F.col("_cut")), F.lit(False)))
    return out.withColumn("_copies", F.col("_full") + F.coalesce(taken, F.lit(False)).cast("int")).select(*[docs[c] for c in docs.columns], *LEAF, "_tokens", "_copies")
