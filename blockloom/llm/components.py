"""Connected components of any number of links, without a driver-side or single-task step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a long, b long); component is the smallest node reachable.

    Each round every node moves to the first of its closed neighbourhood in a fixed random order, and links are
    contracted; a constant share of the nodes goes each round, on chains as on stars. Each round is written to the
    shared folder, so a lost executor never replays earlier rounds. Links with a null end are ignored.
    """
    links = scratch.keep(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    assign = None
    order = lambda c: F.struct(F.xxhash64(F.lit(41), F.col(c)).alias("key"), F.col(c).alias("id"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = scratch.keep(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["id"].alias("to")))
        if assign is None:
            assign = hop
        else:
            assign = scratch.keep(assign.join(hop.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        a, b = hop.select(F.col("node").alias("a"), F.col("to").alias("ta")), hop.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(a, "a").join(b, "b").filter("ta <> tb")
        links = scratch.keep(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if assign is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = assign.groupBy("to").agg(F.min("node").alias("component"))
    return assign.join(least, "to").select("node", "component")
