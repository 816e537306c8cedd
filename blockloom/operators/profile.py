"""A document's style sheet from the looks of its blocks: body, ranked heading styles, footnote style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .looks import BIGGER, BOLD


def caps(text: Column) -> Column:
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (letters >= 4) & (upper >= 0.9 * letters)


def style(raw: str = "") -> Column:
    """struct<font, size, bold, italic, caps>; null for tables and blocks without a size. Sizes round half to even."""
    made = F.struct(
        F.coalesce("font", F.lit("")).alias("font"), (F.bround(F.col("font_size") * 2) / 2).alias("size"), (F.coalesce("bold", F.lit(0.0)) >= BOLD).alias("bold"),
        (F.coalesce("italic", F.lit(0.0)) >= BOLD).alias("italic"), caps(F.col("text")).alias("caps"),
    )
    return F.when(F.col("rows").isNull() & (F.col("font_size") > 0), made)


def describe(s: Column) -> Column:
    traits = F.concat_ws(" ", F.when(s["bold"], "bold"), F.when(s["italic"], "italic"))
    size = F.regexp_replace(F.format_string("%.1f", s["size"]), r"\.0$", "")
    return F.concat(F.when(s["font"] == "", "?").otherwise(s["font"]), F.lit(" "), size, F.when(s["caps"], " caps").otherwise(""), F.lit(" "), F.when(traits == "", "regular").otherwise(traits))


def style_profile(blocks: DataFrame, heights: DataFrame) -> DataFrame:
    """(document_id, style, role, rank): role body, heading (rank 1 is the most prominent) or footnote."""
    flow = blocks.filter("rows is null and role is null and not coalesce(footnote, false) and trim(text) <> ''").withColumn("style", style())
    doc = Window.partitionBy("document_id")
    order = doc.orderBy("pos")
    # Neighbours of one look are one use: islands.
    flow = flow.withColumn("_new", (~F.coalesce(F.col("style") == F.lag("style").over(order), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    flow = flow.join(heights.select("document_id", "page", F.col("height").alias("_h")), ["document_id", "page"], "left")
    chars, flat = F.char_length("text"), F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    low = F.coalesce((F.col("_h") > 0) & (F.col("bbox.y0") >= F.col("_h") * 0.75), F.lit(False))
    runs = flow.filter("style is not null").groupBy("document_id", "_run", "style").agg(
        F.min("pos").alias("pos"), F.sum(chars).alias("chars"), F.sum(F.char_length(flat)).alias("flat"), F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.sum(low.cast("int")).alias("bottom")
    )
    runs = runs.withColumn("_next", F.lead("style").over(order))
    uses = runs.groupBy("document_id", "style").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("chars").alias("chars"), F.sum(((F.col("lines") <= 6) & (F.col("flat") <= 300)).cast("int")).alias("short"), F.sum("bottom").alias("bottom"), F.min("pos").alias("first")
    )
    uses = uses.withColumn("_k", F.row_number().over(doc.orderBy(F.desc("chars"), "first"))).withColumn("_all", F.sum("chars").over(doc))
    body = uses.filter("_k = 1").select("document_id", F.col("style").alias("body"))
    s, b = F.col("style"), F.col("body")
    prominent = (s["size"] >= b["size"] * BIGGER) | ((s["size"] >= b["size"] * 0.95) & ((s["bold"] & ~b["bold"]) | (s["caps"] & ~b["caps"]) | (s["italic"] & ~b["italic"])))
    uses = uses.join(body, "document_id")
    able = uses.filter((F.col("_k") > 1) & prominent & (F.col("chars") <= 0.2 * F.col("_all")) & (F.col("short") >= 0.8 * F.col("uses")) & ((F.col("uses") >= 2) | (s["size"] > b["size"])))
    # A heading leads to body text or to a heading of another look.
    after = runs.join(able.select("document_id", "style", "uses", "body"), ["document_id", "style"]).join(able.select("document_id", F.col("style").alias("_next"), F.lit(True).alias("_ahead")), ["document_id", "_next"], "left")
    leads = after.groupBy("document_id", "style").agg(F.sum(F.coalesce((F.col("_next") == F.col("body")) | F.col("_ahead"), F.lit(False)).cast("int")).alias("leads"), F.first("uses").alias("uses"))
    heads = leads.filter("leads >= 0.5 * uses").withColumn("_total", F.sum("uses").over(doc)).filter("_total >= 3")
    rank = F.row_number().over(doc.orderBy(F.desc("style.size"), F.desc("style.bold"), F.desc("style.caps"), F.desc("style.italic"), "uses", "style.font"))
    notes = uses.filter((s["size"] < b["size"]) & (F.col("bottom") >= 0.6 * F.col("uses"))).withColumn("_n", F.row_number().over(doc.orderBy(F.desc("chars"), "first"))).filter("_n = 1")
    none = F.lit(None).cast("int")
    return (
        body.select("document_id", b.alias("style"), F.lit("body").alias("role"), none.alias("rank"))
        .unionByName(heads.select("document_id", "style", F.lit("heading").alias("role"), rank.alias("rank")))
        .unionByName(notes.select("document_id", "style", F.lit("footnote").alias("role"), none.alias("rank")))
    )
