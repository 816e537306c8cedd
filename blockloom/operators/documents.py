"""One row for each document: id, language by a weighted vote, heading sources, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.language import Detected, detect, detect_language

LITTLE_TEXT, UNSURE_PAGE = 200, 0.6


def document_id(source: Column, text: Column) -> Column:
    """Stable: sixteen digits of the digest of the file name and the text."""
    return F.substring(F.sha1(F.concat(source, F.lit("\0"), text).cast("binary")), 1, 16)


def full_text(blocks: DataFrame) -> DataFrame:
    """document_id, text: texts of the blocks in order, a blank line between."""
    said = blocks.filter("text <> ''").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return said.select("document_id", F.array_join(F.col("t.text"), "\n\n").alias("text"))


#: Languages that count as known, and scripts.
_KNOWN, _SCRIPTS = ("ru", "uz", "mixed"), ("cyrillic", "latin", "mixed", "none")


def _vote(blocks: Column) -> Column:
    """struct<language, script, confidence> by length of text over an array of blocks in order; null if none is known.

    Unknown if less than half of the written text is in a known language. Blocks with a role and footnotes don't vote.
    Ties go to what stands first.
    """
    spoken, script = (lambda b: b["language"]["language"]), (lambda b: b["language"]["script"])
    voters = F.filter(blocks, lambda b: (b["type"] != S.FOOTNOTE) & b["role"].isNull() & (F.coalesce(spoken(b).isin(*_KNOWN), F.lit(False)) | (F.coalesce(script(b), F.lit("none")) != "none")))
    known = F.filter(voters, lambda b: spoken(b).isin(*_KNOWN))
    weight = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))

    def winner(of: Column, what, values: tuple[str, ...]) -> Column:
        least = lambda v: F.coalesce(F.array_min(F.transform(F.filter(of, lambda b: what(b) == v), lambda b: F.struct((~F.coalesce(spoken(b).isin(*_KNOWN), F.lit(False))).alias("k"), b["pos"].alias("p")))), F.struct(F.lit(True).alias("k"), F.lit(1 << 30).alias("p")))
        one = lambda v: F.struct((-weight(F.filter(of, lambda b: what(b) == v))).alias("w"), least(v).alias("p"), F.lit(v).alias("v"))
        return F.array_min(F.array(*map(one, values)))

    made = lambda a, b, c: F.struct(a.alias("language"), b.alias("script"), c.cast("double").alias("confidence"))
    lang, total = winner(known, spoken, _KNOWN), weight(known)
    voted = F.when(total >= 0.5 * weight(voters), made(lang["v"], winner(known, script, _SCRIPTS)["v"], -lang["w"] / total)).otherwise(made(F.lit("unknown"), winner(voters, script, _SCRIPTS)["v"], F.lit(0.0)))
    return F.when(F.size(known) > 0, voted)


def summary(blocks: list[dict]) -> tuple[str | None, Detected]:
    """(title, language) of one document's blocks: what ``assemble`` says of it."""
    title = " ".join(b["text"] for b in blocks if b["title"]) or None
    votes = [(Detected(**b["language"]), len(b["text"])) for b in blocks if b["type"] != S.FOOTNOTE and b["role"] is None]
    known = [(x, n) for x, n in votes if x.language in _KNOWN]
    if not known:
        return title, detect("\n\n".join(b["text"] for b in blocks if b["text"]))

    def most(of: list, what: str) -> tuple[str, int]:
        sums: dict[str, int] = {}
        for x, n in of:
            sums[getattr(x, what)] = sums.get(getattr(x, what), 0) + n
        return max(sums.items(), key=lambda kv: kv[1])

    written = [(x, n) for x, n in votes if x.language in _KNOWN or x.script != "none"]
    total = sum(n for _, n in known)
    if total < 0.5 * sum(n for _, n in written):
        written.sort(key=lambda v: v[0].language not in _KNOWN)
        return title, Detected("unknown", most(written, "script")[0], 0.0)
    language, n = most(known, "language")
    return title, Detected(language, most(known, "script")[0], n / total if total else 0.0)


def assemble(blocks: DataFrame, pages: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """One row a document: language, title, heading sources, counts and warnings.

    ``pages``: document_id, number, needs_ocr, confidence. ``meta``: document_id, source, title.
    """
    # One row a document, its blocks in order; the passes that made them run once.
    said = F.struct("pos", "type", "text", "page", "role", "language", "heading_source", "title")
    docs = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(said)).alias("_b"))
    own = F.col("_b")
    docs = docs.withColumn("_text", F.array_join(F.transform(F.filter(own, lambda b: b["text"] != ""), lambda b: b["text"]), "\n\n")).withColumn("_voted", _vote(own))
    # Only documents without a vote need their whole text looked at.
    docs = docs.withColumn("_read", detect_language(F.when(F.col("_voted").isNull(), F.col("_text")).otherwise(F.lit(""))))
    sources = F.transform(F.filter(own, lambda b: b["type"] == S.HEADING), lambda b: F.coalesce(b["heading_source"], F.lit("unknown")))
    kinds = F.array_sort(F.array_distinct(sources))
    counted = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(sources, lambda x: x == k)).cast("long")))
    out = docs.select(
        "document_id", F.coalesce("_voted", "_read").alias("language"), F.size(own).cast("long").alias("blocks"), F.aggregate(own, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"])).alias("chars"),
        F.when(F.size(kinds) > 0, counted).alias("heading_sources"), F.array_sort(F.array_distinct(F.transform(F.filter(own, lambda b: b["role"] == "image"), lambda b: b["page"]))).alias("pictures"),
        F.array_join(F.transform(F.filter(own, lambda b: b["title"]), lambda b: b["text"]), " ").alias("_title"),
    )
    if pages is not None:
        bad = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("number"))))
        seen = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), bad(F.col("needs_ocr")).alias("_scans"), bad(~F.col("needs_ocr") & (F.col("confidence") < UNSURE_PAGE)).alias("_unsure"), F.bool_or("needs_ocr").alias("needs_ocr"))
        out = out.join(seen, "document_id", "left")
    else:
        none = F.array().cast("array<int>")
        out = out.withColumns({"page_count": F.lit(None).cast("long"), "_scans": none, "_unsure": none, "needs_ocr": F.lit(False)})
    if meta is not None:
        out = out.join(meta.select("document_id", "source", F.col("title").alias("_given")), "document_id", "left")
    else:
        out = out.withColumns({"source": F.lit(None).cast("string"), "_given": F.lit(None).cast("string")})
    warn = lambda code, cond, p: F.when(cond, F.struct(F.lit(code).alias("code"), p.cast("array<int>").alias("pages")))
    nothing = F.lit(None).cast("array<int>")
    few = F.coalesce("chars", F.lit(0)) < LITTLE_TEXT
    warnings = F.array_compact(F.array(
        warn("no_text_layer", F.size("_scans") > 0, F.col("_scans")), warn("low_confidence_pages", F.size("_unsure") > 0, F.col("_unsure")), warn("pictures_not_read", F.size("pictures") > 0, F.col("pictures")),
        warn("language_uncertain", (F.col("language.language") == "unknown") & ~few, nothing), warn("little_or_no_text", few, nothing),
    ))
    title = F.coalesce(F.nullif("_title", F.lit("")), F.nullif("_given", F.lit("")))
    return out.select("document_id", "source", title.alias("title"), "language", "heading_sources", "page_count", "blocks", "chars", "needs_ocr", warnings.alias("warnings"))
