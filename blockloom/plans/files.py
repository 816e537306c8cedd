"""From files to documents, blocks and chunks: readers by suffix, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import documents, pages, profile, sheets, structure
from ..operators.chunking import ChunkOptions, chunk
from ..sources import docx, pdf
from . import layout_passes
from .cuts import kept

#: loads a layout model, once for each worker: image of a page -> [(kind, score, box)]
Model = Callable[[], Callable[[bytes], list[tuple[str, float, tuple[float, float, float, float]]]]]
_loaded: dict[int, Callable] = {}


@dataclass(frozen=True)
class ReadOptions:
    """``fail_fast``: the first bad file ends the job, instead of a row that tells its error."""

    pdf_backend: pdf.Backend | None = None
    layout_model: Model | None = None
    detect_tables: bool = True
    fail_fast: bool = False
    structure: structure.StructureOptions = structure.StructureOptions()


class Parsed(NamedTuple):
    """``files``: path, document_id, title, route, error; ``blocks`` as in schema.BLOCKS; ``pages``: number, needs_ocr, confidence, issues."""

    files: DataFrame
    blocks: DataFrame
    pages: DataFrame

    def documents(self) -> DataFrame:
        seen = self.pages.select("document_id", F.col("page").alias("number"), "needs_ocr", "confidence")
        return documents.assemble(self.blocks, seen, self.files.select("document_id", F.col("path").alias("source"), "title"))

    def chunks(self, options: ChunkOptions | None = None) -> DataFrame:
        return chunk(self.blocks, self.documents().select("document_id", "title", "language"), options)


def _seen(pages_: DataFrame, model: Model) -> DataFrame:
    """(document_id, page, regions) of pages that a model looks at; the model is loaded once in a worker."""
    schema = f"document_id string, page int, regions array<struct<kind:string,score:double,bbox:{S.BOX}>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _loaded.setdefault(id(model), None) or model()
        _loaded[id(model)] = look
        kind = pa.list_(pa.struct([("kind", pa.string()), ("score", pa.float64()), ("bbox", pa.struct([(k, pa.float64()) for k in sheets.KEYS]))]))
        for b in batches:
            found = [[{"kind": k, "score": s, "bbox": dict(zip(sheets.KEYS, box, strict=True))} for k, s, box in look(i.as_py())] if i.is_valid else [] for i in b.column("image")]
            yield pa.RecordBatch.from_arrays([b.column("document_id"), b.column("page"), pa.array(found, kind)], names=["document_id", "page", "regions"])

    return pages_.select("document_id", "page", "image").mapInArrow(rows, schema)


def _pdf(read: DataFrame, options: ReadOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, pages, document_id with route) of PDF files: by their tags where they can be trusted, else by the rules."""
    every = pdf.pages(read)
    lines = kept(pdf.lines(every))
    heights = every.select("document_id", "page", "height")
    plain = [f for f in lines.columns if f != "path"]
    has_tags = lines.groupBy("document_id").agg(F.max(F.size("path") > 0).alias("t")).filter("t").select("document_id")
    by_tags = kept(sheets.tagged_blocks(lines.join(has_tags, "document_id", "left_semi"), heights))
    route = read.filter("error is null").select("document_id").join(by_tags.select("document_id", "reason"), "document_id", "left")
    route = route.select("document_id", F.when(F.col("reason") == "", "tags").when(F.col("reason").isNull(), "rules").otherwise(F.concat(F.lit("rules: "), "reason")).alias("route"))
    trusted = by_tags.filter("reason = ''")
    rest = lines.select(*plain).join(trusted.select("document_id"), "document_id", "left_anti")
    marks = every.join(trusted.select("document_id"), "document_id", "left_anti").drop("spans", "image").withColumns({"regions": F.lit(None).cast(f"array<struct<kind:string,score:double,bbox:{S.BOX}>>"), "issues": F.lit(None).cast("array<string>")})
    raw = kept(sheets.sheet_blocks(rest, marks, options.detect_tables))
    rated = kept(pages.page_confidence(rest, raw, profile.style_profile(raw, heights)))
    if options.layout_model:  # only pages that the rules are unsure of are looked at, and only these are built again
        unsure = rated.filter(F.col("confidence") < documents.UNSURE_PAGE).select("document_id", "page", "issues")
        seen = _seen(every.join(unsure.select("document_id", "page"), ["document_id", "page"], "left_semi"), options.layout_model)
        again = marks.drop("regions", "issues").join(unsure, ["document_id", "page"]).join(seen, ["document_id", "page"])
        keys = again.select("document_id", "page")
        # statistics are the whole document's, so its lines go along; pages without marks are dropped
        better = sheets.sheet_blocks(rest, again, options.detect_tables).join(keys, ["document_id", "page"], "left_semi")
        raw = raw.join(keys, ["document_id", "page"], "left_anti").unionByName(better)
    raw = layout_passes(raw, heights)
    outline = read.filter("error is null").select("document_id", F.posexplode("outline").alias("pos", "o")).select("document_id", "pos", "o.*")
    by_rules = structure.build_blocks(raw, options.structure, outline, profile.style_profile(raw, heights))
    tagged_raw = trusted.select(F.explode("raw_blocks").alias("r")).select("r.*")
    flow = structure.StructureOptions(False, options.structure.text_is_clean, options.structure.lexicon)
    blocks = kept(by_rules.unionByName(structure.build_blocks(tagged_raw, flow, outline)))
    scans = pdf.needs_ocr(every)
    facts = scans.join(rated, ["document_id", "page"], "left")
    confidence = F.when(F.col("needs_ocr"), 0.0).otherwise(F.coalesce("confidence", F.lit(1.0)))
    issues = F.when(F.col("needs_ocr"), F.array(F.lit("no_text"))).otherwise(F.coalesce("issues", F.array().cast("array<string>")))
    titles = _titles(read, raw.unionByName(tagged_raw))
    return blocks, facts.select("document_id", "page", "needs_ocr", confidence.alias("confidence"), issues.alias("issues")), route.join(titles, "document_id", "left")


def _titles(read: DataFrame, raw: DataFrame) -> DataFrame:
    """(document_id, title) of PDF files, from their facts and first pages."""
    early = raw.filter("page <= 3").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "page", "role", "font_size"))).alias("b"))
    full = early.join(read.select("document_id", F.col("title").alias("given")), "document_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sheets.document_title(g.as_py(), x.as_py()) for g, x in zip(b.column("given"), b.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("document_id"), pa.array(found, pa.string())], names=["document_id", "title"])

    return full.select("document_id", "given", "b").mapInArrow(rows, "document_id string, title string")


def parse(files: DataFrame, options: ReadOptions | None = None) -> Parsed:
    """Files (path, content) of any suffix: each goes to its reader; what no reader takes is a row with an error."""
    options = options or ReadOptions()
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    files = files.select("path", "content")
    is_pdf = suffix == "pdf"
    word = docx.read_files(files.filter(~is_pdf), "FAILFAST" if options.fail_fast else "PERMISSIVE")
    read = pdf.read_files(files.filter(is_pdf), options.pdf_backend)
    if options.fail_fast:
        read = read.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error.message")).cast("struct<code:string,message:string>")))
    word, read = kept(word), kept(read)  # each file is read once
    blocks, seen, found = _pdf(read, options)
    flow = structure.StructureOptions(False, options.structure.text_is_clean, options.structure.lexicon)
    word_blocks = kept(structure.build_blocks(docx.raw_blocks(word), flow))
    facts = word.select("path", "document_id", "title", F.when(F.col("error").isNull(), "docx").alias("route"), "error")
    pdf_facts = read.select("path", "document_id", "error").join(found, "document_id", "left").select("path", "document_id", "title", "route", "error")
    word_pages = word.filter("error is null").select("document_id", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)))).alias("page"), F.lit(False).alias("needs_ocr"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("issues"))
    return Parsed(facts.unionByName(pdf_facts), word_blocks.unionByName(blocks), word_pages.unionByName(seen))


def to_dict(parsed: Parsed) -> DataFrame:
    """document_id, json: a document with its pages and blocks in order as one JSON value."""
    bs = parsed.blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "text", "page", "page_end", "level", "role", "rows", "items", "number", "heading_source", "title"))).alias("blocks"))
    ps = parsed.pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("number"), "needs_ocr", "confidence", "issues"))).alias("pages"))
    docs = parsed.documents().drop("blocks")
    return docs.join(bs, "document_id", "left").join(ps, "document_id", "left").select("document_id", F.to_json(F.struct(*[c for c in docs.columns if c != "document_id"], "pages", "blocks")).alias("json"))
