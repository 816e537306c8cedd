"""PDF files through a backend: any function bytes -> pages of spans, drawings, pictures and grids, with bookmarks and tags.

No backend ships with this package; ``read_files`` takes one. Without it every file is an error row, as the engine knows of the
file but can't read it. All that follows from what a backend sees is here and in plans.pages, on plain records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions import fonts, normalize, symbols

#: bytes -> {"title", "author", "outline": [{level, title, page}], "pages": [see PAGE]}; raises PermissionError for a locked file.
Backend = Callable[[bytes], dict]

SPAN = f"struct<block:int,line:int,text:string,bbox:{S.BOX},size:double,font:string,superscript:boolean,path:array<struct<kind:string,index:int>>>"
GRID = f"struct<bbox:{S.BOX},rows:{S.ROWS},spans:{S.SPANS}>"
DRAWING = f"struct<bbox:{S.BOX},stroked:boolean,filled:boolean>"
PAGE = f"struct<number:int,width:double,height:double,spans:array<{SPAN}>,drawings:array<{DRAWING}>,pictures:array<{S.BOX}>,grids:array<{GRID}>,image:binary>"
FILE = f"path string, document_id string, title string, author string, error struct<code:string,message:string>, outline array<struct<level:int,title:string,page:int>>, pages array<{PAGE}>"


def read(path: str, data: bytes, backend: Backend | None) -> dict:
    """One file: what the backend sees, or an error."""
    fail = lambda code, message: {"path": path, "document_id": path, "error": {"code": code, "message": message}, "pages": []}
    if not data:
        return fail("empty", f"empty file: {path}")
    if backend is None:
        return fail("backend_missing", "no PDF backend was given")
    try:
        return {"path": path, "document_id": path, **backend(data)}
    except PermissionError as e:
        return fail("locked", f"the file needs a password: {e}")
    except Exception as e:  # a backend's own error says that this file is damaged
        return fail("damaged", f"{type(e).__name__}: {e}")


def read_files(files: DataFrame, backend: Backend | None = None) -> DataFrame:
    """One row for each file of a binaryFile DataFrame; see FILE."""
    schema = StructType.fromDDL(FILE)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path"), b.column("content"), strict=True):
                yield from pa.Table.from_pylist([read(path.as_py(), data.as_py() or b"", backend)], schema=arrow).to_batches()

    return files.select("path", "content").mapInArrow(rows, schema)


def pages(read: DataFrame) -> DataFrame:
    """A row for each page."""
    return read.filter("error is null").select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.number").alias("page"), "p.width", "p.height", "p.drawings", "p.pictures", "p.grids", "p.image", "p.spans")


def _mapped(text: Column, font: Column) -> Column:
    def one(t: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([symbols.map_symbol_font(x or "", y or "")[0] for x, y in zip(t, f, strict=True)], dtype=object)

    return F.pandas_udf(one, "string")(text, font)


def lines(pages: DataFrame) -> DataFrame:
    """schema.LINES with path, from the spans of pages: raised numbers behind words are footnote marks, symbol fonts get their signs."""
    s = pages.select("document_id", "page", F.posexplode("spans").alias("n", "s")).select("document_id", "page", "n", "s.*")
    s = s.withColumns({"size": F.coalesce("size", F.lit(0.0)), "font": F.coalesce("font", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    s = s.withColumn("text", F.when(fonts.symbol_span(F.col("text"), F.col("font")), _mapped(F.col("text"), F.col("font"))).otherwise(F.col("text")))
    own = Window.partitionBy("document_id", "page", "block", "line")
    before = F.concat_ws("", F.collect_list("text").over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumns({"_before": before, "_size": F.max("size").over(own), "_base": F.max("bbox.y1").over(own)})
    s = s.withColumn("mark", F.coalesce(fonts.reference_mark(F.col("text"), F.col("_before"), F.coalesce("superscript", F.lit(False)), F.col("size"), F.col("_size"), F.col("bbox.y1"), F.col("_base")), F.lit(False)))
    kept = ~F.col("mark")
    chars = F.when(kept, F.char_length(F.regexp_replace("text", r"(?U)\s", ""))).otherwise(0)
    s = s.withColumn("chars", chars.cast("int"))
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("chars")).otherwise(0)) / F.nullif(F.sum("chars"), F.lit(0)), F.lit(0.0))
    edge = lambda f, c: f(F.when(kept, F.col(f"bbox.{c}")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("n", "text")))), lambda x: x["text"]), "")
    out = s.groupBy("document_id", "page", "block", "line").agg(
        F.min("n").alias("pos"), text.alias("original"), F.struct(edge(F.min, "x0").alias("x0"), edge(F.min, "y0").alias("y0"), edge(F.max, "x1").alias("x1"), edge(F.max, "y1").alias("y1")).alias("bbox"),
        F.max(F.when(kept, F.col("size"))).alias("size"), share(fonts.is_bold(F.col("font"))).alias("bold"), share(fonts.is_italic(F.col("font"))).alias("italic"), F.sum("chars").cast("int").alias("chars"),
        F.max_by(fonts.family(F.col("font")), F.struct("chars", -F.col("n"))).alias("font"), F.sort_array(F.collect_list(F.when(F.col("mark"), F.struct("n", F.trim("text").alias("t"))))).alias("_refs"), F.min_by("path", "n").alias("path"),
    )
    out = out.filter("trim(original) <> ''").withColumn("_clean", normalize.clean_text(F.col("original")))
    return out.select("document_id", "page", "pos", F.col("_clean.text").alias("text"), "bbox", "size", "bold", "italic", "chars", "original", F.col("_refs.t").alias("refs"), "block", "font", "path").filter("trim(text) <> ''")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """(document_id, page, needs_ocr): pages whose text is in pictures."""
    area = F.aggregate("pictures", F.lit(0.0), lambda a, b: a + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    chars = F.aggregate("spans", F.lit(0), lambda n, s: n + F.char_length(F.regexp_replace(s["text"], r"(?U)\s", "")))
    flag = fonts.scanned(area, F.col("width") * F.col("height"), F.size("pictures"), chars)
    return pages.select("document_id", "page", F.coalesce(flag, F.lit(False)).alias("needs_ocr"))
