"""Other readers of raw blocks: plain text, and web pages with their headings, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A raw block for each run of lines between blank ones; native."""
    parts = docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\n(?:[ \t]*\n)+")).alias("pos", "text"))
    return parts.filter("trim(text) <> ''").select("document_id", "pos", "text", F.lit(1).alias("page"))


def text_parts(text: str) -> list[dict]:
    """What ``text_blocks`` makes of one text."""
    return [{"pos": k, "text": t, "page": 1} for k, t in enumerate(re.split(r"\n(?:[ \t]*\n)+", text)) if t.strip(" ")]


_SKIP, _BREAKS = ("script", "style", "nav", "footer", "head", "noscript"), ("p", "div", "article", "section", "br", "ul", "ol", "table", "header", "main", "body")


class _Page(HTMLParser):
    """Blocks of a page in order: headings by tag, list items, tables, paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text, self.kind, self.skip = "", {}, 0
        self.rows: list[list[str]] | None = None

    def _end(self) -> None:
        t = " ".join(self.text.split())
        if t and self.rows is None:
            self.out.append({"text": t, **self.kind})
        self.text, self.kind = ("", {}) if self.rows is None else (self.text, self.kind)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag == "table":
            self._end()
            self.rows, self.text = [], ""
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.text = ""
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._end()
            self.kind = {"heading_level": int(tag[1]), "heading_source": "tags"}
        elif tag == "li":
            self._end()
            self.kind = {"list_item": True}
        elif tag in _BREAKS:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.text = [r for r in self.rows if r], None, ""
            if rows:
                self.out.append({"text": "", "rows": rows})
        elif self.rows is not None:
            if tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append(" ".join(self.text.split()))
                self.text = ""
        elif tag in _BREAKS or tag == "li" or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text += data


def page_blocks(html: str) -> list[dict]:
    p = _Page()
    p.feed(html)
    p.close()
    p._end()
    return p.out


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    schema = StructType.fromDDL(S.RAW_BLOCKS)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, h in zip(b.column(0), b.column(1), strict=True):
                out += [{"document_id": i.as_py(), "pos": k, "page": 1, **r} for k, r in enumerate(page_blocks(h.as_py() or ""))]
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return pages.select(F.col(id_col).cast("string").alias("document_id"), F.col(html_col)).mapInArrow(rows, schema)


def conversation_texts(turns: DataFrame) -> DataFrame:
    """conv_id, text: a conversation's turns in order, a line each."""
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
