"""Whole plans: from texts or files to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import chunking, documents, layout, profile, structure
from ..sources import text as readers
from .cuts import kept


def chunk_texts(texts: DataFrame, options: chunking.ChunkOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of plain texts: a paragraph for each line, then the fold. Each row is a document; nothing is shuffled."""
    return chunking.chunk_rows(texts, chunking.line_blocks, options, id_col, text_col)


def text_blocks(texts: DataFrame, options: structure.StructureOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of plain texts, a row a document."""
    return structure.build_rows(texts, readers.text_parts, options or structure.StructureOptions(page_layout=False), id_col, text_col)


def html_blocks(pages: DataFrame, options: structure.StructureOptions | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of web pages, a row a document."""
    return structure.build_rows(pages, readers.page_blocks, options or structure.StructureOptions(page_layout=False), id_col, html_col)


def chunk_html(pages: DataFrame, options: chunking.ChunkOptions | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """From a web page to its chunks in one pass: each page is parsed and structured once."""
    structured = structure.StructureOptions(page_layout=False)

    def read(html: str) -> list[dict]:
        blocks = list(structure.block_rows("", structure.build([structure.Raw.of(r) for r in readers.page_blocks(html)], structured)))
        if blocks:
            blocks[0]["_title"], blocks[0]["_language"] = documents.summary(blocks)
        return blocks

    return chunking.chunk_rows(pages, read, options, id_col, html_col)


def layout_passes(raw: DataFrame, heights: DataFrame) -> DataFrame:
    """Raw blocks of pages without furniture, with notes, title, imprint and contents pages marked.

    Each pass reads its blocks several times, so what a pass has made is kept before the next.
    """
    raw = kept(raw)
    raw = kept(layout.strip_furniture(raw, heights))
    raw = kept(layout.mark_imprint(layout.mark_title_page(layout.mark_footnotes(raw, heights), heights)))
    return kept(layout.mark_contents(raw, heights))


def pages_to_blocks(raw: DataFrame, heights: DataFrame, options: structure.StructureOptions | None = None, outline: DataFrame | None = None) -> DataFrame:
    raw = layout_passes(raw, heights)
    return structure.build_blocks(raw, options, outline, profile.style_profile(raw, heights))


def blocks_to_chunks(blocks: DataFrame, options: chunking.ChunkOptions | None = None, meta: DataFrame | None = None) -> DataFrame:
    docs = documents.assemble(blocks, meta=meta)
    return chunking.chunk(blocks, docs.select("document_id", "title", "language"), options)
