"""Schemas of the tables that stages hand to each other. Every table carries document_id and pos."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ROWS = "array<array<string>>"
SPANS = "array<struct<row:int,col:int,rows:int,cols:int>>"
LANGUAGE = "struct<language:string,script:string,confidence:double>"
RAW_BLOCKS = (
    f"document_id string, pos int, text string, page int, bbox {BOX}, font_size double, bold double, italic double, font string, "
    f"heading_level int, heading_source string, list_item boolean, rows {ROWS}, spans {SPANS}, role string, footnote boolean, "
    "footnote_refs array<string>, original string, spaced boolean, in_figure boolean, tagged boolean, layout_title boolean"
)
LINES = f"document_id string, page int, pos int, text string, bbox {BOX}, size double, bold double, italic double, chars int, original string, refs array<string>, block int, font string"
BLOCKS = (
    f"document_id string, pos int, type string, text string, page int, page_end int, level int, role string, rows {ROWS}, spans {SPANS}, items array<string>, "
    f"number string, footnote_refs array<string>, heading_source string, title boolean, bbox {BOX}, language {LANGUAGE}"
)
CHUNKS = (
    "chunk_id string, document_id string, text string, language string, script string, page_start int, page_end int, heading_path array<string>, "
    "chunk_index int, token_count long, metadata struct<content_type:string,content_types:array<string>,"
    f"tables:array<struct<header:{ROWS},rows:{ROWS},page:int,continued:boolean>>,is_appendix:boolean,source_title:string,language_source:string,footnotes:array<string>>"
)
HEADING, PARAGRAPH, LIST, TABLE, CODE, QUOTE, FOOTNOTE = "heading", "paragraph", "list", "table", "code", "quote", "footnote"
