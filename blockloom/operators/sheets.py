"""A page of a file with its drawings, grids and pictures to raw blocks; a tagged file's pages to raw blocks by their elements."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S
from . import grids, regions, tagged
from .looks import BIGGER, Box, Raw, flat
from .pages import Line, Stats, build_paragraphs, figure_regions, join_spread, layout_stats, reading_order, text_right
from .rows import Boxes

#: Shares of the smaller box: a grid that is another one, and one that a model's region already has.
SAME, FOUND = 0.8, 0.5
MARKS = f"document_id string, page int, width double, height double, drawings array<struct<bbox:{S.BOX},stroked:boolean,filled:boolean>>, pictures array<{S.BOX}>, grids array<struct<bbox:{S.BOX},rows:{S.ROWS},spans:{S.SPANS}>>, regions array<struct<kind:string,score:double,bbox:{S.BOX}>>, issues array<string>"
KEYS = ("x0", "y0", "x1", "y1")


def _box(b: dict | None) -> Box | None:
    return tuple(b[k] for k in KEYS) if b else None


def text_grid(lines: Sequence[Line], region: Box) -> list[list[str]]:
    """Cells of an unruled table: rows by height, columns where no line of the region reaches across."""
    own = sorted((x for x in lines if region[0] <= (x.left + x.right) / 2 <= region[2] and region[1] <= (x.top + x.bottom) / 2 <= region[3]), key=lambda x: (x.top, x.left))
    if not own:
        return []
    b = Boxes(own)
    level = b.level()
    row = np.zeros(len(own), int)
    for i in range(1, len(own)):
        row[i] = row[i - 1] + (not level[np.flatnonzero(row[:i] == row[i - 1])[0], i])
    spans: list[list[float]] = []
    for lo, hi in sorted(zip(b.left, b.right, strict=True)):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    out = [["" for _ in spans] for _ in range(int(row[-1]) + 1)]
    for x, r in zip(own, row, strict=True):
        c = next(k for k, (lo, hi) in enumerate(spans) if lo <= x.left <= hi)
        out[r][c] = f"{out[r][c]} {x.text}".strip()
    return out


def grid_score(rows: list[list[str]]) -> float:
    """As tables.table_score, for one grid: even rows, few empty cells, no cut words."""
    filled = [[c.strip() for c in r if c and c.strip()] for r in rows]
    sizes = [len(r) for r in filled if r]
    cells = sum(map(len, rows))
    if not sizes or not cells:
        return -1.0
    pairs = [(a, b) for r in filled for a, b in zip(r, r[1:], strict=False)]
    scrap = lambda b: len(b.split()) == 1 and len(b.split()[0]) <= 3 and b[0].islower()
    cut = sum(a[-1].isalpha() and (b[0] in ").,;:" or scrap(b)) for a, b in pairs)
    return max(map(sizes.count, sizes)) / len(sizes) - (1 - sum(sizes) / cells) - 2 * (cut / len(pairs) if pairs else 0)


def find_tables(lines: list[Line], found: Sequence[dict], drawings: Sequence[dict], boxes: Sequence[Box] = ()) -> tuple[list[Raw], list[Line]]:
    """(tables of a page, lines outside of them): the backend's grids where rules cross, aligned text without rules, regions of a model."""
    tables: list[Raw] = []
    if grids.rulings([(_box(d["bbox"]), bool(d["stroked"])) for d in drawings]) >= 2:
        for g in found:
            spans = g["spans"] or []
            rows = grids.fill_down([list(r) for r in g["rows"]], [(s["row"], s["col"], s["rows"], s["cols"]) for s in spans])
            if grids.is_table(rows):
                tables.append(Raw("", bbox=_box(g["bbox"]), rows=rows, spans=spans or None))
    for region in [*grids.aligned_regions(lines), *boxes]:
        rows = text_grid(lines, region)
        if not grids.is_table(rows):
            continue
        rivals = [t for t in tables if grids.overlap(t.bbox, region) >= (FOUND if region in boxes else SAME)]
        if all(grid_score(t.rows) < grid_score(rows) for t in rivals):  # where two readings cover one place, the better stays
            tables = [t for t in tables if t not in rivals] + [Raw("", bbox=region, rows=rows)]
    rects = [_box(d["bbox"]) for d in drawings]
    out = []
    for t in tables:
        t, lines = grids.grow(t, rects, lines)
        lines = [x for x in lines if not regions.inside(x.bbox, t.bbox)]
        out.append(t)
    return out, lines


def page_raws(lines: list[Line], page: int, mark: dict, stats: Stats, detect_tables: bool = True) -> list[Raw]:
    """Raw blocks of one page by the rules, corrected by what a model saw."""
    box = (0.0, 0.0, mark.get("width") or 0.0, mark.get("height") or 0.0)
    seen = [regions.Region(r["kind"], r["score"], _box(r["bbox"])) for r in mark.get("regions") or ()]
    hint = regions.hints(seen, box, mark.get("issues") or (), stats.body_size)
    lines = [x for x in lines if not any(regions.inside(x.bbox, f) for f in hint.furniture)]
    drawings = mark.get("drawings") or []
    tables, lines = find_tables(lines, mark.get("grids") or [], drawings, hint.tables) if detect_tables else ([], lines)
    if len(lines) > 1:
        lines = join_spread(lines, text_right(lines, stats))
    figures = [*figure_regions([_box(d["bbox"]) for d in drawings], box, stats.body_size, lines), *hint.figures]
    filled = [_box(d["bbox"]) for d in drawings if d["filled"] and min(d["bbox"]["x1"] - d["bbox"]["x0"], d["bbox"]["y1"] - d["bbox"]["y0"]) > 2.0]
    parts = regions.order_lines(lines, hint.order) if hint.order else reading_order(lines, filled, stats.body_size)
    out = [b for part in parts for b in build_paragraphs(part, page, stats, figures)]
    regions.apply_marks(out, hint)
    pictures = grids.inline_pictures([_box(b) for b in mark.get("pictures") or ()], lines, [t.bbox for t in tables], box)
    out = grids.place(grids.place(out, tables), pictures)
    for b in out:
        b.page = page
    return out


def _rows(document_id: str, blocks: Sequence[Raw], start: int = 0) -> list[dict]:
    return [{**b.__dict__, "document_id": document_id, "pos": start + i, "bbox": dict(zip(KEYS, b.bbox, strict=True)) if b.bbox else None} for i, b in enumerate(blocks)]


def _line(r: dict) -> Line:
    return Line(r["text"] or "", _box(r["bbox"]), r["size"], r["bold"] or 0.0, r["italic"] or 0.0, r["chars"] or 0, r["original"] or "", r["refs"] or [], r["block"] or 0, r["font"] or "")


def _stats(r: dict) -> Stats:
    return Stats(r["body_size"], r["line_gap"], r["right_edge"], r["line_blocks"]) if r.get("body_size") else Stats()


def sheet_blocks(lines: DataFrame, marks: DataFrame, detect_tables: bool = True) -> DataFrame:
    """Raw blocks of pages; ``lines`` as in schema.LINES, ``marks`` as in MARKS: a page is one group of both."""
    schema = StructType.fromDDL(S.RAW_BLOCKS)
    arrow = to_arrow_schema(schema)
    full = marks.join(layout_stats(lines), "document_id", "left")

    def one(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows, mark = sorted(texts.to_pylist(), key=lambda r: r["pos"]), (found.to_pylist() or [{}])[0]
        document, page = (rows[0]["document_id"], rows[0]["page"]) if rows else (mark["_document"], mark["_page"])
        made = page_raws([x for x in map(_line, (r for r in rows if r["bbox"])) if x.text.strip()], page, mark, _stats(mark), detect_tables)
        return pa.Table.from_pylist(_rows(document, made, page * 100_000), schema=arrow)

    columns = [f.name for f in StructType.fromDDL(S.LINES).fields]
    return lines.select(*columns).groupBy("document_id", "page").cogroup(full.withColumnsRenamed({"document_id": "_document", "page": "_page"}).groupBy("_document", "_page")).applyInArrow(one, schema)


def tagged_blocks(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """(document_id, reason, raw_blocks): what a document's tags give, or why they can't be trusted (then no blocks)."""
    raw = StructType.fromDDL(S.RAW_BLOCKS).simpleString()
    schema = StructType.fromDDL(f"document_id string, reason string, raw_blocks array<{raw}>")
    arrow = to_arrow_schema(schema)
    full = lines.join(heights.select("document_id", "page", F.col("height").alias("_height")), ["document_id", "page"], "left").join(layout_stats(lines), "document_id", "left")

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["page"], r["pos"]))
        stats, by_page = _stats(rows[0]), {}
        for r in rows:
            by_page.setdefault(r["page"], []).append(r)
        read = {p: tagged.page_units([(_line(r), tuple(tagged.Node(n["kind"], n["index"]) for n in r["path"] or ())) for r in own if r["bbox"]], own[0]["_height"] or 0.0) for p, own in by_page.items()}
        ok, reason = tagged.trust([units for units, _ in read.values()], sum(r["chars"] or 0 for r in rows), stats.line_gap)
        made: list[Raw] = []
        if ok:
            made = tagged.join_pages([beside([(u.path, tagged.unit_block(u, p)) for u in units], build_paragraphs(loose, p, stats)) for p, (units, loose) in read.items()])
            tagged.mark_spacing(made, stats)
            tagged.mark_subheadings(made)
        return pa.Table.from_pylist([{"document_id": rows[0]["document_id"], "reason": reason, "raw_blocks": _rows(rows[0]["document_id"], made)}], schema=arrow)

    return full.groupBy("document_id").applyInArrow(one, schema)


def beside(blocks: list[tuple], loose: Sequence[Raw]) -> list[tuple]:
    """Blocks outside of all elements go before the first element that starts below them."""
    out = list(blocks)
    for b in loose:
        top = b.bbox[1] if b.bbox else 0.0
        out.insert(next((i for i, (_, x) in enumerate(out) if x.bbox and x.bbox[1] > top), len(out)), (None, b))
    return out


# ---- titles --------------------------------------------------------------------------------------


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def cover_title(blocks: Sequence[dict]) -> str | None:
    """The largest lines of a title page, in order."""
    cover = [b for b in blocks if b["role"] == "title_page" and b["font_size"] and b["text"].strip()]
    top = max((b["font_size"] for b in cover), default=0.0)
    return " ".join(flat(b["text"]) for b in cover if b["font_size"] * BIGGER >= top) or None


def document_title(given: str | None, blocks: Sequence[dict]) -> str | None:
    """A file's own title if its first pages say it; of it and the cover's the fuller one."""
    cover, said = cover_title(blocks), _words(given or "")
    if said:
        early = " ".join(" ".join(_words(b["text"])) for b in blocks if b["page"] <= 3)
        first = {w for b in blocks if b["page"] == 1 for w in _words(b["text"])}
        if " ".join(said) not in early and not (len(said) >= 3 and set(said) <= first):
            said = []
    if not cover:
        return flat(given) if said else None
    return flat(given) if said and set(_words(cover)) <= set(said) else cover
