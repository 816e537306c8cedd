"""Regions that a layout model sees on a page, as corrections of the rules. The model itself is any function page -> regions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from .looks import Box, Raw
from .pages import GUTTER, SPAN, Line

# Kinds of regions by what they are to the rules.
FIGURES = frozenset({"image", "chart", "seal", "header_image", "footer_image"})
FORMULAS = frozenset({"formula", "formula_number"})
FURNITURE = frozenset({"header", "footer", "number"})
TITLES = frozenset({"paragraph_title", "doc_title"})
TEXT = TITLES | {"text", "abstract", "content", "reference", "aside_text", "footnote", "algorithm", "figure_title", "table_title", "chart_title"}


@dataclass(frozen=True)
class Region:
    kind: str
    score: float
    bbox: Box


@dataclass
class Hints:
    figures: list[Box] = field(default_factory=list)
    formulas: list[Box] = field(default_factory=list)
    furniture: list[Box] = field(default_factory=list)
    titles: list[Box] = field(default_factory=list)
    footnotes: list[Box] = field(default_factory=list)
    tables: list[Box] = field(default_factory=list)
    order: list[Box] | None = None


def inside(box: Box | None, region: Box) -> bool:
    return box is not None and region[0] <= (box[0] + box[2]) / 2 <= region[2] and region[1] <= (box[1] + box[3]) / 2 <= region[3]


def hints(regions: Iterable[Region], page: Box, issues: Sequence[str] = (), size: float = 10.0) -> Hints:
    """What the regions allow: furniture only near the page's ends, an order only where columns are the issue."""
    out, band = Hints(), 0.15 * (page[3] - page[1])
    regions = list(regions)
    for r in regions:
        by_kind = ((FIGURES, out.figures), (FORMULAS, out.formulas), ({"table"}, out.tables), (TITLES, out.titles), ({"footnote"}, out.footnotes))
        for kinds, where in by_kind:
            if r.kind in kinds:
                where.append(r.bbox)
        if r.kind in FURNITURE and (r.bbox[3] <= band or r.bbox[1] >= page[3] - page[1] - band):
            out.furniture.append(r.bbox)
    text = [r.bbox for r in regions if r.kind in TEXT]
    if "columns" in issues and len(text) > 1:
        out.order = xy_order(text, size)
    return out


def xy_order(boxes: Sequence[Box], size: float) -> list[Box]:
    """Reading order: wide boxes part bands, then columns, then sections."""
    boxes = list(boxes)
    if len(boxes) < 2:
        return boxes
    width = max(b[2] for b in boxes) - min(b[0] for b in boxes)
    wide = [b for b in boxes if b[2] - b[0] >= SPAN * width]
    if 0 < len(wide) < len(boxes):
        out, band = [], []
        for b in sorted(boxes, key=lambda b: b[1]):
            if b in wide:
                out += [*xy_order(band, size), b]
                band = []
            else:
                band.append(b)
        return out + xy_order(band, size)
    for axis in (0, 1):
        reach, best = None, None
        for lo, hi in sorted((b[axis], b[axis + 2]) for b in boxes):
            if reach is not None and lo - reach >= GUTTER * size and (best is None or lo - reach > best[1] - best[0]):
                best = (reach, lo)
            reach = hi if reach is None else max(reach, hi)
        if best:
            before = [(b[axis] + b[axis + 2]) < best[0] + best[1] for b in boxes]
            if any(before) and not all(before):
                return xy_order([b for b, x in zip(boxes, before, strict=True) if x], size) + xy_order([b for b, x in zip(boxes, before, strict=True) if not x], size)
    return sorted(boxes, key=lambda b: (b[1], b[0]))


def order_lines(lines: Sequence[Line], boxes: Sequence[Box]) -> list[list[Line]]:
    """Lines by their nearest region within three line heights; the others last."""
    groups: list[list[Line]] = [[] for _ in range(len(boxes) + 1)]
    for x in lines:
        cx, cy = (x.left + x.right) / 2, (x.top + x.bottom) / 2
        far = [(max(b[0] - cx, 0.0, cx - b[2]) ** 2 + max(b[1] - cy, 0.0, cy - b[3]) ** 2) ** 0.5 for b in boxes]
        k = min(range(len(far)), key=far.__getitem__) if far else -1
        groups[k if far and far[k] <= 3.0 * (x.bottom - x.top) else -1].append(x)
    return [g for g in groups if g]


def apply_marks(blocks: Iterable[Raw], found: Hints) -> None:
    """Formulas, titles and footnotes of the model on raw blocks of the page."""
    for b in blocks:
        if b.rows is not None or b.bbox is None:
            continue
        if any(inside(b.bbox, r) for r in found.formulas) and b.role is None and sum(len(w) >= 4 and w.isalpha() for w in b.text.split()) < 3:
            b.role = "formula"
        b.layout_title |= any(inside(b.bbox, r) for r in found.titles)
        b.footnote |= any(inside(b.bbox, r) for r in found.footnotes)
