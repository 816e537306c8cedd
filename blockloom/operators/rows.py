"""Lines of a page put back into rows: pieces that stand beside each other and were stored apart.

The lines' boxes are columns. Which lines stand on one row, and which are beside each other, are matrices or shifts of those
columns; a row is then judged as a whole from its own measures.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from .looks import Box, flat, half_point

# A number or a marker alone on its row, a leader's end, a page number, operators of formulas.
NUMBER = re.compile(r"\s*(?:\d{1,3}(?:\.\d{1,3})*\.?|[IVXLC]{1,6}\.?|(?:\d{1,3}|[IVXLC]{1,6})\s*-\s*[^\W\d_]+[.:]?)\s*")
MARKER = re.compile(r"\s*(?:\d{1,3}[.)]|[^\W\d_]\)|[•·▪●○■◦–—\-*✓✔➢➤►▶◆❖□])\s*")
LEADER = re.compile(r"(?:\.{3,}|…)\s*$")
PAGE = re.compile(r"\s*\d{1,4}\s*")
OPERATOR = re.compile(r"[=<>±×÷∑∏√∫≈≠≤≥]")
#: In sizes of the text: the gap within a row of scraps, between words of a stretched row, and the slack at its edges.
NEAR, SPREAD, INDENT, SHORT = 3.0, 8.0, 4.0, 4.0
TOUCH, ONE_SIZE = 1.0, 0.05


@dataclass
class Line:
    text: str
    bbox: Box
    size: float | None = None
    bold: float = 0.0
    italic: float = 0.0
    chars: int = 0
    original: str = ""
    refs: list[str] = field(default_factory=list)
    block: int = 0
    font: str = ""

    left = property(lambda s: s.bbox[0])
    top = property(lambda s: s.bbox[1])
    right = property(lambda s: s.bbox[2])
    bottom = property(lambda s: s.bbox[3])
    width = property(lambda s: s.bbox[2] - s.bbox[0])


def debris(text: str) -> bool:
    """A scrap of a formula or chart: a few signs without a word, or an operator with hardly any words."""
    t = flat(text)
    return bool(t) and ((len(t) <= 5 and not re.search(r"[^\W\d_]{3,}", t)) or _calculates(t))


def _calculates(t: str) -> bool:
    return bool(OPERATOR.search(t)) and len(re.findall(r"[^\W\d_]{4,}", t)) < 2 and t[-1] != ":" and not set(t) & set("[]{};")


class Boxes:
    """Columns of some lines, and how each two of them lie."""

    def __init__(self, lines: Sequence[Line]) -> None:
        self.left, self.top, self.right, self.bottom = np.array([x.bbox for x in lines], float).reshape(-1, 4).T
        self.size = np.array([x.size or 10.0 for x in lines])
        self.height = self.bottom - self.top

    def level(self) -> np.ndarray:
        """Do two lines share half of the lower one's height?"""
        shared = np.minimum(self.bottom[:, None], self.bottom) - np.maximum(self.top[:, None], self.top)
        least = np.minimum(self.height[:, None], self.height)
        return shared >= 0.5 * np.where(least == 0, 1.0, least)

    def before(self) -> np.ndarray:
        """Does the first line end where the second begins, or before?"""
        return self.left >= self.right[:, None] - TOUCH


def merged(pieces: Sequence[Line]) -> Line:
    """One line of pieces from left to right; its look is that of the piece that adds most."""
    total = np.cumsum([p.chars for p in pieces])
    lead = max((k for k, p in enumerate(pieces) if not k or p.chars >= total[k - 1]), default=0)
    tops, bottoms = (min(p.top for p in pieces), max(p.bottom for p in pieces))
    return replace(pieces[lead], text=" ".join(p.text for p in pieces), bbox=(min(p.left for p in pieces), tops, pieces[-1].right, bottoms), chars=int(total[-1]), original=" ".join(p.original for p in pieces), refs=[r for p in pieces for r in p.refs], block=pieces[0].block)


def formula_rows(lines: list[Line]) -> list[Line]:
    """Scraps at the height of a sentence become part of it, if together they make one row without wide gaps."""
    scrap = np.array([debris(x.text) for x in lines], bool)
    if not scrap.any() or scrap.all():
        return lines
    b = Boxes(lines)
    middle, half = (b.top + b.bottom) / 2, 0.5 * b.height
    within = (b.top - half)[:, None] <= middle
    within &= middle <= (b.bottom + half)[:, None]
    on_row = b.level() & (b.before() | b.before().T)
    candidate = within & (scrap | on_row) & ~np.eye(len(lines), dtype=bool)
    owner, free = np.arange(len(lines)), np.ones(len(lines), bool)
    for i in np.flatnonzero(~scrap & candidate.any(1)):
        if not free[i]:
            continue
        row = np.append(i, np.flatnonzero(candidate[i] & free))
        row = row[np.argsort(b.left[row], kind="stable")]
        gap = b.left[row][1:] - b.right[row][:-1]
        if scrap[row].any() and (gap >= -TOUCH).all() and (gap <= NEAR * b.size[row].max()).all():
            owner[row], free[row] = i, False
    out = []
    for i in np.flatnonzero(owner == np.arange(len(lines))):
        mine = np.flatnonzero(owner == i)
        out.append(merged([lines[k] for k in mine[np.argsort(b.left[mine], kind="stable")]]) if len(mine) > 1 else lines[i])
    return out


def _glued(so_far: Line, piece: Line, scraps: tuple[bool, bool]) -> bool:
    """Does a piece to the right belong to what stands left of it: a title to its number, a page to its leader, a scrap to its formula?"""
    titled = NUMBER.fullmatch(so_far.text) or MARKER.fullmatch(so_far.text)
    paged = PAGE.fullmatch(piece.text) and LEADER.search(so_far.text)
    close = piece.left - so_far.right <= NEAR * (so_far.size or piece.size or 10.0)
    return bool(titled or paged or (close and (any(scraps) or debris(so_far.text))))


def gather_rows(lines: list[Line]) -> list[Line]:
    """Numbers and markers with their titles, leaders with their pages, scraps with their sentences."""
    lines = formula_rows(lines)
    scrap = [debris(x.text) for x in lines]
    rows: list[list[int]] = []
    for i, x in enumerate(lines):
        so_far = merged([lines[k] for k in rows[-1]]) if rows else None
        if so_far is not None:
            pair = Boxes([so_far, x])
            if pair.level()[0, 1] and pair.before()[0, 1] and _glued(so_far, x, (scrap[i - 1], scrap[i])):
                rows[-1].append(i)
                continue
        rows.append([i])
    return [merged([lines[k] for k in r]) if len(r) > 1 else lines[r[0]] for r in rows]


def _near_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) <= ONE_SIZE * np.maximum(a, b)


def join_spread(lines: list[Line], right: float) -> list[Line]:
    """Justified rows that were stored word by word are one line again, where the text above or below is as wide."""
    if len(lines) < 2:
        return lines
    b = Boxes(lines)
    beside = b.level() & (b.before() | b.before().T)
    start = [0]
    for i in range(1, len(lines)):  # a row goes on as long as each line of it is beside the new one
        if not beside[start[-1] : i, i].all():
            start.append(i)
    ends = [*start[1:], len(lines)]
    rows = [np.arange(s, e)[np.argsort(b.left[s:e], kind="stable")] for s, e in zip(start, ends, strict=True)]
    # measures of each row
    own = np.array([x.size or 0.0 for x in lines])
    first, last = np.array([r[0] for r in rows]), np.array([r[-1] for r in rows])
    even = np.array([own[r].max() - own[r].min() <= ONE_SIZE * own[r].max() for r in rows])
    words = np.array([len(x.text.split()) for x in lines])
    single = np.array([(words[r[1:-1]] <= 1).all() for r in rows])
    size, many = b.size[first], np.array([len(r) > 1 for r in rows])
    widest = np.array([(b.left[r][1:] - b.right[r][:-1]).max(initial=-np.inf) for r in rows])
    weight: dict[float, int] = {}
    for x in lines:
        weight[half_point(x.size)] = weight.get(half_point(x.size), 0) + x.chars
    main = max(weight, key=weight.__getitem__)
    edge = min(x.left for x in lines if half_point(x.size) == main)
    at_edge = b.left[first] <= edge + INDENT * size
    stretched = many & even & single & (widest <= SPREAD * size) & at_edge & (b.right[last] >= right - SHORT * size)
    # the row above or below: the same size, near, and a full line or another stretched row
    full = (~many & at_edge) | stretched
    top, bottom = b.top[first], b.bottom[first]
    apart = np.maximum(top[1:] - bottom[:-1], top[:-1] - bottom[1:])
    alike = _near_equal(own[first][1:], own[first][:-1])
    below = np.append(alike & (apart <= size[:-1]) & full[1:], False)
    above = np.append(False, alike & (apart <= size[1:]) & full[:-1])
    out: list[Line] = []
    for r, s, e, join in zip(rows, start, ends, stretched & (above | below), strict=True):
        if not join:
            out += lines[s:e]
            continue
        chars = np.array([lines[k].chars for k in r])
        share = lambda what, r=r, n=max(1, int(chars.sum())): sum(what(lines[k]) * lines[k].chars for k in r) / n
        out.append(replace(merged([lines[k] for k in r]), bold=share(lambda x: x.bold), italic=share(lambda x: x.italic)))
    return out
