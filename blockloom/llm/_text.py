"""Whole-batch tokenisation: words and their 64-bit hashes from UTF-8 buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_BYTE_LOW = _BYTE[LOWER]
#: A second, independent value of each byte.
_OTHER = mix(np.arange(1001, 1257, dtype=_U) * _U(0xD1342543DE82EF95))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, CHUNK), _BASE if which == "up" else _INVERSE, _U)
        step[0] = 1
        have = _powers[which] = np.cumprod(step, dtype=_U)
    return have[:n]


def slices(column: pa.ChunkedArray | pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about ``most`` bytes; null is empty; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def pieces(column: pa.ChunkedArray | pa.Array, overlap: int, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, row offsets, place of the bytes in their text): as slices, but a longer text comes in pieces.

    A piece has the ``overlap`` bytes after it as well, so that each string of overlap + 1 bytes is whole in exactly one piece.
    """
    for lo, hi, data, offs in slices(column, most):
        if hi - lo > 1 or len(data) <= 2 * most:
            yield lo, data, offs, 0
            continue
        for at in range(0, max(1, len(data) - overlap), most):
            part = data[at : at + most + overlap]
            yield lo, part, np.array([0, len(part)]), at


def word_starts(data: np.ndarray, most: int = 4 * CHUNK) -> np.ndarray:
    """Where the words of one text begin, found a part of the bytes at a time."""
    out, before = [np.zeros(0, np.int64)], False
    for at in range(0, len(data), most):
        solid = ~SPACE[data[at : at + most]]
        out.append(at + np.flatnonzero(solid & ~np.r_[before, solid[:-1]]))
        before = bool(solid[-1])
    return np.concatenate(out)


def word_pieces(column: pa.ChunkedArray | pa.Array, every: int, overlap: int = 0, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end row, bytes, row offsets, more): as slices, but a longer text comes in pieces of ``every`` words.

    A piece has the ``overlap`` words after it as well; ``more`` says that it belongs to the row of the piece before.
    """
    for lo, hi, data, offs in slices(column, most):
        starts = word_starts(data) if hi - lo == 1 and len(data) > 2 * most else ()
        if len(starts) <= every + overlap:
            yield lo, hi, data, offs, False
            continue
        for k in range(0, len(starts), every):
            if k and len(starts) - k <= overlap:
                break
            part = data[starts[k] : starts[k + every + overlap] if k + every + overlap < len(starts) else len(data)]
            yield lo, hi, part, np.array([0, len(part)]), k > 0


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of each run of non-space bytes; a run never crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal (A-Z folded) bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum((_BYTE_LOW if lower else _BYTE)[data] * _power("up", n), dtype=_U, out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def _raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_LOW[data] * _power("up", len(data)), dtype=_U, out=total[1:])
    return (total[ends] - total[starts]) * _power("down", len(data) + 1)[starts]


def word_hashes(data: np.ndarray, offs: np.ndarray, most: int = 4 * CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word, as words and span_hashes give them, a part of the bytes at a time."""
    rows, raws, sizes, open_ = [], [], [], None
    for at in range(0, len(data), most):
        part = data[at : at + most]
        edges = np.unique(np.clip(offs, at, at + len(part))) - at
        starts, ends, _ = words(part, edges)
        raw, size = _raw_hashes(part, starts, ends), ends - starts
        row = np.searchsorted(offs, at + starts, "right") - 1
        if open_ is not None and len(starts) and starts[0] == 0 and row[0] == rows[-1][-1]:  # a word that the cut went through
            whole = int(raws[-1][-1]) + int(raw[0]) * pow(_BASE, int(sizes[-1][-1]), 1 << 64)
            raws[-1][-1] = _U(whole & ((1 << 64) - 1))
            sizes[-1][-1] += size[0]
            row, raw, size = row[1:], raw[1:], size[1:]
            if not len(row) and ends[0] == len(part):
                continue  # the whole part is inside one word
        if len(row):
            rows.append(row)
            raws.append(raw)
            sizes.append(size)
        open_ = True if rows and len(ends) and ends[-1] == len(part) else None
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(rows), mix(np.concatenate(raws) + np.concatenate(sizes).astype(_U) * _U(0xD6E8FEB86659FD93))


def counts_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def shingles(wh: np.ndarray, row: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a row with fewer words has its whole sequence as one."""
    counts = counts_by_row(row, n_rows)
    first = np.cumsum(counts) - counts
    h = np.zeros(len(wh), _U)
    step = _U(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        coef = _U(1)
        m = len(wh)
        for j in range(min(size, m)):
            h[: m - j] += wh[j:] * coef
            coef = _U((int(coef) * int(step)) & ((1 << 64) - 1))
        at = np.arange(m) - first[row]
        whole = at <= (counts[row] - size)
        out_row, out_h = row[whole], mix(h[whole])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            tail = np.zeros(len(short), _U)
            for i, r in enumerate(short):
                coef = 1
                for x in wh[first[r] : first[r] + counts[r]]:
                    tail[i] += x * _U(coef)
                    coef = (coef * int(step)) & ((1 << 64) - 1)
            tail = mix(tail + counts[short].astype(_U) * _U(0xA24BAED4963EE407))
            out_row, out_h = np.concatenate([out_row, short]), np.concatenate([out_h, tail])
    return out_row, out_h


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]
