"""Repeated byte strings removed by blockwise suffix sorting with a difference cover.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or earlier in the same text) goes.

1. Each LENGTH-byte window belongs to its smallest GRAM-byte hash, its anchor; equal windows have equal anchors at the same
   place. So suffixes fall into buckets by anchor, and a bucket with one member holds no repeat. A text of n
   bytes has about n / 35 anchors, each with the run of window starts that belong to it (its segment).
2. In a bucket, equal segments (128 bits of two independent hashes) are one variant, of which the earliest stays: first within
   each SPAN of text, before anything is shuffled, then over all. So an anchor that every document has costs one record a
   span and not one a document.
3. The variants of buckets with several of them come back with their bytes, and one bucket at a time has its suffixes sorted,
   in blocks of bounded size: by their first bytes, and where those tie, by ranks of the suffixes at positions of a
   difference cover, which are computed once for the block. Neighbours in that order that agree in LENGTH bytes are repeats.
4. A bucket larger than a block is dealt by the hash of whole windows into smaller buckets, which are sorted in the same way;
   where one task couldn't hold it, before the shuffle. This changes where windows are sorted, not what is found.

Rows: a null text is empty; empty and short texts keep all bytes; a long text is read in overlapping pieces. Rows that repeat
a doc_id stand in the order of their texts; equal rows of one id count as repeats after the first. A null doc_id comes before
all others. Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._runtime import Scratch, lean

_U = np.uint64
LENGTH = 100
GRAM = 32
#: A perfect difference set: every difference modulo 31 is one of two members of COVER.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes of segments that are sorted together.
BLOCK = 1 << 19
#: Variants of a bucket that one task sorts (some 140 bytes each); the windows of larger ones are dealt to several.
HOT = 20_000
#: Bytes of anchors or segments of one group, read by one task, and of records looked at at a time.
GROUP_BYTES, AT_ONCE = 4 << 20, 4 << 20
#: Bytes of text in which equal segments are made one before the shuffle.
SPAN = 8 << 20
#: Bytes of a text that are read at a time.
PIECE = 1 << 19

_ANCHOR = np.dtype([("a", "<i8"), ("s", "<i8"), ("d", "<i8"), ("o", "<u4"), ("l", "<u2"), ("r", "<u2")])
_RANGE = np.dtype([("d", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
_in_cover = np.isin(np.arange(PERIOD), COVER)
_DELTA = np.array([[next(d for d in range(PERIOD) if _in_cover[(i + d) % PERIOD] and _in_cover[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)])


def _prefix(data: np.ndarray, values: np.ndarray = _text._BYTE) -> np.ndarray:
    p = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * _text._power("up", len(data)), dtype=_U, out=p[1:])
    return p


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, segment hash, anchor, first and last window start of its segment), places within ``data``."""
    n, w = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 6
    p = _prefix(data)
    down = _text._power("down", n + 1)
    h = _text.mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
    bits = _U(max(22, n.bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=_U)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    owner = (key & ((_U(1) << bits) - _U(1))).astype(np.int64)
    valid = np.ones(n + 1, bool)
    edges = np.zeros(n + 2, np.int64)
    np.add.at(edges, np.maximum(offs[1:] - (length - 1), offs[:-1]), 1)
    np.add.at(edges, offs[1:], -1)
    valid = np.cumsum(edges)[: len(owner)] == 0
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    head = np.ones(len(at), bool)
    head[1:] = (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[head]
    last = at[np.append(np.flatnonzero(head)[1:], len(at)) - 1]
    o = owner[first]
    end = last + length
    p = _prefix(data, _text._OTHER)  # not the hash that anchors are chosen by
    s = _text.mix((p[end] - p[first]) * down[first] + _text.mix(((end - first).astype(_U) << _U(32)) + (o - first).astype(_U)))
    return np.searchsorted(offs, first, "right") - 1, h[o].view(np.int64), s.view(np.int64), o, first, last


def _words_at(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes from each place, as numbers in the order of the bytes."""
    return np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))[at + 8 * k].copy().view(">u8").ravel().astype(_U)


def _refine(rank: np.ndarray, text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Ranks by one more word, for those that still tie."""
    size = np.bincount(rank)
    tied = np.flatnonzero(size[rank] > 1)
    if not len(tied):
        return rank
    r, x = rank[tied], _words_at(text, at[tied], k)
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    head = np.ones(len(r), bool)
    head[1:] = r[1:] != r[:-1]
    # a dense rank before refinement leaves gaps for its members below
    step = np.cumsum(new) - 1
    inside = step - np.maximum.accumulate(np.where(head, step, 0))
    base = np.cumsum(size) - size
    out = base[rank]
    out[tied[order]] = base[r] + inside
    _, out = np.unique(out, return_inverse=True)
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the suffixes at ``starts`` by bucket, then by their first ``length`` bytes at least; text is padded by 2 x length."""
    # Ranks of the cover samples, once for the block.
    n = len(text) - length - 16
    samples = np.flatnonzero(_in_cover[np.arange(n) % PERIOD])
    rank_at = np.zeros(n, np.int64)
    rank = np.zeros(len(samples), np.int64)
    for k in range(-(-length // 8)):
        rank = _refine(rank, text, samples, k)
    rank_at[samples] = rank
    # The suffixes by their first bytes, one bucket beside the other.
    _, mine = np.unique(bucket, return_inverse=True)
    for k in range(-(-PERIOD // 8)):
        mine = _refine(mine, text, starts, k)
    order = np.argsort(mine, kind="stable")
    group = mine[order]
    residue = starts % PERIOD
    # Long ties: two suffixes meet the cover at the same distance.
    own = rank_at[starts + _DELTA[residue, residue]]
    order = order[np.lexsort((own[order], group))]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    res = residue[order]
    mixed = np.add.reduceat(np.r_[False, (res[1:] != res[:-1])] & np.r_[False, group[1:] == group[:-1]], head) if len(order) else head
    ends = np.append(head[1:], len(order))

    def compare(i: int, j: int) -> int:
        d = _DELTA[residue[i], residue[j]]
        a, b = rank_at[starts[i] + d], rank_at[starts[j] + d]
        return int(a > b) - int(a < b)

    for g in np.flatnonzero(mixed > 0):
        order[head[g] : ends[g]] = sorted(order[head[g] : ends[g]].tolist(), key=functools.cmp_to_key(compare))
    return order


def equal_classes(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each in that order): equal strings of ``length`` bytes in one bucket have one class."""
    order = suffix_order(text, starts, bucket, length)
    at, b = starts[order], bucket[order]
    same = b[1:] == b[:-1]
    for k in range(length // 8):
        x = _words_at(text, at, k)
        same &= x[1:] == x[:-1]
    if length % 8:
        x = _words_at(text, at + length - 8, 0)
        same &= x[1:] == x[:-1]
    return order, np.cumsum(np.r_[True, ~same]) - 1 if len(order) else order


def _earliest(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in the order of anchor, segment and place, and which of them are the first of their variant."""
    rec = rec[np.lexsort((rec["o"], rec["d"], rec["s"], rec["a"]))]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["a"][1:] != rec["a"][:-1]) | (rec["s"][1:] != rec["s"][:-1])
    return rec, new


def _covered(rec: np.ndarray, length: int) -> np.ndarray:
    """Ranges of the windows of records, one for segments that touch."""
    lo = rec["o"].astype(np.int64) - rec["l"]
    hi = rec["o"].astype(np.int64) - rec["r"] + length
    order = np.lexsort((lo, rec["d"]))
    d, lo, hi = rec["d"][order], lo[order], hi[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (lo[1:] > hi[:-1])][: len(d)])
    out = np.zeros(len(head), _RANGE)
    out["d"], out["lo"] = d[head], lo[head]
    out["hi"] = np.maximum.reduceat(hi, head) if len(head) else hi
    return out


def _dealt(p: np.ndarray, records: np.ndarray, ranges: np.ndarray, groups: int) -> pa.RecordBatch:
    """One row for each group that gets records, and one for the ranges."""
    order = np.argsort(p, kind="stable")
    p, records = p[order], records[order]
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
    ends = np.append(cut[1:], len(p))[: len(cut)]
    home = [int(ranges["d"][0]) % groups] if len(ranges) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([*p[cut].tolist(), *home], pa.int32()), pa.array([*(records[i:j].tobytes() for i, j in zip(cut, ends, strict=True)), *(None for _ in home)], pa.binary()), pa.array([*(None for _ in cut), *(ranges.tobytes() for _ in home)], pa.binary())],
        names=["p", "records", "ranges"],
    )


def _ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    return pa.table({"doc": pa.array(doc, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _blobs(column: pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    """What the values hold, without copies."""
    return [np.frombuffer(x.as_buffer(), kind) for c in column.chunks for x in c if x.is_valid]


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, lo, hi): byte ranges that are covered by repeats, of ``docs`` (doc long, text) with one row for each doc."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, -(-size // GROUP_BYTES))  # about a byte of anchors for each byte of text
    deal = lambda key, n: ((_text.mix(key.view(_U)) >> _U(32)) * _U(n)) >> _U(32)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0

        def out() -> pa.RecordBatch:
            rec, new = _earliest(np.concatenate(held))
            return _dealt(deal(rec["a"][new], groups), rec[new], _covered(rec[~new], length), groups)

        for b in batches:
            ids = b.column("doc").to_numpy()
            for lo, data, offs, at in _text.pieces(b.column("text"), length - 1, PIECE):
                row, a, s, o, first, last = anchors(data, offs, length, gram)
                rec = np.zeros(len(row), _ANCHOR)
                rec["a"], rec["s"], rec["d"], rec["o"], rec["l"], rec["r"] = a, s, ids[lo + row], at + o - offs[row], o - first, o - last
                held.append(rec)
                held_bytes += len(data)
                if held_bytes >= SPAN:
                    yield out()
                    held, held_bytes = [], 0
                    lean()
        if held:
            yield out()
            held.clear()
            lean()

    def buckets(table: pa.Table) -> pa.Table:
        blobs, outs = _blobs(table.column("records"), _ANCHOR), []
        for r in _blobs(table.column("ranges"), _RANGE):
            none = pa.nulls(len(r), pa.int64())
            outs.append(pa.table({"doc": r["d"], "lo": r["lo"], "hi": r["hi"], "anchor": none, "off": np.zeros(len(r), np.int32), "hot": np.zeros(len(r), bool)}))
        times = max(1, -(-sum(x.nbytes for x in blobs) // AT_ONCE))
        for k in range(times):  # buckets by a part of their anchors at a time
            of = (x[_text.mix(x["a"].view(_U)) % _U(times) == _U(k)] for x in blobs)
            rec, new_s = _earliest(np.concatenate(list(of)) if blobs else np.zeros(0, _ANCHOR))
            if not len(rec):
                continue
            which = np.cumsum(np.r_[True, rec["a"][1:] != rec["a"][:-1]]) - 1
            several = np.bincount(which, new_s)[which]
            gone, ask = ~new_s, new_s & (several > 1)
            ranges, r = _covered(rec[gone], length), rec[ask]
            lo = r["o"].astype(np.int64) - r["l"]
            outs.append(pa.table({
                "doc": np.r_[ranges["d"], r["d"]], "lo": np.r_[ranges["lo"], lo], "hi": np.r_[ranges["hi"], r["o"].astype(np.int64) - r["r"] + length],
                "anchor": pa.array(np.r_[np.zeros(len(ranges), np.int64), r["a"]], mask=np.arange(len(ranges) + len(r)) < len(ranges)),
                "off": np.r_[np.zeros(len(ranges), np.int32), r["l"].astype(np.int32)], "hot": np.r_[np.zeros(len(ranges), bool), several[ask] > hot],
            }))
            del rec, new_s, which, several
        lean()
        empty = pa.table({"doc": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64()), "anchor": pa.array([], pa.int64()), "off": pa.array([], pa.int32()), "hot": pa.array([], pa.bool_())})
        return pa.concat_tables([empty, *outs])

    schema = "doc long, lo long, hi long, anchor long, off int, hot boolean"
    found = scratch.keep(docs.mapInArrow(find, "p int, records binary, ranges binary").groupBy("p").applyInArrow(buckets, schema))
    asked = found.filter("anchor is not null")
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "anchor", "off", "hot")).alias("asked"))
    n_asked = asked.agg(F.sum((F.col("hi") - F.col("lo")) * F.when(F.col("hot"), 27).otherwise(1))).first()[0] or 0
    parts = max(least, -(-n_asked // (GROUP_BYTES // 2)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments with their bytes; of buckets that are dealt, each window by itself, named by its hash."""
        names = ["p", "bucket", "doc", "lo", "off", "bytes"]
        for b in batches:
            ids = b.column("doc").to_numpy()
            asks = b.column("asked")
            of = np.repeat(np.arange(b.num_rows), np.diff(asks.offsets.to_numpy()))
            flat = asks.flatten()
            field = lambda k, f=flat: f.field(k).to_numpy(zero_copy_only=False)
            lo, hi, anchor, off, is_hot = field("lo"), field("hi"), field("anchor"), field("off"), field("hot")
            for first, end, data, offs in _text.slices(b.column("text")):
                mine = (of >= first) & (of < end)
                base = offs[np.where(mine, of - first, 0)]
                view = memoryview(data)
                for some in _runs(np.flatnonzero(mine & ~is_hot), hi - lo):
                    yield pa.RecordBatch.from_arrays([pa.array(deal(anchor[some], parts).astype(np.int32)), pa.array(anchor[some]), pa.array(ids[of[some]]), pa.array(lo[some]), pa.array(off[some].astype(np.int32)), pa.array([bytes(view[base[i] + lo[i] : base[i] + hi[i]]) for i in some], pa.binary())], names=names)
                for some in _runs(np.flatnonzero(mine & is_hot), (hi - lo) * length):
                    text, starts, which = _windows([data[base[i] + lo[i] : base[i] + hi[i]] for i in some], length)
                    key = _window_hashes(text, starts, anchor[some][which], length)
                    place = lo[some][which] + starts - np.r_[0, np.cumsum((hi - lo)[some])[:-1]][which]
                    doc = ids[of[some]][which]
                    blob = text.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(deal(key, parts).astype(np.int32)), pa.array(key), pa.array(doc), pa.array(place), pa.array(np.zeros(len(key), np.int32)), pa.array([blob[i : i + length] for i in starts], pa.binary())], names=names)

    pieces = docs.join(wanted, "doc").mapInArrow(cut, "p int, bucket long, doc long, lo long, off int, bytes binary")

    def sort_buckets(table: pa.Table) -> pa.Table:
        outs = []
        order = np.lexsort((table.column("lo").to_numpy(), table.column("doc").to_numpy(), table.column("bucket").to_numpy()))
        bucket, doc, lo, off = (table.column(c).to_numpy()[order] for c in ("bucket", "doc", "lo", "off"))
        raw = table.column("bytes").combine_chunks()
        at, body = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1], np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        begin, sizes = at[:-1][order], np.diff(at)[order]
        segs = lambda s: [body[begin[i] : begin[i] + sizes[i]] for i in s]
        new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        ends = np.append(new[1:], len(bucket))[: len(new)]
        weight = np.add.reduceat(sizes, new) if len(new) else new
        i = 0
        while i < len(new):
            j, total = i, 0
            while j < len(new) and (j == i or total + weight[j] <= BLOCK):
                total += int(weight[j])
                j += 1
            s = np.arange(new[i], ends[j - 1])
            if total <= BLOCK:
                outs.append(_block(bucket[s], doc[s], lo[s], off[s], segs(s), sizes[s], length))
            else:
                outs.append(_large(doc[s], lo[s], segs(s), sizes[s], length))
            i = j
        lean()
        return pa.concat_tables([_ranges(*[np.zeros(0, np.int64)] * 3), *outs])

    ranges = scratch.keep(pieces.groupBy("p").applyInArrow(sort_buckets, "doc long, lo long, hi long"))
    return found.filter("anchor is null").select("doc", "lo", "hi").unionByName(ranges)


def _runs(which: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """``which`` in runs of about AT_ONCE bytes."""
    part = np.cumsum(weight[which]) // AT_ONCE
    for s in np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]):
        yield which[s : np.searchsorted(part, part[s], "right")]


def _windows(segs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments in a row, start of each window, segment of each window)."""
    sizes = np.array([len(x) for x in segs])
    count = sizes - length + 1
    which = np.repeat(np.arange(len(segs)), count)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(sizes) - sizes)[which]
    return np.concatenate(segs), starts, which


def _window_hashes(text: np.ndarray, starts: np.ndarray, salt: np.ndarray, length: int) -> np.ndarray:
    p = _prefix(text)
    h = (p[starts + length] - p[starts]) * _text._power("down", len(text) + 1)[starts]
    return _text.mix(h + _text.mix(salt.view(_U))).view(np.int64)


def _large(doc: np.ndarray, lo: np.ndarray, segs: list[np.ndarray], sizes: np.ndarray, length: int) -> pa.Table:
    """Repeats of one bucket of more than a block: its windows dealt by hash, those of a hash sorted as a bucket of their own."""
    key, place, of, part = [], [], [], max(1, BLOCK // max(1, int(sizes.max())))
    for s in range(0, len(segs), part):
        text, starts, which = _windows(segs[s : s + part], length)
        key.append(_window_hashes(text, starts, np.zeros(len(starts), np.int64), length))
        of.append((which + s).astype(np.int32))
        place.append((starts - (np.cumsum(sizes[s : s + part]) - sizes[s : s + part])[which]).astype(np.int32))
    key, place, of = np.concatenate(key), np.concatenate(place), np.concatenate(of)
    order = np.argsort(key, kind="stable")  # by doc and place within a hash
    key = key[order]
    same = key[1:] == key[:-1]
    order, key = order[np.r_[False, same] | np.r_[same, False]], key[np.r_[False, same] | np.r_[same, False]]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    ends, outs, i = np.append(new[1:], len(key))[: len(new)], [], 0
    while i < len(new):
        j = max(i + 1, int(np.searchsorted(ends, new[i] + BLOCK // length, "right")))
        s = order[new[i] : ends[j - 1]]
        for t in range(0, len(s), 8 * BLOCK // length) if j == i + 1 else (0,):  # equal windows without end: each part after the first one's first
            u = s if j > i + 1 else s[t : t + 8 * BLOCK // length] if not t else np.r_[s[:1], s[t : t + 8 * BLOCK // length]]
            k = np.repeat(key[new[i]], len(u)) if j == i + 1 else key[new[i] : ends[j - 1]]
            outs.append(_block(k, doc[of[u]], lo[of[u]] + place[u], np.zeros(len(u), np.int64), [segs[of[x]][place[x] : place[x] + length] for x in u], np.full(len(u), length), length))
        i = j
    return pa.concat_tables(outs) if outs else _ranges(*[np.zeros(0, np.int64)] * 3)


def _block(bucket: np.ndarray, doc: np.ndarray, lo: np.ndarray, off: np.ndarray, segs: list[np.ndarray], sizes: np.ndarray, length: int) -> pa.Table:
    """Repeats among the segments of whole buckets, which stand in the order of doc and place."""
    # Anchors are aligned to the cover's period, so that suffixes of equal place meet the same samples.
    place, at = np.zeros(len(segs), np.int64), 0
    for i, n in enumerate(sizes):
        place[i] = at + (-(at + int(off[i]))) % PERIOD
        at = int(place[i]) + int(n)
    text = np.zeros(at + 2 * length + 64, np.uint8)
    for i, s in enumerate(segs):
        text[place[i] : place[i] + sizes[i]] = s
    count = sizes - length + 1
    which = np.repeat(np.arange(len(segs)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, cls = equal_classes(text, place[which] + start, bucket[which], length)
    earliest = np.full(int(cls[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, cls, order)  # windows are numbered by doc and place
    mark = np.zeros(len(which), bool)
    mark[order] = order != earliest[cls]
    m = np.flatnonzero(mark)
    head = np.r_[True, (m[1:] != m[:-1] + 1) | (which[m[1:]] != which[m[:-1]])][: len(m)]
    s = np.flatnonzero(head)
    e = np.append(s[1:], len(m))[: len(s)] - 1
    w = which[m[s]]
    return _ranges(doc[w], lo[w] + start[m[s]], lo[w] + start[m[e]] + length)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with _doc: unique, in the order of doc_id and then of the text. Equal rows are told apart once, in a table."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("least")).first()
    if (ids["most"] or 0) <= 1 and not ids["nulls"]:
        return docs.withColumn("_doc", F.col("doc_id").cast("long"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")))) - 1
    return scratch.keep(docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((ids["least"] or 0) - 1)) * ids["most"] + at))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """``docs`` with _kept (the remaining bytes; as_text: the text of those that still make characters), _n_bytes, _n_removed and _n_spans."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("_doc", "_ranges", "_kept", "_n_bytes", "_n_removed", "_n_spans")  # columns of these names are replaced
    keyed = _keyed(docs, scratch)
    ranges = repeated_ranges(keyed.select(F.col("_doc").alias("doc"), "text"), scratch, length, gram, hot)
    ranges = ranges.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges = b.column("text"), b.column("_ranges")
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            flat = ranges.flatten()
            lo_all, hi_all = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            sizes = pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
            at = 0
            for t, m in zip(texts, sizes, strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                lo, hi = lo_all[at : at + m], hi_all[at : at + m]
                at += m
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order]) if m else hi
                head = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]][:m])
                s, e = lo[head], hi[np.append(head[1:], m)[: len(head)] - 1]
                n_bytes.append(len(raw))
                n_removed.append(int((e - s).sum()))
                n_spans.append(len(s))
                kept.append(b"".join(raw[i:j] for i, j in zip(np.r_[0, e], np.r_[s, len(raw)], strict=True)) if m else raw)
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c not in ("_ranges", "_doc")]
            names = [c for c in b.schema.names if c not in ("_ranges", "_doc")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())], names=[*names, "_kept", "_n_bytes", "_n_removed", "_n_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", _kept {'string' if as_text else 'binary'}, _n_bytes long, _n_removed long, _n_spans long"
    return keyed.join(ranges, "_doc", "left").select(*docs.columns, "_doc", "_ranges").mapInArrow(apply, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
