"""How well blocks and chunks keep their source: relational measures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S
from .paths import heading_paths

WORD = r"([a-zа-яёўқғҳà-ÿ]{3,})"
_WORD = re.compile(WORD)
#: Words from which on a text is long, and buckets of keys that come in several rows.
_LONG, _BUCKETS = 1 << 16, 1 << 20


def long_words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word): lower-case words of three letters or more, in order."""
    return texts.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))).alias("pos", "word"))


def fidelity(source: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(key, words, kept, fidelity): the share of the source's words, as a multiset, that are kept."""
    count = lambda df, name: long_words(df, key).groupBy(key, "word").agg(F.count(F.lit(1)).alias(name))
    both = count(source, "n").join(count(kept, "m"), [key, "word"], "left")
    sums = both.groupBy(key).agg(F.sum("n").alias("words"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("kept"))
    return sums.withColumn("fidelity", F.round(F.col("kept") / F.col("words"), 6))


def order_kept(source: DataFrame, kept: DataFrame, key: str, reach: int = 4) -> DataFrame:
    """(key, pairs, near): adjacent words of the output, and how many of them stand within ``reach`` words in the source."""
    w = Window.partitionBy(key).orderBy("pos")
    src = long_words(source, key)
    ahead = src.select(key, F.col("word").alias("a"), F.array(*[F.lead("word", k).over(w) for k in range(1, reach + 1)]).alias("next"))
    near = ahead.select(key, "a", F.explode("next").alias("b")).filter("b is not null").distinct()
    out = long_words(kept, key).select(key, F.col("word").alias("a"), F.lead("word").over(w).alias("b")).filter("b is not null")
    hit = out.join(near.withColumn("hit", F.lit(1)), [key, "a", "b"], "left")
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.coalesce("hit", F.lit(0))).alias("near"))


def _near(source: pa.StringScalar, kept: pa.StringScalar, reach: int) -> tuple[int, int]:
    """Words of the output, and how many of its pairs stand near in the source; long texts by sorted numbers, which take less room than sets."""
    number: dict[str, int] = {}
    words, out = ([number.setdefault(m[0], len(number)) for m in _WORD.finditer(t.as_py())] for t in (source, kept))
    if max(len(words), len(out)) <= _LONG:
        pairs = list(zip(out, out[1:], strict=False))
        asked = set(pairs)
        met = set().union(*(asked.intersection(zip(words, words[k:], strict=False)) for k in range(1, reach + 1)))
        return len(out), sum(map(met.__contains__, pairs))
    size = len(out)
    words, out = np.array(words, "int64"), np.array(out, "int64")
    pairs = out[:-1] * len(number) + out[1:]
    hit = np.zeros(len(pairs), bool)
    for k in range(1, min(reach, len(words) - 1) + 1):
        there = words[:-k] * len(number) + words[k:]
        there.sort()
        hit |= there[np.searchsorted(there[:-1], pairs)] == pairs
    return size, int(hit.sum())


def order_in_rows(rows: DataFrame, key: str, source: str, kept: str, reach: int = 4) -> DataFrame:
    """What ``order_kept`` gives for rows that hold both texts of a document: no text and no word is shuffled.

    Keys that come in several rows go the way of ``order_kept``, together with all keys of their bucket. A null key meets no source.
    """
    rows = rows.select(key, F.col(source).alias("source"), F.col(kept).alias("kept"), F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("_bucket"))
    several = F.broadcast(rows.filter(F.col(key).isNotNull()).groupBy(key, "_bucket").count().filter("count > 1").select("_bucket").distinct())
    again = rows.join(several, "_bucket", "left_semi")
    by_words = order_kept(again.select(key, F.col("source").alias("text")), again.select(key, F.col("kept").alias("text")), key, reach)
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    once = rows.join(several, "_bucket", "left_anti").select(key, lower(F.when(F.col(key).isNotNull(), F.col("source"))).alias("source"), lower("kept").alias("kept"))
    schema = StructType([once.schema[key], *StructType.fromDDL("words long, near long")])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_near(s, k, reach) for s, k in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in found], pa.int64()) for i in range(2))], names=schema.names)

    sums = once.mapInArrow(counts, schema).groupBy(key).agg((F.sum("words") - 1).alias("pairs"), F.sum("near").alias("near"))
    return sums.filter("pairs > 0").unionByName(by_words)


def normal(text: Column) -> Column:
    """Lower case, one apostrophe dropped, no punctuation, single spaces: what titles are compared by."""
    t = F.regexp_replace(F.lower(text), "['‘’`´′＇ʻʼʹ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))


def heading_scores(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, recall, precision) of headings; a title matches if either is the other's beginning of six characters or more."""
    g = gold.select("document_id", normal(F.col("text")).alias("g"), F.coalesce("optional", F.lit(False)).alias("optional")).distinct()
    h = blocks.filter(F.col("type") == S.HEADING).select("document_id", "pos", normal(F.col("text")).alias("h"))
    same = F.startswith("h", F.substring("g", 1, 120)) | (F.startswith("g", F.substring("h", 1, 120)) & (F.char_length("h") >= 6))
    met = g.join(h, "document_id").filter(same)
    found = g.join(met.select("document_id", "g").distinct().withColumn("hit", F.lit(1)), ["document_id", "g"], "left").filter("not optional").groupBy("document_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    right = h.join(met.select("document_id", "pos").distinct().withColumn("hit", F.lit(1)), ["document_id", "pos"], "left").groupBy("document_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("precision"))
    return found.join(right, "document_id", "full")


def table_scores(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, tables, found): gold tables (page, page_end, cols) covered by a table of their pages and columns."""
    t = blocks.filter(F.col("type") == S.TABLE).select("document_id", F.col("page").alias("p"), F.coalesce("page_end", "page").alias("q"), F.array_max(F.transform("rows", lambda r: F.size(r))).alias("c"))
    g = gold.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "page_end", "cols")))
    hit = g.join(t, "document_id").filter((F.col("p") <= F.col("page_end")) & (F.col("q") >= F.col("page")) & (F.col("c") == F.col("cols"))).select("document_id", "k").distinct().withColumn("hit", F.lit(1))
    return g.join(hit, ["document_id", "k"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("tables"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


def chunk_scores(chunks: DataFrame, small: int = 50) -> DataFrame:
    """Counts of what makes chunks hard to use, and the upper median of their tokens, for each document."""
    upper_median = F.element_at(F.sort_array(F.collect_list("token_count")), F.floor(F.count(F.lit(1)) / 2).cast("int") + 1)
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), flag(F.col("token_count") < small).alias("tiny"), flag(F.rtrim("text").endswith(":")).alias("open"), flag(F.col("language") == "unknown").alias("unknown"),
        flag(F.size("heading_path") == 0).alias("no_path"), F.sum("token_count").alias("tokens"), upper_median.alias("median_tokens"),
    )


def artifacts(blocks: DataFrame) -> DataFrame:
    """(document_id, punctuation, cut): blocks of marks only, and paragraphs that stop inside a sentence the next goes on with."""
    w = Window.partitionBy("document_id").orderBy("pos")
    marks = ~F.col("text").rlike(r"[\p{L}\p{N}]")
    cut = (F.col("type") == S.PARAGRAPH) & F.col("text").rlike(r"[\p{L},-]$") & (F.lead("type").over(w) == S.PARAGRAPH) & F.lead("text").over(w).rlike(r"^\p{Ll}")
    flagged = blocks.select("document_id", marks.alias("m"), F.coalesce(cut, F.lit(False)).alias("c"))
    return flagged.groupBy("document_id").agg(F.sum(F.col("m").cast("int")).alias("punctuation"), F.sum(F.col("c").cast("int")).alias("cut"))


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, measure, old, new) where two reports differ."""
    names = [c for c in old.columns if c != key]
    long_ = lambda df, name: df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("measure", name))
    both = long_(old, "old").join(long_(new, "new"), [key, "measure"], "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


# ---- paths against gold headings -----------------------------------------------------------------

_POSITIONS = "document_id string, pos int, level int, text string"


def gold_positions(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, pos, level, text) of gold headings (pos, level, text) at the blocks that say them: each the first match behind the one before.

    A heading that no later block says is left out. The order of both decides, so a document is one group.
    """
    g = gold.select("document_id", F.struct("pos", "level", "text", normal(F.col("text")).alias("key")).alias("g")).groupBy("document_id").agg(F.sort_array(F.collect_list("g")).alias("gold"))
    arrow = to_arrow_schema(StructType.fromDDL(_POSITIONS))
    b = blocks.select("document_id", F.struct("pos", normal(F.col("text")).alias("key")).alias("b")).groupBy("document_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc in batch.to_pylist():
                at = 0
                for h in doc["gold"]:
                    same = lambda k, h=h: bool(k) and (k.startswith(h["key"][:120]) or (len(k) >= 6 and h["key"].startswith(k[:120])))
                    hit = next((i for i in range(at, len(doc["blocks"])) if same(doc["blocks"][i]["key"])), None)
                    if hit is not None:
                        out.append({"document_id": doc["document_id"], "pos": doc["blocks"][hit]["pos"], "level": h["level"], "text": h["text"]})
                        at = hit + 1
            yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return g.join(b, "document_id").select("document_id", "gold", "blocks").mapInArrow(rows, _POSITIONS)


def chunk_starts(blocks: DataFrame, chunks: DataFrame, opening: int = 60) -> DataFrame:
    """(document_id, chunk_index, pos): the first block whose opening words a chunk begins with; of several, the nearest behind the chunk before.

    Openings are joined by equality, so only blocks that begin alike are compared.
    """
    open_ = lambda c: F.substring(normal(c), 1, opening)
    b = blocks.filter("trim(text) <> ''").select("document_id", "pos", F.col("type").alias("_type"), open_(F.split("text", "\n")[0]).alias("key")).filter("key <> ''")
    lines = chunks.select("document_id", "chunk_index", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("key", open_(F.col("line"))).filter("key <> ''")
    hits = lines.join(b, ["document_id", "key"]).groupBy("document_id", "chunk_index").agg(F.min(F.struct("n", "pos")).alias("first"), F.sort_array(F.collect_set(F.struct("n", "pos"))).alias("all"))
    before = F.lag("first.pos").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    hits = hits.withColumn("_behind", F.coalesce(before, F.lit(-1)))
    near = F.filter("all", lambda x: (x["n"] == F.col("first.n")) & (x["pos"] >= F.col("_behind")))
    return hits.select("document_id", "chunk_index", F.coalesce(F.try_element_at(near, F.lit(1))["pos"], F.col("first.pos")).alias("pos"))


def path_accuracy(gold: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, chunks, right, accuracy): chunks whose heading path is the gold path where they begin."""
    stops = gold_positions(gold, blocks).select("document_id", "pos", F.lit(0).alias("_kind"), "level", "text", F.lit(None).cast("int").alias("chunk_index"))
    starts = chunk_starts(blocks, chunks).select("document_id", "pos", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), "chunk_index")
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "_kind"))
    track = stops.unionByName(starts).withColumn("pos", order)
    known = heading_paths(track).filter("_kind = 1").select("document_id", "chunk_index", F.transform("path", lambda x: normal(x)).alias("want"))
    said = chunks.select("document_id", "chunk_index", F.transform("heading_path", lambda x: normal(x)).alias("got"))
    both = known.join(said, ["document_id", "chunk_index"])
    return both.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum((F.col("want") == F.col("got")).cast("int")).alias("right")).withColumn("accuracy", F.col("right") / F.col("chunks"))


def source_text(lines: DataFrame) -> DataFrame:
    """(document_id, page, text): the lines of a page in reading order, as the reader found them."""
    said = lines.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("original", "text").alias("t")))).alias("l"))
    return said.select("document_id", "page", F.array_join("l.t", "\n").alias("text"))


def draft_gold(blocks: DataFrame) -> DataFrame:
    """(document_id, json): the headings found, in the form of gold files, to be corrected by hand."""
    heads = blocks.filter(F.col("type") == S.HEADING).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "level"))).alias("h"))
    return heads.select("document_id", F.to_json(F.struct(F.transform("h", lambda x: F.struct(x["text"].alias("text"), x["level"].alias("level"), F.lit(False).alias("optional"))).alias("headings"))).alias("json"))


def report(source: DataFrame, blocks: DataFrame, chunks: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """One row a document with every measure; ``source``: document_id, text; ``gold``: document_id, pos, level, text, optional."""
    kept = blocks.filter("text <> ''").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("b")).select("document_id", F.array_join("b.text", "\n").alias("text"))
    out = fidelity(source, kept, "document_id").select("document_id", "fidelity")
    order = order_kept(source, kept, "document_id").select("document_id", (F.col("near") / F.col("pairs")).alias("order"))
    parts = [order, chunk_scores(chunks), artifacts(blocks)]
    if gold is not None:
        parts += [heading_scores(gold, blocks), path_accuracy(gold, blocks, chunks).select("document_id", F.col("accuracy").alias("path_accuracy"))]
    for p in parts:
        out = out.join(p, "document_id", "full")
    return out
