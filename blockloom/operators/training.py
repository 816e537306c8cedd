"""Tables that the text functions learn from: an n-gram model of languages and a lexicon of stems."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Language, Lexicon

ORDERS, GRAMS, ADD = (1, 2, 3, 4), 30_000, 0.5


def words(texts: DataFrame, label: str) -> DataFrame:
    """(label, word): lower-case words with one kind of apostrophe."""
    t = F.regexp_replace(F.lower("text"), "[‘’`´′＇ʻʼʹ]", "'")
    return texts.select(F.col(label), F.explode(F.regexp_extract_all(t, F.lit(r"(\p{L}+(?:'\p{L}+)*'?)"), F.lit(1))).alias("word"))


def ngrams(rows: DataFrame, label: str, *more: str) -> DataFrame:
    """(label, n, gram, more): characters of words with a space on each side; a lone space is no gram."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    one = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.char_length(padded)), lambda i: i + n - 1 <= F.char_length(padded)), lambda i: F.struct(F.lit(n).alias("n"), F.substring(padded, i, n).alias("gram")))
    grams = F.filter(F.concat(*map(one, ORDERS)), lambda g: g["gram"] != " ")
    return rows.select(label, *more, F.explode(grams).alias("g")).select(label, "g.n", "g.gram", *more)


def counts(texts: DataFrame, label: str) -> DataFrame:
    """(label, n, gram, count). A word is cut once, however often it occurs: its count goes to each of its grams."""
    often = words(texts, label).groupBy(label, "word").agg(F.count(F.lit(1)).alias("_times"))
    return ngrams(often, label, "_times").groupBy(label, "n", "gram").agg(F.sum("_times").alias("count"))


def top_grams(counted: DataFrame, most: int = GRAMS) -> DataFrame:
    """(n, gram, total): the most frequent over all labels; ties by gram."""
    return counted.groupBy("n", "gram").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "n", "gram").limit(most)


def model(texts: DataFrame, label: str, most: int = GRAMS) -> tuple[DataFrame, DataFrame]:
    """((n, gram, label, lp), (label, n, floor)): smoothed log-probabilities of the kept grams, and that of any other."""
    counted = counts(texts, label)
    kept = top_grams(counted, most)
    size = kept.groupBy("n").agg(F.count(F.lit(1)).alias("kept"))
    mass = counted.groupBy(label, "n").agg(F.sum("count").alias("mass")).join(size, "n")
    below = F.log(F.col("mass") + ADD * (F.col("kept") + 1))
    grid = kept.select("n", "gram").join(mass, "n").join(counted, [label, "n", "gram"], "left")
    table = grid.select("n", "gram", label, (F.log(F.coalesce("count", F.lit(0)) + F.lit(ADD)) - below).alias("lp"))
    return table, mass.select(label, "n", (F.log(F.lit(ADD)) - below).alias("floor"))


def ratio(table: DataFrame, floors: DataFrame, label: str, classes: dict[str, tuple[str, str]], most: int = GRAMS) -> Callable[[str, str], float]:
    """What language.detect takes: the model as a lookup. The table holds ``most`` grams at most, so it fits a driver."""
    lp = {(r["gram"], r[label]): r["lp"] for r in table.limit(most * 8).collect()}
    floor = {(r[label], r["n"]): r["floor"] for r in floors.collect()}

    def score(kind: str, word: str) -> float:
        a, b = classes[kind]
        padded, total = f" {word} ", 0.0
        for n in ORDERS:
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    total += lp.get((g, a), floor.get((a, n), math.log(ADD))) - lp.get((g, b), floor.get((b, n), math.log(ADD)))
        return total

    return score


def held_out(texts: DataFrame, id_col: str, seed: int = 1, parts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(training rows, a tenth kept back) by a seeded hash of the id."""
    part = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(parts))
    return texts.filter(part != 0), texts.filter(part == 0)


def lexicon_table(rows: DataFrame, endings: dict[str, tuple[str, ...]], rounds: dict[str, int], least: int = 4, often: int = 5) -> DataFrame:
    """(lang, stem) of words (lang, word) that occur ``often`` times or more; the longest ending goes first."""
    out = rows.groupBy("lang", "word").count().filter(F.col("count") >= often).withColumn("stem", F.col("word"))
    for lang, ends in endings.items():
        pattern = f"^(.{{{least},}}?)(?:{'|'.join(sorted(ends, key=len, reverse=True))})$"
        for _ in range(rounds.get(lang, 1)):
            out = out.withColumn("stem", F.when(F.col("lang") == lang, F.regexp_replace("stem", pattern, "$1")).otherwise(F.col("stem")))
    return out.select("lang", "stem").distinct()


def load_lexicon(table: DataFrame, endings: dict[str, tuple[str, ...]], rounds: dict[str, int], least: int = 4, most: int = 2_000_000) -> Lexicon:
    """The lexicon as an object for the kernels; ``most`` bounds what a driver takes."""
    stems: dict[str, set[str]] = {"uz": set(), "ru": set()}
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} stems is looked up by a join, not by the kernels")
    for r in rows:
        stems.setdefault(r["lang"], set()).add(r["stem"])
    made = lambda k: Language(frozenset(stems[k]), endings.get(k, ()), rounds.get(k, 1))
    return Lexicon(made("uz"), made("ru"), least)


def most_frequent(counted: DataFrame, label: str, k: int) -> DataFrame:
    """(label, n, gram, count, rank): the k most frequent of each label and order; ties by gram."""
    w = Window.partitionBy(label, "n").orderBy(F.desc("count"), "gram")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def conllu_sentences(lines: DataFrame) -> DataFrame:
    """(text) of the comment lines of CoNLL-U files that hold a sentence; ``lines`` as spark.read.text gives them."""
    return lines.filter(F.col("value").startswith("# text = ")).select(F.expr("substring(value, 10)").alias("text"))


def book_lines(books: DataFrame, most: int = 4_000_000, least: int = 40) -> DataFrame:
    """(text): lines of ``least`` characters or more of books (book, text), book by book until ``most`` characters are reached."""
    lines = books.select("book", F.posexplode(F.split("text", "\n")).alias("n", "text")).filter(F.char_length(F.trim("text")) >= least).withColumn("n_chars", F.char_length("text").cast("long"))
    sizes = lines.groupBy("book").agg(F.sum("n_chars").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("book").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n_chars").over(Window.partitionBy("book").orderBy("n"))
    full = lines.join(sizes.select("book", before.alias("before")).filter(F.col("before") < most), "book")
    return full.withColumn("upto", F.col("before") + within).filter(F.col("upto") <= most).select("text")


def held_out_accuracy(table: DataFrame, floors: DataFrame, held: DataFrame, label: str, sizes: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """(words, texts, accuracy): how often the first words of held-out texts (label, text), and whole texts (0), have the model's best score for their own label.

    The model is joined to the n-grams of the words; what it doesn't hold scores the floor of its order.
    """
    rows = held.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.col(label).alias("_own"), "text")
    t = F.regexp_replace(F.lower("text"), "[‘’`´′＇ʻʼʹ]", "'")
    said = rows.select("_id", "_own", F.posexplode(F.regexp_extract_all(t, F.lit(r"(\p{L}+(?:'\p{L}+)*'?)"), F.lit(1))).alias("_at", "word"))
    said = said.withColumn("words", F.explode(F.array(*[F.when(F.col("_at") < k, F.lit(k)) if k else F.lit(0) for k in (*sizes, 0)]))).filter("words is not null")
    grams = ngrams(said.withColumnRenamed("_own", "own"), "own", "_id", "words").groupBy("_id", "own", "words", "n", "gram").count()
    scored = grams.join(floors.select(label, "n", "floor"), "n").join(table.select("n", "gram", label, "lp"), ["n", "gram", label], "left")
    totals = scored.groupBy("_id", "own", "words", label).agg(F.sum(F.col("count") * F.coalesce("lp", "floor")).alias("score"))
    best = totals.groupBy("_id", "own", "words").agg(F.max_by(label, F.struct("score", label)).alias("best"))
    return best.groupBy("words").agg(F.count(F.lit(1)).alias("texts"), F.avg((F.col("best") == F.col("own")).cast("double")).alias("accuracy"))
