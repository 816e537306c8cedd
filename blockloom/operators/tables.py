"""How table-like a grid of cells is, as a native expression over array<array<string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(row: Column) -> Column:
    return F.filter(F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def _cut(left: Column, right: Column) -> Column:
    """Is a word or bracket cut between the cells?"""
    first = F.element_at(F.split(right, r"(?U)\s+"), 1)
    scrap = first.rlike(r"^\p{Ll}") & (F.char_length(first) <= 3) & (F.size(F.split(right, r"(?U)\s+")) == 1)
    return left.rlike(r"\p{L}$") & (right.rlike(r"^[).,;:]") | scrap)


def table_score(rows: Column) -> Column:
    """Share of rows with the usual number of filled cells, less the share of empty cells and twice that of cut words. Ties: fewer cells."""
    counts = F.transform(rows, lambda r: F.size(_filled(r)))
    filled = F.filter(counts, lambda n: n > 0)
    cells = F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(r))
    times = lambda n: F.size(F.filter(filled, lambda x: x == n))
    usual = F.array_max(F.transform(F.array_distinct(filled), times))
    pairs = F.flatten(F.transform(rows, lambda r: F.arrays_zip(F.slice(_filled(r), 1, F.greatest(F.size(_filled(r)) - 1, F.lit(0))).alias("a"), F.slice(_filled(r), 2, F.greatest(F.size(_filled(r)) - 1, F.lit(0))).alias("b"))))
    n = F.size(pairs)
    cut = F.size(F.filter(pairs, lambda p: _cut(p["a"], p["b"])))
    score = usual / F.size(filled) - (1 - F.aggregate(counts, F.lit(0), lambda a, x: a + x) / cells) - 2 * F.when(n > 0, cut / n).otherwise(0.0)
    return F.when((F.size(filled) == 0) | (cells == 0), F.lit(-1.0)).otherwise(score)
