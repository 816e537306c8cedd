"""Token estimate: about one token for every four characters of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate(text: str) -> int:
    return sum(-(-len(w) // 4) for w in text.split())


def estimate_tokens(text: Column) -> Column:
    """As a native expression, inside code generation."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.ceil(F.char_length(w) / F.lit(4.0)))
