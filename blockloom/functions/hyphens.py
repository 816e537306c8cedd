"""Words broken at a hyphen: joined, unless the hyphen is the word's own."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import EMPTY, Lexicon

# First parts, last parts and pairs that keep their hyphen, endings after "по-", conjunctions.
_FIRST = frozenset("кое кто что как где куда когда какой чей северо юго восточно западно вице штаб унтер обер лейб".split())
_LAST = frozenset("то либо нибудь таки".split())
_PAIRS = frozenset({("из", "за"), ("из", "под"), ("из", "подо"), ("во", "первых"), ("во", "вторых"), ("в", "третьих"), ("в", "четвёртых"), ("в", "четвертых")})
_AFTER_PO = ("ски", "ому", "ему")
_CONJUNCTIONS = frozenset("va yoki hamda yohud ва ёки ҳамда ёхуд и или либо да".split())
_LETTERS = r"(?:[^\W\d_]|[ʻʼ])"
_OPENING = re.compile(f"{_LETTERS}*")
_CLOSING = re.compile(f"{_LETTERS}*$")
_JAVA_LETTER = r"[\p{L}\p{Nl}\p{No}]"  # what Python's [^\W\d_] holds
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


def _belongs(left: str, right: str, keep: Collection[str], lexicon: Lexicon) -> bool:
    """Is the hyphen between these texts part of the word?"""
    a, b = _CLOSING.search(left)[0], _OPENING.match(right)[0]
    x, y = a.lower(), b.lower()
    if (len(a) >= 2 and a.isupper() and a.isalpha()) or x in _FIRST or y in _LAST or (x, y) in _PAIRS or (x == "по" and y.endswith(_AFTER_PO)) or f"{x}-{y}" in keep:
        return True
    return bool(lexicon) and min(len(a), len(b)) >= 3 and not lexicon.knows(a + b) and lexicon.knows(a) and lexicon.knows(b)


def _open(right: str) -> bool:
    """May a broken word go on here: a lower-case word, no initial, no conjunction?"""
    word = _OPENING.match(right)[0]
    return right[:1].islower() and word.lower() not in _CONJUNCTIONS and not (len(word) == 1 and right[1:2] == ".")


def _lines(text: str, keep: Collection[str], lexicon: Lexicon) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        if out:
            head, tail = out[-1].rstrip(), line.lstrip()
            if head.endswith("-") and head[-2:-1].isalpha() and _open(tail):
                out[-1] = (head if _belongs(head[:-1], tail, keep, lexicon) else head[:-1]) + tail
                continue
        out.append(line)
    return out


def _within(line: str, keep: Collection[str], lexicon: Lexicon) -> str:
    def one(m: re.Match[str]) -> str:
        left, right = line[: m.start()], line[m.end() :]
        if not left[-1:].isalpha() or not _open(right):
            return m[0]
        if _belongs(left, right, keep, lexicon):
            return "-"
        word = _CLOSING.search(left)[0]
        return "" if len(word) >= 2 and not any(c.isupper() for c in word) else m[0]

    return re.sub("- ", one, line)


def repair(text: str, keep: Collection[str] = (), lexicon: Lexicon = EMPTY) -> str:
    if "-" not in text:
        return text
    return "\n".join(_within(line, keep, lexicon) for line in _lines(text, keep, lexicon))


def compounds(texts: Iterable[str]) -> set[str]:
    """Lower-case pairs of the hyphenated words that stand unbroken in the texts."""
    out: set[str] = set()
    for t in texts:
        for m in _COMPOUND.finditer(t):
            parts = m[0].lower().split("-")
            out.update(map("-".join, zip(parts, parts[1:], strict=False)))
    return out


def _repaired(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else repair(t, set() if k is None else set(k)) for t, k in zip(text, keep, strict=True)], dtype=object)


def _repaired_by_itself(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else repair(t, compounds([t])) for t in text], dtype=object)


def repair_hyphenation(text: Column, keep: Column | None = None) -> Column:
    """``keep``: a column with the compounds of the document that the text is part of; without it, the text's own count."""
    return F.pandas_udf(_repaired_by_itself, "string")(text) if keep is None else F.pandas_udf(_repaired, "string")(text, keep)


def compound_pairs(text: Column) -> Column:
    """array<string> of the pairs in one text, natively."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"({_JAVA_LETTER}+(?:-{_JAVA_LETTER}+)+)"), F.lit(1))
    pairs = F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.size(F.split(w, "-")) - 1), lambda i: F.concat_ws("-", F.slice(F.split(w, "-"), i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.flatten(pairs)))
