"""Language of Russian and Uzbek texts (Latin and Cyrillic), from marker words and, where one is given, an n-gram model.

Sentences are judged one by one, so that a text is mixed only where whole sentences are in another language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars
from .scripts import script

# Stop words, endings and letters that vote for a language.
_RU_WORDS = frozenset(
    "и в не на что это как по для от из или при если который также может быть настоящий договор стороны статья после все его "
    "они без под над между является должен должны которые которых которая только уже так где когда чем был была были этот эти этого".split()
)
_UZ_WORDS = frozenset(
    "ва учун билан бу ёки ҳамда бўйича эса бўлган керак мумкин лозим тартиби қоидалар ушбу каби ҳақида томонидан мазкур агар "
    "кейин шунингдек янги шу бир энг va uchun bilan bu yoki hamda boyicha esa bolgan kerak mumkin lozim tartibi qoidalar ushbu "
    "kabi haqida tomonidan umumiy xizmat respublikasi".split()
)
_UZ_LATIN_ENDS = ("dagi", "ligi", "lik", "lari", "larni", "larga", "lardan", "larning")
_UZ_CYRILLIC_ENDS = ("даги", "лиги", "лари", "ларни", "ларга", "лардан", "ларда", "сида", "ланган", "лган", "нган")
_RU_ENDS = ("ться", "тся", "ого", "ому", "ость", "ости", "ению", "ением")
_STRONG, _WEAK = 4.0, 1.5
_MODEL_WEIGHT, _MODEL_WORDS = 0.1, 40
_SENTENCE_WORDS, _SENTENCE_EVIDENCE, _MIXED_SHARE = 4, 3.0, 0.2

_WORDS = re.compile(rf"(?:[^\W\d_]|[{chars.APOSTROPHES}])+")
_PARTS = re.compile(r"[.!?…\n]")
_OWN_LETTERS = re.compile("[ўқғҳ]")
_DIGRAPH = re.compile(f"[og][{chars.APOSTROPHES}]", re.IGNORECASE)

#: (classes, word) -> log-probability of the first class over the second; classes uz_cyrl/ru or uz_latn/other.
Ratio = Callable[[str, str], float]


class Detected(NamedTuple):
    language: str
    script: str
    confidence: float


UNKNOWN = Detected("unknown", "none", 0.0)


def _vote(word: str) -> tuple[float, str]:
    """(evidence for Uzbek, script: c, l or nothing if the word tells none)."""
    low = chars.bare(word)
    c, l = any(map(chars.is_cyrillic, low)), any(x.isascii() and x.isalpha() for x in low)
    kind = "" if c == l else "c" if c else "l"
    if _OWN_LETTERS.search(low):
        return _STRONG, kind
    if "ы" in low or "щ" in low:
        return -_STRONG, kind
    if l and not c and _DIGRAPH.search(word):
        return _STRONG, kind
    if len(low) < 2 or (len(low) <= 3 and not any(map(str.islower, word))):
        return 0.0, ""
    if c and low in _RU_WORDS:
        return -_WEAK, kind
    if low in _UZ_WORDS:
        return _WEAK, kind
    if kind == "c" and len(low) >= 6:
        if low.endswith(_UZ_CYRILLIC_ENDS) or (low.endswith("нинг") and len(low) >= 9):
            return _WEAK, kind
        if low.endswith(_RU_ENDS):
            return -_WEAK, kind
    if kind == "l" and (re.search("q(?!u)", low) or (len(low.encode()) >= 6 and low.endswith(_UZ_LATIN_ENDS))):
        return _WEAK, kind
    return 0.0, kind


class _Evidence:
    def __init__(self) -> None:
        self.words = {"c": 0, "l": 0}
        self.score = {"c": 0.0, "l": 0.0}

    def add(self, word: str, ratio: Ratio | None) -> None:
        vote, kind = _vote(word)
        if not kind:
            return
        if ratio and self.words[kind] < _MODEL_WORDS:
            plain = "".join("'" if x in chars.APOSTROPHES else x for x in word.lower()).lstrip("'")
            self.score[kind] += _MODEL_WEIGHT * ratio(kind, plain)
        self.score[kind] += vote if kind == "c" else max(vote, 0.0)
        self.words[kind] += 1

    def merge(self, others: Iterable[_Evidence]) -> _Evidence:
        for o in others:
            for k in "cl":
                self.words[k] += o.words[k]
                self.score[k] += o.score[k]
        return self

    def total(self) -> int:
        return self.words["c"] + self.words["l"]

    def language(self, kind: str) -> tuple[str, float] | None:
        s = self.score[kind]
        if not self.words[kind]:
            return None
        if kind == "c":
            return ("uz" if s > 0 else "ru"), abs(s)
        return ("uz", s) if s > 0 else None


def _mixed(parts: list[_Evidence]) -> float | None:
    share = {"uz": 0, "ru": 0}
    for p in parts:
        found = p.language("c" if p.words["c"] >= p.words["l"] else "l")
        if p.total() >= _SENTENCE_WORDS and found and found[1] >= _SENTENCE_EVIDENCE:
            share[found[0]] += p.total()
    n = sum(share.values())
    if not n or min(share.values()) / n < _MIXED_SHARE:
        return None
    return 1.0 - abs(share["uz"] - share["ru"]) / n


def detect(text: str, ratio: Ratio | None = None) -> Detected:
    kind = script(text)
    if kind == "none":
        return UNKNOWN
    parts = []
    for piece in _PARTS.split(text):
        e = _Evidence()
        for w in _WORDS.findall(piece):
            e.add(w, ratio)
        if e.total():
            parts.append(e)
    whole = _Evidence().merge(parts)
    found = [f for f in (whole.language("c"), whole.language("l")) if f]
    if not found:
        return Detected("unknown", kind, 0.0)
    if len(found) == 2 and kind == "mixed" and found[0][0] != found[1][0]:
        return Detected("mixed", kind, 1.0 - abs(2.0 * whole.words["c"] / whole.total() - 1.0))
    if (sure := _mixed(parts)) is not None:
        return Detected("mixed", kind, sure)
    language, score = max(found, key=lambda f: f[1])
    return Detected(language, kind, 1.0 / (1.0 + math.exp(-score)))


def locale(language: str, script_: str) -> str | None:
    if language == "ru":
        return "ru"
    return {"latin": "uz-Latn", "cyrillic": "uz-Cyrl"}.get(script_, "uz") if language == "uz" else None


def _detected(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(t) if t is not None else UNKNOWN for t in texts], columns=["language", "script", "confidence"])


def detect_language(text: Column) -> Column:
    """struct<language, script, confidence>."""
    return F.pandas_udf(_detected, "struct<language:string,script:string,confidence:double>")(text)


def locale_of(language: Column, script_: Column) -> Column:
    uz = F.when(script_ == "latin", "uz-Latn").when(script_ == "cyrillic", "uz-Cyrl").otherwise("uz")
    return F.when(language == "ru", "ru").when(language == "uz", uz)
