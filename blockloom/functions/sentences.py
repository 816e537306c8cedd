"""Sentence boundaries of Russian and Uzbek texts.

A delimiter ends a sentence unless its surroundings speak against it: an abbreviation, an initial, a list number, a quotation
mark or bracket without an ending inside, a dialogue dash, or lower case after it. The abbreviations and the order of
the tests follow the published razdel method (MIT licence).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks by their part in a sentence.
_ENDS, _DASHES, _CLOSERS, _QUOTES, _BRACKETS = ".?!…", "‑–—−-", "»”’", "\"„'", ")]}"
_MARKERS = "§абвгдеabcdef"
# Abbreviations before numbers and lower case, those that never end a sentence, and others.
_TAIL = frozenset(
    "дес тыс млн млрд дол долл коп руб р проц га барр куб кв км см час мин сек в вв г гг с стр co corp inc изд ед др al "
    "y yy й йй mln mlrd ming минг sh ш km кг kg t m м b б vil вил tum тум".split()
)
_HEAD = frozenset(
    "букв ст трад лат венг исп кат укр нем англ фр итал греч евр араб яп слав кит рус русск латв словацк хорв mr mrs ms dr vs св "
    "арх зав зам проф акад кн корр ред гр ср чл им тов нач пол chap п пп ч чч гл абз пт no просп пр ул ш гор д к корп пер обл "
    "эт пом ауд оф ком комн каб домовлад лит т рп пос х пл bd о оз а обр ум ок откр пс ps upd напр доп юр физ тел сб внутр дифф "
    "гос отм prof dots доц akad mas qar қар tahr таҳр j ж koʻch кўч".split()
)
_OTHER = frozenset("сокр рис искл прим яз устар шутл".split())
# Abbreviations of two letters; those of the second kind never end a sentence.
_TAIL_PAIRS = frozenset("т п|т д|у е|н э|p m|a m|с г|р х|с ш|з д|л с|ч т|h k|ҳ к|ед ч|мн ч|повел накл|жен р|муж р".split("|"))
_HEAD_PAIRS = frozenset("т е|т к|т н|и о|к н|к п|п н|к т|л д|f d|f n|ф д|ф н".split("|"))
_INITIALS = frozenset("дж ed вс sh ch oʻ gʻ ш ч".split())
_SPAN = 10
_MARKER_SIZE = 20

_TOKEN = re.compile(r"(?:[^\W\d_]|[ʻʼ])+|[0-9]+|\S")
_DELIMITER = re.compile("[" + re.escape(_ENDS + ";" + _QUOTES + _CLOSERS + _BRACKETS) + "]")
_PAIR = re.compile(r"([^\W_])\s*\.\s*([^\W_])\s*$")
_ROMAN = frozenset("IVXMLІ")


def _lower_word(token: str) -> bool:
    return token.isalpha() and any(map(str.islower, token)) and not any(map(str.isupper, token))


def _marker(token: str) -> bool:
    return token.isdigit() or (len(token) == 1 and (token in ".)" or token.lower() in _MARKERS)) or set(token) <= _ROMAN


def _goes_on(token: str) -> bool:
    """After an abbreviation: a number, a sign or lower case."""
    return token.isdigit() or not token.isalpha() or _lower_word(token)


@dataclass(frozen=True)
class _Place:
    """A delimiter with what stands around it."""

    before: str
    mark: str
    after: str
    sentence: str

    def ends(self) -> bool:
        left, right = _TOKEN.findall(self.before), _TOKEN.findall(self.after)
        if not left or not right or not self.after[0].isspace() or _lower_word(right[0]):
            return False
        last, first = left[-1], right[0]
        if len(first) == 1 and first not in _QUOTES and first in _ENDS + ";" + _CLOSERS + _BRACKETS:
            return False
        if self.mark == "." and self._abbreviated(last, first):
            return False
        if self.mark in ".)" and len(self.sentence) <= _MARKER_SIZE and all(map(_marker, _TOKEN.findall(self.sentence))):
            return False
        if self.mark in _QUOTES and self.before[-1].isspace():
            return False
        if self.mark in _QUOTES + _CLOSERS + _BRACKETS and not set(last) <= set(_ENDS):
            return False
        if set(first) <= set(_DASHES):
            word = re.search(r"[^\W_]+", self.after)
            return not (word and _lower_word(word[0]))
        return True

    def _abbreviated(self, last: str, first: str) -> bool:
        m, word = _PAIR.search(self.before), last.lower()
        pair = f"{m[1]} {m[2]}".lower() if m else ""
        if pair in _HEAD_PAIRS or (pair in _TAIL_PAIRS and _goes_on(first)):
            return True
        # a pair that may end a sentence isn't taken apart
        if pair not in _TAIL_PAIRS and (word in _HEAD or (word in _TAIL | _OTHER and _goes_on(first))):
            return True
        if f"{word} {first.lower()}" in _TAIL_PAIRS | _HEAD_PAIRS:
            return True
        return (len(last) == 1 and last.isupper()) or word in _INITIALS


def split(text: str) -> list[str]:
    out, start = [], 0
    for m in _DELIMITER.finditer(text):
        i, j = m.span()
        if _Place(text[max(0, i - _SPAN) : i], m[0], text[j : j + _SPAN], text[start:i]).ends():
            out.append(text[start:j].strip())
            start = j
    return [s for s in (*out, text[start:].strip()) if s]


def breaks(left: str, right: str) -> bool:
    """Does a sentence end between two texts? One without a final delimiter runs on."""
    left = left.rstrip()
    if not left or not _DELIMITER.match(left[-1]):
        return False
    body = left[:-1]
    return _Place(body[-_SPAN:], left[-1], (" " + right.lstrip())[:_SPAN], body.lstrip()).ends()


def ends_open(text: str) -> bool:
    """Does the text end with an abbreviation that leaves the sentence open?"""
    return text.rstrip().endswith(".") and not breaks(text, "A")


def _split(texts: pd.Series) -> pd.Series:
    return texts.map(split, na_action="ignore")


def _breaks(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([breaks(a or "", b or "") for a, b in zip(left, right, strict=True)])


def split_sentences(text: Column) -> Column:
    return F.pandas_udf(_split, "array<string>")(text)


def is_sentence_break(left: Column, right: Column) -> Column:
    return F.pandas_udf(_breaks, "boolean")(left, right)
