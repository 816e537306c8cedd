"""Text cleanup: canonical composition, invisible characters, spaces, look-alike letters, apostrophes, dot leaders.

Only composition and the look-alike letters need Python; a batch of texts crosses to it once, in Arrow.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars
from .lexicon import EMPTY, Lexicon
from .symbols import map_symbols

# Cyrillic letters with a Latin twin, and Latin letters with one in the Russian or Uzbek alphabet.
_TO_LATIN = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅԚԜ", "aeopcyxijshdqwlABEKMHOPCTXYIJSQW", strict=True))
_TO_CYRILLIC = dict(zip("aceopxyABCEHKMOPTXY", "асеорхуАВСЕНКМОРТХУ", strict=True))
_WORD = re.compile(rf"(?:[^\W\d_]|[{chars.APOSTROPHES}])+")
_WORD_END = re.compile(rf"(?:[^\W\d_]|[{chars.APOSTROPHES}])*$")
_DROP = {ord(c): None for c in chars.INVISIBLE} | {ord(c): " " for c in chars.SPACES}
_LEADERS = re.compile(r"[.…](?: *[.…])*")
_ENGLISH = re.compile(r"(?:s|t|re|ve|ll|d|m)(?![^\W\d_])", re.IGNORECASE)


def _script(c: str) -> str:
    if chars.is_cyrillic(c):
        return "c" if c.isalpha() else ""
    return "l" if (c.isascii() or "À" <= c <= "ɏ") and c.isalpha() else ""


def _rewritten(word: str, target: str) -> str | None:
    twins = _TO_LATIN if target == "l" else _TO_CYRILLIC
    out = [c if _script(c) in ("", target) else twins.get(c) for c in word]
    return None if None in out else "".join(out)


def fix_mixed_words(text: str, lexicon: Lexicon = EMPTY) -> tuple[str, int]:
    """Each word in one script: the version that is the only known word, else its majority's, else the text's."""
    if not re.search(f"[{chars.CYRILLIC}]", text):
        return text, 0
    tally = Counter(map(_script, text))
    whole = max("lc", key=lambda s: tally[s]) if tally["l"] != tally["c"] else None
    changed = 0

    def one(m: re.Match[str]) -> str:
        nonlocal changed
        n = Counter(map(_script, m[0]))
        if not n["l"] or not n["c"]:
            return m[0]
        versions = {s: v for s in "lc" if (v := _rewritten(m[0], s)) is not None}
        known = [v for v in versions.values() if lexicon.knows(v)]
        major = whole if n["l"] == n["c"] else max("lc", key=lambda s: n[s])
        chosen = known[0] if len(known) == 1 else versions.get(major)
        changed += chosen is not None
        return m[0] if chosen is None else chosen

    return _WORD.sub(one, text), changed


def _apostrophes(text: str, lexicon: Lexicon) -> str:
    """The Uzbek letters oʻ and gʻ and the mark in maʼlumot; English endings keep theirs."""

    def one(m: re.Match[str]) -> str:
        i, c = m.start(), m[0]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        og = before in tuple("oOgG")
        if c in "‘ʻ" and og:
            return "ʻ"
        if not (before.isascii() and before.isalpha() and after.isascii() and after.isalpha()):
            return c
        if _ENGLISH.match(text, i + 1):
            start = _WORD_END.search(text, 0, i).start()
            tail = re.match(r"[^\W\d_]*", text[i + 1 :])[0]
            if not lexicon.knows(text[start : i + 1] + tail):
                return c
        return "ʻ" if og else "ʼ"

    return re.sub(f"[{chars.APOSTROPHES}]", one, text)


def clean(text: str, lexicon: Lexicon = EMPTY) -> tuple[str, int, int, int]:
    """(text, mixed words made single, symbols mapped, symbols dropped)."""
    text = unicodedata.normalize("NFC", text).translate(_DROP)
    text, mapped, dropped = map_symbols(text)
    text, mixed = fix_mixed_words(text, lexicon)
    text = _apostrophes(text, lexicon)
    text = re.sub(rf"([{chars.GLYPH_BULLETS}])(?=[^\W_])", r"\1 ", text)
    text = _LEADERS.sub(lambda m: " … " if m[0].count(".") + 3 * m[0].count("…") >= 4 else m[0], text)
    text = re.sub(r" *\n *", "\n", re.sub(" {2,}", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip(" \n"), mixed, mapped, dropped


def _cleaned(texts: pd.Series) -> pd.DataFrame:
    rows = [clean(t) if t is not None else (None, 0, 0, 0) for t in texts]
    return pd.DataFrame(rows, columns=["text", "mixed_words", "symbols_mapped", "symbols_removed"])


def clean_text(text: Column) -> Column:
    """struct<text, mixed_words, symbols_mapped, symbols_removed>; select it once, then its fields."""
    return F.pandas_udf(_cleaned, "struct<text:string,mixed_words:int,symbols_mapped:int,symbols_removed:int>")(text)


def nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return compose(text)
