"""Section numbers and list markers at the start of a line.

The shapes are regular expressions without look-around, so that the Column form and the Python form share them and SQL
can check them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from . import chars

_ROMAN = "IVXLCІХ"
_WORD = f"(?:<L>|[{chars.APOSTROPHES}])+"
_SECTION_SIGN_DEPTH = 3
# Stems of Russian ordinals.
_ORDINALS = "перв|втор|трет|четв|пят|шест|седьм|восьм|девят|десят"
_AP = f"[{chars.APOSTROPHES}]*"

SIGN_FIRST = r"^§\s+[0-9]"
WORD_FIRST = rf"^({_WORD})\s+(?:(?:№\s*)?[0-9{_ROMAN}]|(?i:{_ORDINALS}))"
SIGN_AFTER = r"^[0-9]{1,3}[¹²³⁰⁴-⁹]*\s*-\s*§"
NUMBER_FIRST = rf"^[0-9]{{1,3}}[¹²³⁰⁴-⁹]*\s*-\s*({_WORD})"
ROMAN_FIRST = rf"^[{_ROMAN}]{{1,6}}(?:\s*-\s*|\s+)({_WORD})"
DECIMAL_DOT = r"^([0-9]{1,3}(?:\.[0-9]{1,3})*)\s*\.(?:\s+\S|<L>|[“«„\"(‘'])"
DECIMAL = r"^([0-9]{1,3}(?:\.[0-9]{1,3})+)\s+[^\s.<a>]"
ROMAN = rf"^([{_ROMAN}]{{1,6}})\.\s+\S"
BULLET = rf"^[{chars.BULLETS.replace('-', '')}-]\s|^[{chars.GLYPH_BULLETS}]<N>"
ORDERED = r"^\(?(?:<N>|[0-9]{2})\)\s"

_RE = {k: chars.python_pattern(v) for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and v.startswith("^")}
_FIRST_WORD = chars.python_pattern(f"^{_WORD}")
_RANKS = {chars.bare(w): r for w, r in config.HEADING_KEYWORDS.items()}


def _ordinal_ok(word: str) -> bool:
    word = chars.bare(word)
    return len(word) >= 5 and word.endswith(("nchi", "нчи"))


def keyword_depth(text: str, ranks: Mapping[str, int] = _RANKS) -> int | None:
    if _RE["SIGN_FIRST"].match(text):
        return _SECTION_SIGN_DEPTH
    if (m := _RE["WORD_FIRST"].match(text)) and (rank := ranks.get(chars.bare(m[1]))):
        return rank
    if _RE["SIGN_AFTER"].match(text):
        return _SECTION_SIGN_DEPTH
    if m := _RE["NUMBER_FIRST"].match(text):
        return ranks.get(chars.bare(m[1]))
    word = _FIRST_WORD.match(text)
    if word and _ordinal_ok(word[0]):
        rest = text[word.end() :].lstrip().removeprefix("-").lstrip()
        after = _FIRST_WORD.match(rest)
        return ranks.get(chars.bare(after[0])) if after else None
    if m := _RE["ROMAN_FIRST"].match(text):
        return ranks.get(chars.bare(m[1]))
    return None


def numbering(line: str, ranks: Mapping[str, int] = _RANKS) -> tuple[str, int] | None:
    """(kind, depth): keyword, decimal, bullet or ordered; None without a marker."""
    text = line.lstrip()
    if (depth := keyword_depth(text, ranks)) is not None:
        return "keyword", depth
    if m := _RE["DECIMAL_DOT"].match(text):
        return "decimal", m[1].count(".") + 1
    if (m := _RE["DECIMAL"].match(text)) and not text[m.end() - 1].islower():
        return "decimal", m[1].count(".") + 1
    if (m := _RE["ROMAN"].match(text)) and m[1] != "Х":
        return "decimal", 1
    if _RE["BULLET"].match(text):
        return "bullet", 1
    if _RE["ORDERED"].match(text):
        return "ordered", 1
    return None


def numbering_info(line: Column, ranks: Mapping[str, int] = _RANKS) -> Column:
    """struct<kind, depth> as a native expression; null without a marker."""
    j = chars.java_pattern
    text = F.regexp_replace(line, r"(?U)^\s+", "")
    table = F.create_map(*[F.lit(x) for w, r in ranks.items() for x in (w, r)])
    plain = lambda c: F.lower(F.translate(c, chars.APOSTROPHES, ""))
    rank = lambda c: F.try_element_at(table, plain(c))
    word = F.regexp_extract(text, j(f"^({_WORD})"), 1)
    ordinal = (F.char_length(plain(word)) >= 5) & plain(word).rlike("(?:nchi|нчи)$")
    after = F.regexp_extract(text, j(rf"^{_WORD}\s*-?\s*({_WORD})"), 1)
    digits = text.rlike(j(NUMBER_FIRST))
    later = (
        F.when(text.rlike(j(SIGN_AFTER)), F.lit(_SECTION_SIGN_DEPTH))
        .when(digits, rank(F.regexp_extract(text, j(NUMBER_FIRST), 1)))
        .when(ordinal, rank(after))
        .when(text.rlike(j(ROMAN_FIRST)), rank(F.regexp_extract(text, j(ROMAN_FIRST), 1)))
    )
    first = F.when(text.rlike(j(SIGN_FIRST)), F.lit(_SECTION_SIGN_DEPTH)).when(text.rlike(j(WORD_FIRST)), rank(F.regexp_extract(text, j(WORD_FIRST), 1)))
    depth = F.coalesce(first, later)
    groups = lambda p: F.size(F.split(F.regexp_extract(text, j(p), 1), r"\."))
    pair = lambda kind, d: F.struct(F.lit(kind).alias("kind"), d.cast("int").alias("depth"))
    one = F.lit(1)
    return (
        F.when(depth.isNotNull(), pair("keyword", depth))
        .when(text.rlike(j(DECIMAL_DOT)), pair("decimal", groups(DECIMAL_DOT)))
        .when(text.rlike(j(DECIMAL)), pair("decimal", groups(DECIMAL)))
        .when(text.rlike(j(ROMAN)) & (F.regexp_extract(text, j(ROMAN), 1) != "Х"), pair("decimal", one))
        .when(text.rlike(j(BULLET)), pair("bullet", one))
        .when(text.rlike(j(ORDERED)), pair("ordered", one))
    )


def bare_keyword_rank(text: str) -> int | None:
    """Rank of a heading word that stands alone."""
    return config.HEADING_KEYWORDS.get(text.strip().rstrip(".:").casefold())


def is_label(text: str) -> bool:
    """A section label and nothing else."""
    text = text.strip()
    if bare_keyword_rank(text) is not None:
        return True
    found = numbering(text)
    return bool(found) and found[0] == "keyword" and sum(any(map(str.isalpha, w)) for w in text.replace("№", " ").split()) <= 1


def names_appendix(title: str) -> bool:
    words = title.translate({ord("-"): " ", ord("№"): " "}).casefold().split()[:3]
    return any(w.strip(".:") in config.APPENDIX_WORDS for w in words)
