"""Script of a text and transliteration, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import CYRILLIC


def cyrillic_letters(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{CYRILLIC}]", ""))


def latin_letters(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, "[a-zA-Z]", ""))


def script_of(text: Column) -> Column:
    """cyrillic, latin or mixed by the share of letters; none without letters."""
    c, both = cyrillic_letters(text), cyrillic_letters(text) + latin_letters(text)
    share = c / both
    return F.when(both == 0, "none").when(share >= 0.9, "cyrillic").when(share <= 0.1, "latin").otherwise("mixed")


def script(text: str) -> str:
    c = sum("Ѐ" <= x <= "ӿ" for x in text)
    n = c + sum(x.isascii() and x.isalpha() for x in text)
    return "none" if not n else "cyrillic" if c / n >= 0.9 else "latin" if c / n <= 0.1 else "mixed"


# Uzbek Cyrillic letters and their Latin spelling; е, ц and ь depend on what stands before.
_SINGLE = dict(zip("абвгджзийклмнопрстуфхқҳыэ", "abvgdjziyklmnoprstufxqhie", strict=True))
_SEVERAL = {"ғ": "g'", "ё": "yo", "ў": "o'", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "'", "ю": "yu", "я": "ya"}
_VOWELS = "аеёиоуўэюяы"


def to_latin(text: Column) -> Column:
    """Uzbek Cyrillic to Latin in lower case."""
    t = F.lower(text)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}])е|(?<=[{_VOWELS}ъь])е", "ye")
    t = F.regexp_replace(t, rf"(?<=[{_VOWELS}]|ye)ц", "ts")
    t = F.regexp_replace(F.regexp_replace(t, "ц", "s"), "е", "e")
    for c, latin in _SEVERAL.items():
        t = F.replace(t, F.lit(c), F.lit(latin))
    return F.translate(t, "".join(_SINGLE) + "ь", "".join(_SINGLE.values()))


def latin(text: str) -> str:
    """The same for one string."""
    out, before = [], ""
    for c in text.lower():
        soft = not before.isalpha() or before in _VOWELS or before in "ъь"
        if c == "е":
            out.append("ye" if soft else "e")
        elif c == "ц":
            out.append("ts" if before and before in _VOWELS else "s")
        elif c != "ь":
            out.append(_SINGLE.get(c) or _SEVERAL.get(c) or c)
        before = c
    return "".join(out)


def to_cyrillic(text: str) -> str:
    """Uzbek Latin to Cyrillic, for training texts."""
    t = text.lower()
    for a in "‘’ʻʼ`":
        t = t.replace(a, "'")
    for a, c in (("o'", "ў"), ("g'", "ғ"), ("sh", "ш"), ("ch", "ч"), ("ye", "е"), ("yo", "ё"), ("yu", "ю"), ("ya", "я"), ("ts", "ц")):
        t = t.replace(a, c)
    back = {v: k for k, v in _SINGLE.items() if k not in "ыэ"}
    out = [("э" if not i or not t[i - 1].isalpha() else "е") if c == "e" else "ъ" if c == "'" else back.get(c, c) for i, c in enumerate(t)]
    return "".join(out)
