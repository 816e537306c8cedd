"""Character classes for Python's and Java's regular expressions alike."""

from __future__ import annotations

import re

# Characters that serve as apostrophes.
APOSTROPHES = "'‘’`´′＇ʻʼʹ"
CYRILLIC = "Ѐ-ӿ"
# List bullets, and those among them that are pictures only.
BULLETS = "•·▪●○■◦–—-*✓✔➢➤►▶◆❖□✦✧"
GLYPH_BULLETS = "•▪●○■◦✓✔➢➤►▶◆❖□✦✧"
# Characters without visible content, and spaces of other widths.
INVISIBLE = "­​‌‍⁠﻿\r"
SPACES = "       \t\x0b\x0c"

#: Placeholders of shared patterns: letters, lower-case letters, and letters or digits.
_PYTHON = {"<L>": r"[^\W\d_]", "<a>": "a-zа-яёўқғҳ", "<N>": r"[^\W_]"}
_JAVA = {"<L>": r"\p{L}", "<a>": r"\p{Ll}", "<N>": r"[\p{L}\p{N}]"}


def python_pattern(shared: str) -> re.Pattern[str]:
    for mark, is_ in _PYTHON.items():
        shared = shared.replace(mark, is_)
    return re.compile(shared)


def java_pattern(shared: str) -> str:
    for mark, is_ in _JAVA.items():
        shared = shared.replace(mark, is_)
    return "(?U)" + shared


def is_cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ӿ"


def bare(word: str) -> str:
    """Lower case, without apostrophes."""
    return word.translate(_NO_APOSTROPHE).lower()


_NO_APOSTROPHE = dict.fromkeys(map(ord, APOSTROPHES))
