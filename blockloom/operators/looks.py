"""How a block looks and reads: the predicates that several stages share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any, NamedTuple

BOLD, BIGGER, CAPS_LETTERS, CAPS_SHARE = 0.6, 1.15, 4, 0.9
TITLE_WORDS, TITLE_CHARS, KEYWORD_CHARS = 8, 160, 300
STOPS = ".?!:…;"
_CAPITAL = "A-ZА-ЯЁЎҚҒҲ"
_SIGNED = re.compile(rf"(?:^|\s)(?:[{_CAPITAL}][a-zа-яёўқғҳ]?\.\s?){{1,2}}[{_CAPITAL}][{_CAPITAL}ʻʼ‘’'-]{{2,}}$")
_OPERATOR = re.compile(r"[=<>±×÷∑∏√∫≈≠≤≥]")

Box = tuple[float, float, float, float]


@dataclass
class Raw:
    """A block as a reader found it; see schema.RAW_BLOCKS."""

    text: str
    page: int = 1
    bbox: Box | None = None
    font_size: float | None = None
    bold: float = 0.0
    italic: float = 0.0
    font: str | None = None
    heading_level: int | None = None
    heading_source: str | None = None
    list_item: bool = False
    rows: list[list[str]] | None = None
    spans: list[dict[str, int]] | None = None
    role: str | None = None
    footnote: bool = False
    footnote_refs: list[str] = field(default_factory=list)
    original: str = ""
    spaced: bool = False
    in_figure: bool = False
    tagged: bool = False
    layout_title: bool = False

    @classmethod
    def of(cls, row: dict[str, Any]) -> Raw:
        """From a table row; null means the default."""
        known = {f.name: row[f.name] for f in fields(cls) if row.get(f.name) is not None}
        if "bbox" in known:
            b = known["bbox"]
            known["bbox"] = (b["x0"], b["y0"], b["x1"], b["y1"])
        return cls(**{"text": "", **known})


class Style(NamedTuple):
    font: str
    size: float
    bold: bool
    italic: bool
    caps: bool

    def describe(self) -> str:
        traits = " ".join(n for n, on in (("bold", self.bold), ("italic", self.italic)) if on)
        return f"{self.font or '?'} {self.size:g}{' caps' if self.caps else ''} {traits or 'regular'}"


def flat(text: str) -> str:
    return " ".join(text.split())


def key(text: str) -> str:
    return "".join(filter(str.isalnum, text.lower()))


def half_point(size: float | None) -> float:
    """To the nearest half, halves to even."""
    return round((size or 0.0) * 2) / 2


def capitals(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= CAPS_LETTERS and sum(map(str.isupper, letters)) >= CAPS_SHARE * len(letters)


def style_of(raw: Raw) -> Style | None:
    if raw.rows is not None or not raw.font_size:
        return None
    return Style(raw.font or "", half_point(raw.font_size), raw.bold >= BOLD, raw.italic >= BOLD, capitals(raw.text))


def look_of(raw: Raw, text: str) -> tuple[float, bool, bool]:
    return half_point(raw.font_size), raw.bold >= BOLD, capitals(text)


def opens_lower(text: str) -> bool:
    return next((c for c in text if c.isalpha()), "").islower()


def real_words(text: str) -> bool:
    """A word of three letters, and mostly letters."""
    solid = "".join(text.split())
    return bool(re.search(r"[^\W\d_]{3,}", text)) and sum(map(str.isalpha, solid)) >= 0.5 * len(solid)


def signature(text: str) -> bool:
    return bool(_SIGNED.search(text.strip()))


def formula(text: str) -> bool:
    return bool(_OPERATOR.search(text)) and sum(len(re.sub(r"\W", "", w)) >= 4 for w in text.split()) < 2
