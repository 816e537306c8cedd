"""Text for private-use characters of symbol fonts."""

from __future__ import annotations

# The Symbol encoding from 0x20, a row of sixteen a line; ␀ has no text.
_SYMBOL = (
    " !∀#∃%&∋()*+,-./"
    "0123456789:;<=>?"
    "≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟ"
    "ΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_"
    "␀αβχδεφγηιϕκλμνο"
    "πθρστυϖωξψζ{|}∼␀"
    "␀␀␀␀␀␀␀␀␀␀␀␀␀␀␀␀"
    "␀␀␀␀␀␀␀␀␀␀␀␀␀␀␀␀"
    "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓"
    "°±″≥×∝∂•÷≠≡≈…␀␀↵"
    "ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉"
    "∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓"
    "◊〈®©™∑␀␀␀␀␀␀␀␀␀␀"
    "␀〉∫␀␀␀␀␀␀␀␀␀␀␀␀␀"
)
# Signs that are bullets where they open a line.
_OPENERS = frozenset("/-*•⋅◊♦♣♥♠→⇒∼")


def family(font_name: str | None) -> str:
    name = (font_name or "").lower()
    if any(part in name for part in ("wingding", "webding", "dingbat")):
        return "dingbats"
    return "symbol" if "symbol" in name else "unknown"


def _plain(code: int, font: str, opens_line: bool) -> str:
    if not 0x20 <= code <= 0xFF:
        return ""
    if font == "dingbats":
        sign = " " if code == 0x20 else "→" if 0xDF <= code <= 0xFA else "•"
    elif font == "unknown" and opens_line:
        sign = "•"
    else:
        sign = _SYMBOL[code - 0x20].replace("␀", "")
    return "•" if opens_line and sign in _OPENERS else sign


def map_symbols(text: str, font: str = "unknown") -> tuple[str, int, int]:
    """(text, characters given a text, characters dropped)."""
    if not any("" <= c <= "" for c in text):
        return text, 0, 0
    out: list[str] = []
    mapped = dropped = 0
    opens = True
    for c in text:
        if "" <= c <= "":
            sign = _plain(ord(c) - 0xF000, font, opens)
            mapped, dropped = mapped + bool(sign), dropped + (not sign)
            out.append(sign)
            opens = False
        else:
            out.append(c)
            opens = c == "\n" or (opens and c.isspace())
    return "".join(out), mapped, dropped


def map_symbol_font(text: str, font_name: str) -> tuple[str, int, int]:
    """For the text of a span: unchanged unless its font is one of symbols."""
    kind = family(font_name)
    return (text, 0, 0) if kind == "unknown" else map_symbols(text, kind)
