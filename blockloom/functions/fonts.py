"""What font names and spans tell, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_symbol(font: Column) -> Column:
    return F.lower(font).rlike("symbol|wingding|webding|dingbats")


def is_bold(font: Column) -> Column:
    return F.lower(font).contains("bold")


def is_italic(font: Column) -> Column:
    return F.lower(font).rlike("italic|oblique")


def family(font: Column) -> Column:
    """Without subset prefix, style words and vendor suffix; the whole name if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(font, "^[A-Z]{6}\\+", ""), "[-,].*$", "")
    name = F.regexp_replace(F.lower(name), "bold|italic|oblique|regular|semibold|demibold|medium|light|black|heavy|roman$", "")
    name = F.regexp_replace(F.replace(name, F.lit(" "), F.lit("")), "(?:psmt|mt|ps)$", "")
    return F.when(name == "", F.lower(font)).otherwise(name)


def symbol_span(text: Column, font: Column) -> Column:
    return is_symbol(font) | text.rlike(r"^\s*[\x{E000}-\x{F8FF}]+\s*$")


def reference_mark(text: Column, before: Column, superscript: Column, size: Column, line_size: Column, y: Column, baseline: Column) -> Column:
    """A raised number of up to three digits behind a word: a footnote's mark."""
    raised = (size <= 0.8 * line_size) & (y <= baseline - 0.15 * line_size)
    return F.trim(text).rlike("^[0-9]{1,3}$") & (F.trim(before) != "") & (superscript | F.coalesce(raised, F.lit(False)))


def scanned(images_area: Column, page_area: Column, images: Column, chars: Column) -> Column:
    """A page whose text is in pictures: images and hardly any text, or mostly images with a stamp."""
    return (images > 0) & ((chars < 25) | ((page_area > 0) & (images_area >= 0.5 * page_area) & (chars < 200)))
