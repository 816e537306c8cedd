"""Furniture, footnotes, title page, contents, style profile, table score, document rows."""

import pytest
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.operators import documents, layout, profile, tables

BOX = lambda y, h=10.0: (70.0, float(y), 500.0, float(y) + h)


def raw(spark, rows):
    """rows: (text, page, y, more)."""
    out = []
    for i, (text, page, y, *more) in enumerate(rows):
        out.append({"document_id": "d", "pos": i, "text": text, "page": page, "bbox": BOX(y) if y is not None else None, **(more[0] if more else {})})
    return spark.createDataFrame(out, S.RAW_BLOCKS)


def heights(spark, n, h=800.0):
    return spark.createDataFrame([("d", p, h) for p in range(1, n + 1)], "document_id string, page int, height double")


def gone(spark, rows, n):
    return {r.text for r in layout.furniture(raw(spark, rows), heights(spark, n)).collect()}


def test_page_numbers_go_only_in_margins(spark):
    assert gone(spark, [("12", 1, 20), ("Страница 3 из 10", 1, 780), ("12", 1, 400), ("- xiv -", 1, 785), ("Matn", 1, 30)], 1) == {"12", "Страница 3 из 10", "- xiv -"}


def test_repeated_and_alternating_margins_go(spark):
    rows = [(f"Qoʻllanma, {p}-nashr", p, 20) for p in (1, 2, 3)] + [("Yagona matn", 2, 50)]
    assert gone(spark, rows, 4) == {f"Qoʻllanma, {p}-nashr" for p in (1, 2, 3)}
    book = [("Chap sarlavha", p, 20) for p in (2, 4)] + [("Oʻng", 5, 20)]
    assert gone(spark, book, 8) == {"Chap sarlavha"}


def test_running_titles_and_their_place(spark):
    rows = [("Bob nomi", p, 20, {"font_size": 9.0}) for p in (10, 11, 12)] + [("Qisqa bob", 20, 20, {"font_size": 9.0}), ("Boshqa joy", 21, 50, {"font_size": 9.0})]
    assert gone(spark, rows, 40) == {"Bob nomi", "Qisqa bob"}


def test_footnotes_are_small_or_answer_a_mark(spark):
    rows = [("Asosiy matn " * 9, 1, 100, {"font_size": 11.0, "footnote_refs": ["3"]}), ("1 Izoh matni", 1, 760, {"font_size": 8.0}), ("2 Izoh matni", 1, 200, {"font_size": 8.0}), ("3 Izoh matni", 1, 770, {"font_size": 11.0}), ("4 Izoh matni", 1, 780, {"font_size": 11.0})]
    out = layout.mark_footnotes(raw(spark, rows), heights(spark, 1)).filter("footnote").collect()
    assert {r.text[0] for r in out} == {"1", "3"}


def test_title_and_imprint_pages(spark):
    rows = [("VAZIRLIK", 1, 100), ("UNIVERSITET", 1, 200), ("TOSHKENT", 1, 300), ("ISBN 978-9943-01-123-4", 2, 100), ("Muharrir", 2, 120), ("soʻz " * 20, 2, 300), ("Matn", 3, 100)]
    out = layout.mark_imprint(layout.mark_title_page(raw(spark, rows), heights(spark, 3))).collect()
    assert {r.text.split()[0] for r in out if r.role == "title_page"} == {"VAZIRLIK", "UNIVERSITET", "TOSHKENT", "ISBN", "Muharrir"}


def test_contents_and_back_matter(spark):
    entries = lambda a: "\n".join(f"{i}-mavzu ........ {i * 9}" for i in range(a, a + 5))
    rows = [("Kirish matni", 1, 100), ("MUNDARIJA", 18, 50), (entries(1), 18, 100), (entries(6), 19, 100), ("Bosishga ruxsat etildi", 20, 100)]
    out = {r.text[:8]: r.role for r in layout.mark_contents(raw(spark, rows), heights(spark, 20)).collect()}
    assert out == {"Kirish m": None, "MUNDARIJ": "toc", entries(1)[:8]: "toc", entries(6)[:8]: "toc", "Bosishga": "back_matter"}


@pytest.mark.parametrize("line, entry, number", [("Bob … 12", True, 12), ("Kirish .....", True, None), ("I bob . . . . 7", True, 7), ("Narxi 2020", False, 2020), ("Xulosa 19", True, 19), ("  14 ", True, 14), ("99", False, 99), ("Oddiy gap, 12", False, None), ("...", True, None), ("", False, None)])
def test_entries_of_contents(spark, line, entry, number):
    assert tuple(spark.createDataFrame([(line, 20)], "line string, pages int").select(layout.contents_entry(F.col("line"), F.col("pages")).alias("e")).first().e) == (entry, number)


def test_lists_go_on_and_end(spark):
    """A second list needs a title; a page without entries ends a list; a note isn't the line above."""
    entries = "Kirish ..... 1\nBirinchi ..... 3\nIkkinchi ..... 8"
    rows = [("Roʻyxat", 1, 40), ("izoh", 1, 45, {"footnote": True}), (entries, 1, 50), ("Uchinchi ..... 9", 2, 50), ("Matn bu yerda", 3, 50), (entries, 4, 50), ("MUNDARIJA", 6, 40), (entries, 6, 50), ("Oxirgi soʻz", 10, 50)]
    out = {(r.page, r.text[:6]): r.role for r in layout.mark_contents(raw(spark, rows), heights(spark, 10)).collect()}
    assert out == {(1, "Roʻyxa"): "toc", (1, "izoh"): None, (1, "Kirish"): "toc", (2, "Uchinc"): "toc", (3, "Matn b"): None, (4, "Kirish"): None, (6, "MUNDAR"): "toc", (6, "Kirish"): "toc", (10, "Oxirgi"): None}


def test_profile_ranks_heading_styles(spark):
    rows = []
    for c in range(5):
        rows += [(f"Bob nomi {c}", c + 1, 100, {"font_size": 16.0, "bold": 1.0}), (f"Boʻlim nomi {c}", c + 1, 130, {"font_size": 11.0, "bold": 1.0}), ("Oddiy matn. " * 30, c + 1, 160, {"font_size": 11.0})]
    out = profile.style_profile(raw(spark, rows), heights(spark, 5)).select("role", "rank", profile.describe(F.col("style")).alias("d")).collect()
    assert {(r.role, r["rank"], r.d) for r in out} == {("body", None, "? 11 regular"), ("heading", 1, "? 16 bold"), ("heading", 2, "? 11 bold")}


@pytest.mark.parametrize("rows, want", [([["A", "B"], ["C", "D"]], 1.0), ([["birlashgan", ")"], ["C", "D"]], 0.0), ([["A", ""], ["C", "D"]], 0.25), ([], -1.0)])
def test_table_score(spark, rows, want):
    df = spark.createDataFrame([(rows,)], f"rows {S.ROWS}")
    assert df.select(tables.table_score(F.col("rows"))).first()[0] == pytest.approx(want)


def blocks(spark, rows):
    made = [{"document_id": d, "pos": i, "type": k, "text": t, "page": 1, "role": role, "title": False, "language": (lang, script, 0.9)} for i, (d, k, t, role, lang, script) in enumerate(rows)]
    return spark.createDataFrame(made, S.BLOCKS)


def test_documents_vote_by_length(spark):
    rows = [("a", "paragraph", "x" * 900, None, "uz", "latin"), ("a", "paragraph", "x" * 100, None, "ru", "cyrillic"), ("a", "footnote", "x" * 999, None, "ru", "cyrillic"), ("b", "paragraph", "x" * 300, None, "unknown", "latin"), ("b", "paragraph", "x" * 100, None, "uz", "latin"), ("c", "image", "[image]", "image", "unknown", "none")]
    out = {r.document_id: r for r in documents.assemble(blocks(spark, rows)).collect()}
    assert tuple(out["a"].language) == ("uz", "latin", 0.9) and tuple(out["b"].language) == ("unknown", "latin", 0.0)
    assert [w.code for w in out["b"].warnings] == ["language_uncertain"] and [w.code for w in out["c"].warnings] == ["pictures_not_read", "little_or_no_text"]
