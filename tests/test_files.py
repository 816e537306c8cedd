"""Files of any suffix through a backend made here: a PDF file is JSON of what a page shows."""

import io
import json
import zipfile

import pytest

from blockloom.operators import sheets
from blockloom.operators.chunking import ChunkOptions
from blockloom.operators.looks import Raw
from blockloom.operators.pages import Line
from blockloom.plans import files as plan

PROSE = "Ushbu nizom xodimlarning mehnat sharoitlarini va ularga beriladigan kafolatlarni belgilaydi"


def backend(data):
    got = json.loads(data)
    if got.get("locked"):
        raise PermissionError("ask the owner")
    for p in got["pages"]:
        if "image" in p:
            p["image"] = p["image"].encode()
    return got


def box(x0, y0, x1, y1):
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def span(text, y, x0=72, x1=500, size=11.0, font="Arial", block=0, line=None, path=None, superscript=False):
    return {"block": block, "line": int(y * 10 + x0 * 0.001) if line is None else line, "text": text, "bbox": box(x0, y, x1, y + 1.2 * size), "size": size, "font": font, "superscript": superscript, "path": path or []}


def page(number, *spans, **more):
    return {"number": number, "width": 595.0, "height": 842.0, "spans": list(spans), "drawings": [], "pictures": [], "grids": [], **more}


def prose(y, n=3, **more):
    return [span(f"{PROSE},", y + 14.2 * i, **more) for i in range(n - 1)] + [span("va amal qiladi.", y + 14.2 * (n - 1), x1=180, **more)]


def table_of(spark, **made):
    rows = [(name.replace("__", "."), bytearray(json.dumps(x).encode() if isinstance(x, dict) else x)) for name, x in made.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def blocks_of(parsed, document="a.pdf"):
    return [(r.type, r.text, r.level) for r in parsed.blocks.filter(f"document_id = '{document}'").orderBy("pos").collect()]


def test_a_plain_file_by_the_rules(spark):
    first = page(1, span("1-bob. Umumiy qoidalar", 100, x1=250, size=16.0, font="Arial-Bold", block=1), *prose(140, block=2), span("Izohli soʻz", 300, x1=140, block=3, line=9001), span("7", 299, x0=140, x1=144, size=6.0, superscript=True, block=3, line=9001), span("12", 815, x0=290, x1=300, block=8))
    second = page(2, span("2-bob. Maxsus qoidalar", 100, x1=250, size=16.0, font="Arial-Bold", block=1), *prose(140, block=2), span("13", 815, x0=290, x1=300, block=8))
    parsed = plan.parse(table_of(spark, a__pdf={"title": None, "outline": [], "pages": [first, second]}), plan.ReadOptions(backend))
    got = blocks_of(parsed)
    assert [(k, t) for k, t, n in got if k == "heading"] == [("heading", "1-bob. Umumiy qoidalar"), ("heading", "2-bob. Maxsus qoidalar")]
    assert not {"12", "13"} & {t for _, t, _ in got}  # page numbers are furniture
    refs = [r.footnote_refs for r in parsed.blocks.collect() if r.footnote_refs]
    assert refs == [["7"]]
    doc = parsed.documents().first()
    assert (doc.page_count, doc.needs_ocr, doc.source) == (2, False, "a.pdf") and {r.route for r in parsed.files.collect()} == {"rules"}
    chunks = parsed.chunks(ChunkOptions(200, 0)).orderBy("chunk_index").collect()
    assert [list(c.heading_path) for c in chunks] == [["1-bob. Umumiy qoidalar"], ["2-bob. Maxsus qoidalar"]]
    said = json.loads(plan.to_dict(parsed).first().json)
    assert len(said["blocks"]) == len(got) and [p["number"] for p in said["pages"]] == [1, 2]


def test_errors_are_rows_or_end_the_job(spark):
    files = table_of(spark, a__pdf=b"junk", b__pdf=b"", c__pdf={"locked": True}, d__txt=b"text", e__docx=b"junk", f__PDF={"title": None, "outline": [], "pages": [page(1, *prose(100))]})
    got = {r.path: r.error.code if r.error else r.route for r in plan.parse(files, plan.ReadOptions(backend)).files.collect()}
    assert got == {"a.pdf": "damaged", "b.pdf": "empty", "c.pdf": "locked", "d.txt": "unsupported", "e.docx": "damaged", "f.PDF": "rules"}
    assert {r.error.code for r in plan.parse(files.filter("path = 'f.PDF'")).files.collect()} == {"backend_missing"}
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        plan.parse(files.filter("path = 'a.pdf'"), plan.ReadOptions(backend, fail_fast=True))


def test_docx_goes_to_its_reader(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("Birinchi abzats shu yerda.", "Ikkinchi abzats.")) + "</w:body></w:document>")
    parsed = plan.parse(table_of(spark, x__DocX=out.getvalue()))
    assert [t for _, t, _ in blocks_of(parsed, "x.DocX")] == ["Birinchi abzats shu yerda.", "Ikkinchi abzats."] and parsed.files.first().route == "docx"
    assert parsed.documents().first().page_count == 1


def test_tables_with_rules_and_without(spark):
    ruled = {"bbox": box(70, 200, 500, 260), "rows": [["Nomi", "Soni"], ["Un", "5"], [None, "6"]], "spans": [{"row": 1, "col": 0, "rows": 2, "cols": 1}]}
    frame = {"bbox": box(70, 200, 500, 260), "stroked": True, "filled": False}
    loose = [span(t, 400 + 20 * r, x0=x, x1=x + 40, block=20 + r, line=100 * r + k) for r in range(3) for k, (t, x) in enumerate((("Nom", 72), ("12", 200), ("7,5", 330)))]
    spec = {"title": None, "outline": [], "pages": [page(1, *prose(100, block=1), span("Un", 210, x1=100, block=5), span("jadval ichida", 230, x1=160, block=5), *prose(300, block=6), *loose, drawings=[frame], grids=[ruled])]}
    parsed = plan.parse(table_of(spark, a__pdf=spec), plan.ReadOptions(backend))
    tables = [r for r in parsed.blocks.orderBy("pos").collect() if r.type == "table"]
    assert [[list(r) for r in t.rows] for t in tables] == [[["Nomi", "Soni"], ["Un", "5"], ["Un", "6"]], [["Nom", "12", "7,5"]] * 3]
    assert all("jadval ichida" not in r.text for r in parsed.blocks.collect())
    off = plan.parse(table_of(spark, a__pdf=spec), plan.ReadOptions(backend, detect_tables=False))
    assert off.blocks.filter("type = 'table'").count() == 0


def test_tags_are_used_where_they_can_be_trusted(spark):
    at = lambda *steps: [{"kind": k, "index": i} for k, i in steps]
    good = page(1, span("Kirish", 100, x1=200, block=1, path=at(("Sect", 0), ("H2", 0))), *prose(140, block=2, path=at(("Sect", 0), ("P", 1))), span("birinchi band", 250, x1=200, block=3, path=at(("L", 2), ("LI", 0))), span("ikkinchi band", 270, x1=200, block=4, path=at(("L", 2), ("LI", 1))))
    bad = page(1, span("Kirish", 100, x1=200, block=1, path=at(("H1", 0))), *prose(140, block=2), *prose(300, block=3))
    parsed = plan.parse(table_of(spark, a__pdf={"title": None, "outline": [], "pages": [good]}, b__pdf={"title": None, "outline": [], "pages": [bad]}), plan.ReadOptions(backend))
    assert {r.path: r.route for r in parsed.files.collect()} == {"a.pdf": "tags", "b.pdf": "rules: tags miss text"}
    assert [k for k, *_ in blocks_of(parsed)] == ["heading", "paragraph", "list"] and blocks_of(parsed)[2][1] == "birinchi band\nikkinchi band"


def test_a_model_looks_at_unsure_pages_only(spark):
    columns = [s for i in range(12) for s in (span(f"chap ustunda turgan matn qatori {i} boʻladi", 100 + 14.2 * i, x1=220, block=i, line=2 * i), span(f"oʻng ustunda turgan matn qatori {i} boʻladi", 100 + 14.2 * i, x0=320, x1=500, block=i, line=2 * i + 1))]
    sure, unsure = page(1, *prose(100, 5), image="sure"), page(2, *columns, image="unsure")

    def model():
        def look(image):
            assert image == b"unsure"
            return [("header", 0.9, (0.0, 90.0, 595.0, 113.0)), ("text", 0.9, (320.0, 110.0, 500.0, 300.0)), ("text", 0.8, (72.0, 110.0, 220.0, 300.0))]

        return look

    files = table_of(spark, a__pdf={"title": None, "outline": [], "pages": [sure, unsure]})
    plain, seen = (plan.parse(files, plan.ReadOptions(backend, m)) for m in (None, model))
    rated = {r.page: (r.confidence < 0.6, tuple(r.issues)) for r in plain.pages.collect()}
    assert rated[1] == (False, ()) and rated[2] == (True, ("columns",))
    text = lambda p: " ".join(t for _, t, _ in blocks_of(p))
    assert "qatori 0 " in text(plain) and "qatori 0 " not in text(seen)  # the header region is furniture
    left, right = (text(seen).index(f"{w} ustunda turgan matn qatori 11") for w in ("chap", "oʻng"))
    assert left < text(seen).index("oʻng ustunda turgan matn qatori 1 ") and left < right


def test_scans_are_said(spark):
    parsed = plan.parse(table_of(spark, a__pdf={"title": None, "outline": [], "pages": [page(1, *prose(100)), page(2, span("tamgʻa", 700, x1=120), pictures=[box(0, 0, 595, 842)])]}), plan.ReadOptions(backend))
    assert {r.page: (r.needs_ocr, r.confidence, tuple(r.issues)) for r in parsed.pages.collect()}[2] == (True, 0.0, ("no_text",))
    doc = parsed.documents().first()
    assert doc.needs_ocr and [(w.code, w.pages) for w in doc.warnings if w.code == "no_text_layer"] == [("no_text_layer", [2])]


def row(text, page=1, role=None, size=11.0):
    return {"text": text, "page": page, "role": role, "font_size": size}


@pytest.mark.parametrize(
    "given, blocks, want",
    [
        ("Mehnat nizomi", [row("MEHNAT NIZOMI"), row(PROSE)], "Mehnat nizomi"),
        ("Yangi mehnat nizomi", [row("Mehnat haqida"), row("yangi"), row("nizomi")], "Yangi mehnat nizomi"),
        ("Document1", [row(PROSE)], None),
        ("Document1", [row("KATTA NOM", role="title_page", size=20.0), row("muallif", role="title_page"), row("davomi", role="title_page", size=18.0)], "KATTA NOM davomi"),
        ("Katta nom va davomi", [row("KATTA NOM", role="title_page", size=20.0), row("katta nom va davomi")], "Katta nom va davomi"),
        (None, [], None),
    ],
)
def test_titles(given, blocks, want):
    assert sheets.document_title(given, blocks) == want


def test_text_grids_and_places():
    line = lambda t, y, x: Line(t, (x, y, x + 40, y + 12), 11.0, chars=len(t))
    assert sheets.text_grid([line("b", 100, 200), line("a", 101, 72), line("c", 130, 72)], (60, 90, 400, 150)) == [["a", "b"], ["c", ""]]
    assert sheets.grid_score([["A", "B"], ["C", "D"]]) == 1.0 and sheets.grid_score([]) == -1.0
    units = [(("P", 1), Raw("bir", bbox=(0, 100, 9, 110))), (("P", 2), Raw("uch", bbox=(0, 300, 9, 310)))]
    assert [b.text for _, b in sheets.beside(units, [Raw("ikki", bbox=(0, 200, 9, 210)), Raw("toʻrt", bbox=(0, 400, 9, 410))])] == ["bir", "ikki", "uch", "toʻrt"]
