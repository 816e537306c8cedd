"""Text functions: input and expectation, in Python and as columns."""

import pytest
from pyspark.sql import functions as F

from blockloom.functions import hyphens, language, lexicon, normalize, numbering, scripts, sentences, symbols, tokens

CLEAN = {
    "O'zbekiston": "Oʻzbekiston", "ma’lumot": "maʼlumot", "'hello' world": "'hello' world", "O‘.Haydarov": "Oʻ.Haydarov",
    "Статья 5 ........ 12": "Статья 5 … 12", "Раздел 1 . . . . . 3": "Раздел 1 … 3", "Продолжение...": "Продолжение...",
    "a \n\n\n\nb": "a\n\nb", "■Always put": "■ Always put", "й": "й", "the user’s funds": "the user’s funds",
    "vаlyutа bozori": "valyuta bozori", "MUNDАRIJА": "MUNDARIJA", "II-BОB": "II-BOB", "Пoлитика бaнка": "Политика банка", "bankиш": "bankиш",
    "a  b  c": "a + b = c",
}
HYPHENS = {
    "Настоя-\nщим документом": "Настоящим документом", "орга-\nниза-\nция труда": "организация труда", "кто-\nто": "кто-то", "из-\nза": "из-за",
    "северо-\nзападный": "северо-западный", "по-\nрусски": "по-русски", "по-\nлитика": "политика", "BMT-\nning": "BMT-ning",
    "Москва-\nГород": "Москва-\nГород", "пункт 1-\n2": "пункт 1-\n2", "1978- yillarda": "1978- yillarda", "audio- yoki video": "audio- yoki video", "boshqa- rish": "boshqarish",
}
NUMBERS = {
    "1. ОБЩИЕ ПОЛОЖЕНИЯ": ("decimal", 1), "1.1. Предмет": ("decimal", 2), "2.3.4 Asosiy": ("decimal", 3), "5.3.Title": ("decimal", 2), "5.3 . Title": ("decimal", 2),
    "2024. Год": None, "5 штук": None, "1.": None, "12.05.2020 yil": None, "1.25 foiz": None, "1.5кг": None, "IV. UMUMIY": ("decimal", 1), "Х. Хайдаров": None,
    "Статья 5.": ("keyword", 4), "1-modda.": ("keyword", 4), "§ 2. Nom": ("keyword", 3), "12-bob.": ("keyword", 2), "10¹-modda.": ("keyword", 4), "I BOʻLIM.": ("keyword", 1),
    "II-jahon urushi": None, "5-moddasi boʻyicha": None, "• пункт": ("bullet", 1), "■Always": ("bullet", 1), "-5 daraja": None, "*args": None, "1) a": ("ordered", 1),
    "а) б": ("ordered", 1), "(2) x": ("ordered", 1), "Ikkinchi qism": ("keyword", 1), "3-қисм.": ("keyword", 1), "ЧАСТЬ ПЕРВАЯ": ("keyword", 1), "": None,
}
LATIN = {"Ўзбекистон": "o'zbekiston", "ер": "yer", "цирк": "sirk", "конституция": "konstitutsiya", "съезд": "s'yezd", "компьютер": "kompyuter"}


@pytest.mark.parametrize("text, want", CLEAN.items())
def test_clean(text, want):
    assert normalize.clean(text)[0] == want


def test_clean_counts_and_knows_words():
    assert normalize.clean("Пoлитика бaнка  ")[1:] == (2, 1, 1)
    words = lexicon.Lexicon(lexicon.Language(frozenset({"ta'm"}), ("lar",)))
    assert normalize.clean("ta’m", words)[0] == "taʼm" and normalize.clean("ta’m")[0] == "ta’m"
    assert not words.knows("Kitob") and lexicon.Lexicon(lexicon.Language(frozenset({"kitob"}), ("lar",))).knows("Kitoblar")


@pytest.mark.parametrize("text, want", HYPHENS.items())
def test_hyphens(text, want):
    assert hyphens.repair(text) == want


def test_compounds():
    assert hyphens.repair("pul-\nkredit", {"pul-kredit"}) == "pul-kredit"
    assert hyphens.compounds(["qoʻllab-quvvatlash va oltin-valyuta-kredit"]) == {"qoʻllab-quvvatlash", "oltin-valyuta", "valyuta-kredit"}


@pytest.mark.parametrize("text, want", NUMBERS.items())
def test_numbering(text, want):
    assert numbering.numbering(text) == want


@pytest.mark.parametrize(
    "text, n",
    [("Георгий Иванов. На грани…", 2), ("И т. д. и т. п. В общем, да", 2), ("IV. Гестационный диабет", 1), ("2021 y. dekabr oyida qilindi. Qonun kuchga kirdi.", 2), ("Sh. Mirziyoyev keldi", 1), ("без точки", 1), ("  ", 0)],
)
def test_sentences(text, n):
    assert len(sentences.split(text)) == n


@pytest.mark.parametrize("a, b, want", [("Договор заключён.", "Стороны", True), ("со ст.", "5 Закона", False), ("4.", "Я присутствовал", False), ("сказал он.»", "Затем", True)])
def test_breaks(a, b, want):
    assert sentences.breaks(a, b) is want


def test_languages():
    ru = "Настоящий договор регулирует отношения между сторонами и является обязательным."
    uz = "Ушбу қоидалар банк хизматларини кўрсатиш тартибини белгилайди."
    assert language.detect(ru)[:2] == ("ru", "cyrillic") and language.detect(uz)[:2] == ("uz", "cyrillic")
    assert language.detect("Ushbu qoidalar bank xizmatlarini koʻrsatish tartibini belgilaydi.")[:2] == ("uz", "latin")
    assert language.detect(f"{ru} {uz}").language == "mixed" and language.detect("12345 ---") == language.UNKNOWN
    assert language.detect("The quick brown fox jumps over the lazy dog.").language == "unknown"
    assert language.locale("uz", "latin") == "uz-Latn" and language.locale("unknown", "latin") is None


def test_symbols():
    assert symbols.map_symbol_font("", "ABCDEF+Symbol") == ("αβ", 2, 0)
    assert symbols.map_symbol_font(" x", "Wingdings") == ("• x", 1, 0) and symbols.map_symbol_font("", "Arial") == ("", 0, 0)


def test_columns_agree_with_python(spark):
    texts = [*NUMBERS, *LATIN, *CLEAN, "a  bb", "Настоящим документом", "pul-kredit oltin-valyuta-kredit"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select(
        "t", numbering.numbering_info(c).alias("n"), scripts.to_latin(c).alias("l"), tokens.estimate_tokens(c).alias("k"), scripts.script_of(c).alias("s"),
        hyphens.compound_pairs(c).alias("p"), normalize.clean_text(c).alias("c"), hyphens.repair_hyphenation(c).alias("h"), sentences.split_sentences(c).alias("x"), language.detect_language(c).alias("d"),
    ).collect()
    for r in rows:
        assert (tuple(r.n) if r.n else None) == numbering.numbering(r.t), r.t
        assert r.k == tokens.estimate(r.t) and r.s == scripts.script(r.t) and r.l == scripts.latin(r.t)
        assert set(r.p) == hyphens.compounds([r.t]) and tuple(r.c) == normalize.clean(r.t)
        assert r.h == hyphens.repair(r.t, hyphens.compounds([r.t])) and r.x == sentences.split(r.t) and tuple(r.d)[:2] == language.detect(r.t)[:2]
    assert {t: scripts.latin(t) for t in LATIN} == LATIN
