"""Options and word lists. The lists are fixed values: results depend on them as they stand."""

from __future__ import annotations

# Heading words with their rank, largest unit first.
HEADING_KEYWORDS = {
    "qism": 1, "boʻlim": 1, "mavzu": 1, "ilova": 1, "bob": 2, "modda": 4,
    "қисм": 1, "бўлим": 1, "мавзу": 1, "илова": 1, "боб": 2, "модда": 4,
    "часть": 1, "раздел": 1, "тема": 1, "приложение": 1, "глава": 2, "параграф": 3, "статья": 4,
    "part": 1, "chapter": 2,
}
# Titles of a table of contents, words that announce a plan, words that can't end a title.
TOC_TITLES = ("mundarija", "mundarijasi", "tarkib", "мундарижа", "оглавление", "содержание", "contents", "table of contents")
PLAN_WORDS = ("reja", "режа", "план")
JOINING_WORDS = frozenset("va hamda yoki bilan uchun ва ҳамда ёки билан учун и или в во на по для с со о об к от из and or of the for in on to with".split())
# Words of appendices, of approval stamps, and titles that name no document.
APPENDIX_WORDS = ("ilova", "илова", "приложение", "appendix", "annex")
APPROVAL_WORDS = ("утвержден", "утверждена", "утверждено", "утверждены", "утверждаю", "tasdiqlangan", "tasdiqlayman", "тасдиқланган", "тасдиқлайман", "approved")
PLACEHOLDER_TITLES = ("untitled", "document", "документ", "hujjat", "title", "заголовок", "sarlavha")
