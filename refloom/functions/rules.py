"""Predicates over lines, names and tokens (FLT1 to FLT16) as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, LETTER, bound, norm_core, norm_segment

# ---- fixed values: headings, markers, word lists and token patterns ----
HEADINGS = ["參考文獻", "參考資料", "references", "reference", "bibliography"]
TAIL_HEADINGS = ["技術手冊、準則與報告", "technical manuals, standards and reports", "technical manuals, standards & reports"]
TAIL_PHRASES = ["產業樣本年度分析", "年度產業類別"]
BOILERPLATE = ["this content downloaded from", "all use subject to"]
NOT_AUTHOR_LEADS = ["table ", "figure ", "fig. ", "fig ", "model ", "equation ", "eq. ", "eq ", "chapter ", "section ", "appendix ", "panel ", "column ", "row ", "using "]
NOT_AUTHOR_HINTS = ["table", "figure", "fig", "model", "equation", "eq", "chapter", "section", "using", "after", "before", "than"]
SPECIAL_YEARS = ["n.d", "no date", "in press", "印刷中", "未刊"]
YEAR = r"(?:[12]\d{3}|n\.?d\.?|no\s*date|in\s*press|印刷中|未刊)"
CITED_YEAR = r"(?:\d{4}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)"
PAREN_YEAR = rf"\({YEAR}(?:[- ]?[a-zA-Z])?\)"
PAREN_ANY_YEAR = r"\([^\)]*(?:19|20)\d{2}[^\)]*\)"
HAN_YEAR = rf"(?:[,，\s]|^)\s*{YEAR}\s*[,，.]"
DOT_YEAR = rf"[.\s]{YEAR}\."
NAME_INITIAL = rf"^[{LETTER}][{LETTER}'\-\s]+,\s+[{LETTER}]\."
GLUED = rf"^[A-Z][a-z]+[A-Z]{{1,3}}\({YEAR}\)"
MAX_TAIL_HEADING = 60
FULL_YEAR = r"(?:19|20)\d{2}"
NUMBERED_TABLE, APPENDIX = r"(?iU)^(?:表\s*[一二三四五六七八九十\d]+|table\s*[ivx\d]+)\b", r"(?iU)^(?:附錄|appendix)\b"
PUNCTUATED, PAGE_NUMBER = "[,()]", r"^\d{1,4}$"
NUMBERED_TITLE, TITLE_CASE = r"^\d+\s+[A-Za-z][A-Za-z\-\s.]{8,}$", r"^(?:[A-Z][A-Za-z'\-]+\s+){2,}[A-Z][A-Za-z'\-]+$"
NUMERIC_SIGNS, NUMBER, NUMBERING = "[=<>%±]", r"^[-+]?\d+(?:\.\d+)?$", r"^[-+]?\d+\.$"
OPEN_END, CLOSED_END, CLOSED_ITEM = r"(?i)(?:[,;:&\-]|\band)$", r"[.!?。！？]$", r"(?:[.。]|\.\)|\.”|\")$"
# ---- end of fixed values ----


def any_of(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def _core(c: Column, normal: bool) -> Column:
    """norm_core(c), unless c is that already."""
    return c if normal else norm_core(c)


def is_tail_heading(c: Column, normal: bool = False) -> Column:
    """FLT1."""
    t = _core(c, normal)
    marks = ["".join(ch for ch in m.lower() if ch.isalnum()) for m in TAIL_HEADINGS]
    return (t != "") & (F.char_length(t) <= MAX_TAIL_HEADING) & ~t.rlike(FULL_YEAR) & bound(_compact(t), lambda x: any_of(x, marks))


def is_tail_content(c: Column, normal: bool = False) -> Column:
    """FLT2."""
    t = _core(c, normal)
    return t.rlike(NUMBERED_TABLE) | t.rlike(APPENDIX) | any_of(t, TAIL_PHRASES)


def is_page_noise(c: Column, normal: bool = False) -> Column:
    """FLT3: page numbers, boilerplate, running titles."""
    t = _core(c, normal)
    plain = ~t.rlike(PUNCTUATED)
    return t.rlike(PAGE_NUMBER) | bound(F.lower(t), lambda x: any_of(x, BOILERPLATE)) | (t.rlike(NUMBERED_TITLE) & plain) | (t.rlike(TITLE_CASE) & plain & ~t.rlike(FULL_YEAR))


def is_author(c: Column) -> Column:
    """FLT4."""
    return (F.size(F.array_remove(F.split(c, r"(?U)\s+"), "")) <= 5) & c.rlike(r"\p{Lu}")


def is_not_author(c: Column) -> Column:
    """FLT5."""

    def test(t: Column) -> Column:
        leads = bound(F.lower(t), lambda low: F.exists(F.array(*map(F.lit, NOT_AUTHOR_LEADS)), lambda w: low.startswith(w)))
        return (t == "") | t.rlike(r"[=%/\\]") | leads | (t.rlike(r"\d") & any_of(F.lower(t), NOT_AUTHOR_HINTS))

    return bound(norm_core(F.coalesce(c, F.lit(""))), test)


def is_plausible_year(c: Column) -> Column:
    """FLT6."""
    digits = lambda y: F.regexp_extract(y, r"([12]\d{3})", 1)
    test = lambda y: (y != "") & (any_of(y, SPECIAL_YEARS) | bound(digits(y), lambda d: (d != "") & F.coalesce(F.try_to_number(d, F.lit("9999")).between(1800, 2100), F.lit(False))))
    return bound(F.lower(norm_core(F.coalesce(c, F.lit("")))), test)


def is_numeric_fragment(c: Column) -> Column:
    """FLT7."""
    test = lambda t: (t == "") | t.rlike(NUMERIC_SIGNS) | t.rlike(NUMBER) | t.rlike(NUMBERING) | (~t.rlike(f"[A-Za-z{HAN}]") & t.rlike(r"\d"))
    return bound(norm_core(F.coalesce(c, F.lit(""))), test)


def starts_with_connector(c: Column) -> Column:
    """FLT8."""
    return F.coalesce(c, F.lit("")).rlike(r"(?i)^\s*(?:and|&)\b")


def ends_open(c: Column) -> Column:
    """FLT11: an item's text that goes on."""
    t = F.trim(c)
    return t.rlike(OPEN_END) | ~t.rlike(CLOSED_END)


def starts_item(c: Column, bare_years: bool = True) -> Column:
    """FLT12: a line that begins a reference. Without bare_years a year outside parentheses does not tell one."""
    return bound(F.trim(c), lambda t: _begins(t, bare_years))


def _begins(t: Column, bare_years: bool) -> Column:
    bare = (t.rlike(f"^[{HAN}]") & t.rlike(HAN_YEAR)) | (t.rlike("^[A-Z]") & t.rlike(DOT_YEAR))
    enclosed = (
        (t.rlike(PAREN_YEAR) & t.rlike(f"^[A-Za-z{HAN}]"))
        | (t.rlike(PAREN_ANY_YEAR) & t.rlike("^[A-Za-z]"))
        | t.rlike(NAME_INITIAL)
        | t.rlike(GLUED)
    )
    return enclosed | bare if bare_years else enclosed


def must_append(current: Column, nxt: Column, bare_years: bool = True) -> Column:
    """FLT13: a line without a year goes on an item that has one and no closing punctuation."""
    return is_undated(nxt, bare_years) & is_open_item(current)


def is_undated(c: Column, bare_years: bool = True) -> Column:
    """FLT13, of the line: it has no year and begins no item by a name."""

    def test(b: Column) -> Column:
        no = (b != "") & ~b.rlike(NAME_INITIAL) & ~b.rlike(PAREN_YEAR) & ~b.rlike(PAREN_ANY_YEAR)
        return no & ~(b.rlike(f"^[{HAN}]") & b.rlike(HAN_YEAR)) if bare_years else no

    return bound(norm_core(c), test)


def is_open_item(c: Column) -> Column:
    """FLT13, of the item: it has a year and no closing punctuation."""
    return bound(norm_core(c), lambda a: (a != "") & ~a.rlike(CLOSED_ITEM) & a.rlike(PAREN_YEAR))


def is_initials(c: Column) -> Column:
    """FLT14."""
    return F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")).rlike(r"(?i)^(?:[A-Z]\.)+$")


def is_cited_segment(c: Column) -> Column:
    """FLT15: names, a comma, a year, maybe pages."""
    return norm_segment(c).rlike(rf"(?i)^.+?[,，]\s*{CITED_YEAR}(?:\s*[,，]\s*(?:p|pp)\.?\s*\d+(?:\s*[-–—]\s*\d+)?)?\s*$")


def error_code(message: Column) -> Column:
    """FLT16 and ERR1: the code of a failure by its message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    missing = any_of(low, ["reference section", "references section", "參考文獻", "bibliography", "no reference"])
    return F.when(missing, "REFERENCE_SECTION_NOT_FOUND").when(low.contains("timeout"), "CONVERSION_TIMEOUT").when(low.contains("convert"), "CONVERSION_ERROR").when(low.contains("preview"), "PREVIEW_ERROR").otherwise("PARSE_ERROR")
