"""Normalisation of citation text as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# ---- fixed values: character maps of the two engines (they differ on purpose) ----
DOCUMENT_MAP = {"（": "(", "）": ")", "＆": "&", "’": "'", "‘": "'", "‐": "-", "‑": "-", "–": "-", "—": "-", "，": ",", "‚": ",", "¸": ",", "､": ",", "。": "."}
START_MAP = {"（": "(", "）": ")", "，": ",", "．": ".", "。": ".", "：": ":", "；": ";", "－": "-", "–": "-", "—": "-", "‒": "-", "―": "-", "　": " "}
PARSE_MAP = {"（": "(", "）": ")", "．": ".", "。": ".", "，": ",", "　": " "}
SAFE_MAP = {"（": "(", "）": ")", "，": ",", "。": ".", "：": ":", "；": ";", "－": "-", "–": "-", "—": "-"}
SEGMENT_MAP = {"（": "(", "）": ")", "，": ",", "；": ";", "。": ".", "－": "-", "–": "-", "—": "-", "　": " "}
SERVICE_MAP = {"。": ".", "、": ",", "；": ";", "：": ":", "–": "-", "—": "-", "－": "-"}
LETTER = "A-Za-zÀ-ÿ"
HAN = "一-鿿"
ENGLISH_LEADS = ["as ", "see ", "in ", "by ", "cf ", "and "]
CHINESE_LEADS = ["參考", "根據", "由", "如", "見", "以", "採用", "使用", "利用", "與", "及"]
PREVIEW = 120
CONTEXT = 50
SHORT_NAME, ALIKE = 4, 0.75
PLAIN_TEXT = r"^[!-~]++(?: [!-~]++)*+\z"
# ---- end of fixed values ----


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def bound(c: Column, body) -> Column:
    """body(c) with c made once; filters and lambdas would otherwise repeat it for each of its uses."""
    return F.transform(F.array(c), body)[0]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|(?! )\s", " "))


@cache
def _wide() -> tuple[str, str]:
    """Full-width ASCII and the ideographic blank, by the rule of their code points."""
    return "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)) + "　", "".join(map(chr, range(0x21, 0x7F))) + " "


def narrow(c: Column) -> Column:
    return F.translate(c, *_wide())


@F.pandas_udf(StringType())
def exact_forms(s: pd.Series) -> pd.Series:
    """Compatibility composition over the Unicode tables; no built-in has them."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column, exact: bool = False) -> Column:
    """Compatibility composition; natively for full-width forms only."""
    return exact_forms(c) if exact else narrow(c)


@cache
def _accents() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(cp):
            src.append(chr(cp))
            dst.append(plain)
    return "".join(src), "".join(dst)


def fold_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), *_accents())


def norm_core(c: Column) -> Column:
    """TXT1: controls and zero-width signs go, punctuation narrows, white space becomes one blank. Printable ASCII with
    single blanks inside is so already and skips the work."""
    return bound(c, lambda t: F.when(t.rlike(PLAIN_TEXT), t).otherwise(_norm_core(t)))


def _norm_core(c: Column) -> Column:
    return squeeze(mapped(F.regexp_replace(c, "[​‎‏\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), DOCUMENT_MAP))


def _lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def norm_service(c: Column, exact: bool = True) -> Column:
    """TXT2: compatibility forms, own punctuation, line breaks kept."""
    text = mapped(nfkc(F.coalesce(c, F.lit("")), exact), SERVICE_MAP)
    return F.array_join(F.transform(_lines(text), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " "))), "\n")


def norm_safe(c: Column) -> Column:
    """TXT3: spaces around punctuation within lines, runs of blank lines to one."""

    def tidy(x: Column) -> Column:
        for pattern, to in ((r"(?U)\s+([,.;:])", "$1"), (r"(?U)\(\s+", "("), (r"(?U)\s+\)", ")"), (r"(?U)([,.;:])\s+", "$1 ")):
            x = F.regexp_replace(x, pattern, to)
        return squeeze(x)

    lines = F.transform(_lines(mapped(F.coalesce(c, F.lit("")), SAFE_MAP)), lambda x: tidy(squeeze(x)))
    kept = F.transform(F.array(lines), lambda a: F.filter(a, lambda x, i: (x != "") | (i == 0) | (F.get(a, i - 1) != "")))[0]
    return F.array_join(kept, "\n")


def norm_reference(c: Column) -> Column:
    """TXT4."""
    x = squeeze(F.coalesce(c, F.lit("")))
    for pattern, to in ((r"\s+,", ","), (r",\s*", ", "), (r"\s+\.", "."), (r"(?<=\d)\s*[-–—]\s*(?=\d)", "–")):
        x = F.regexp_replace(x, pattern, to)
    return squeeze(x)


def norm_segment(c: Column) -> Column:
    """TXT6."""
    return squeeze(mapped(nfkc(F.coalesce(c, F.lit(""))), SEGMENT_MAP))


def surname_key(c: Column) -> Column:
    """TXT8: an English family name as a key."""
    x = F.substring_index(c, ",", 1)
    x = F.regexp_replace(x, rf"(?U)\s+[{LETTER}]\.", "")
    x = F.regexp_replace(x, rf"(?U)\s+[{LETTER}]$", "")
    x = F.regexp_replace(x, "([a-z])[A-Z]{1,3}$", "$1")
    return squeeze(F.replace(F.lower(fold_accents(x)), F.lit("."), F.lit("")))


def han_key(c: Column) -> Column:
    """TXT9."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def year_key(c: Column) -> Column:
    """TXT10: the year token as a key; a closing letter counts as suffix, after words only behind a blank or hyphen."""

    def made(y: Column) -> Column:
        base = (
            F.when(y.contains("n.d") | y.contains("no date"), F.lit("n.d."))
            .when(y.contains("press") | y.contains("印刷") | y.contains("未刊"), F.lit("in press"))
            .otherwise(bound(F.regexp_extract(y, r"([12]\d{3})", 1), lambda d: F.when(d != "", d).otherwise(y)))
        )
        return bound(base, lambda b: F.concat(b, F.when(b.rlike(r"\d$"), F.regexp_extract(y, "([a-z])$", 1)).otherwise(F.regexp_extract(y, "[- ]([a-z])$", 1))))

    return bound(F.lower(F.trim(c)), made)


def person_key(c: Column) -> Column:
    """TXT11: letters, digits and Han only; accented letters go."""
    return F.regexp_replace(narrow(F.lower(F.trim(F.coalesce(c, F.lit(""))))), f"[^a-z0-9{HAN}]+", "")


def loosen_years(c: Column) -> Column:
    """TXT12."""
    return F.regexp_replace(c, r"([a-zA-Z,，.])([12]\d{3})", "$1 $2")


def around(c: Column, start: Column, end: Column, window: int = CONTEXT) -> Column:
    """TXT13: text between start and end (from 0) with a window on both sides."""
    a = F.greatest(start - window, F.lit(0))
    return F.concat(F.lit("..."), c.substr(a + 1, F.least(end + window, F.char_length(c)) - a), F.lit("..."))


def find_highlight(page: Column, needle: Column) -> Column:
    """TXT14: place (from 1) of the first of a ladder of shorter forms; 0 if none is there."""
    n = F.replace(needle, F.lit("..."), F.lit(""))
    hit = lambda x: F.nullif(F.when(F.char_length(x) > 0, F.position(x, page)).otherwise(F.lit(0)), F.lit(0))
    bare = F.regexp_replace(n, "[()]", "")
    long = F.coalesce(hit(F.left(n, F.lit(30))), hit(F.left(n, F.lit(15))))
    short = F.coalesce(hit(bare), hit(F.replace(bare, F.lit(","), F.lit(""))))
    return F.coalesce(hit(n), F.when(F.char_length(n) > 30, long).otherwise(short), F.lit(0))


def strip_han_lead(c: Column) -> Column:
    """TXT15."""
    out = c
    for lead in reversed(CHINESE_LEADS):
        out = F.when(c.startswith(lead) & (F.char_length(c) > len(lead) + 1), c.substr(F.lit(len(lead) + 1), F.char_length(c))).otherwise(out)
    return out


def strip_english_lead(c: Column) -> Column:
    """TXT16."""
    return F.trim(F.regexp_replace(c, "(?i)^(?:" + "|".join(ENGLISH_LEADS) + ")", ""))


def preview(c: Column, limit: int = PREVIEW) -> Column:
    """TXT17."""
    x = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("..."))).otherwise(x)


def _folded(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower()


@F.pandas_udf(BooleanType())
def similar_names(a: pd.Series, b: pd.Series) -> pd.Series:
    """TXT19: gestalt ratio of folded names; short ones must be equal. No built-in has this ratio."""
    from difflib import SequenceMatcher

    def one(s: str | None, t: str | None) -> bool:
        if not s or not t:
            return False
        if min(len(s), len(t)) <= SHORT_NAME:
            return s.lower() == t.lower()
        return SequenceMatcher(None, _folded(s), _folded(t)).ratio() >= ALIKE

    return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)])


def similar(a: Column, b: Column) -> Column:
    return similar_names(a, b)


def has_letter(c: Column) -> Column:
    """TXT20."""
    return c.rlike(f"[{LETTER}]")


def first_han(c: Column) -> Column:
    return F.regexp_extract(c, f"[{HAN}]", 0)


def open_parens(c: Column) -> Column:
    """TXT21."""
    return F.char_length(F.regexp_replace(c, "[^(（]", "")) - F.char_length(F.regexp_replace(c, "[^)）]", ""))


def put_year(text: Column, year: Column, suffix: Column) -> Column:
    """TXT22: the first year in parentheses, else the first bare one, as (year suffix)."""
    done = F.concat(F.lit("("), year, F.lower(F.coalesce(suffix, F.lit(""))), F.lit(")"))
    paren = F.concat(F.lit(r"(?is)^(.*?)\(\s*"), year, F.lit(r"\s*[a-z]?\s*\)(.*)$"))
    bare = F.concat(F.lit(r"(?is)^(.*?)\b"), year, F.lit(r"[a-z]?\b(.*)$"))
    to = F.concat(F.lit("$1"), done, F.lit("$2"))
    return F.when(F.regexp_like(text, paren), F.regexp_replace(text, paren, to)).when(F.regexp_like(text, bare), F.regexp_replace(text, bare, to)).otherwise(text)


def heading_key(c: Column) -> Column:
    """TXT23: a heading without blanks, full stops and colons, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[ .:：]", "")


def boundary_key(c: Column) -> Column:
    """TXT24: a text for comparing boundaries: compatibility forms, lower case, single blanks."""
    return squeeze(F.lower(nfkc(F.coalesce(c, F.lit("")))))


def broken_lines(c: Column, every: int = 6) -> Column:
    """GEN1: a line break instead of the blank behind each so many words."""
    return F.array_join(F.transform(F.split(c, " "), lambda w, i: F.when(i == 0, w).when(i % every == 0, F.concat(F.lit("\n"), w)).otherwise(F.concat(F.lit(" "), w))), "")


def without_blank_lines(c: Column) -> Column:
    """GEN1: runs of line breaks as one."""
    return F.regexp_replace(c, r"\n\s*\n", "\n")
