"""Splitting pasted bibliographies into items (SEG8 to SEG10) as columns.

A paste is one row, its blocks and lines are arrays, and every test on a line is a pattern. What belongs together are
islands: parts from one that begins something up to the next that does. So wrapped lines, false cuts and cuts that need a
certain end before them are the same operation with another test. Only the places where references start inside a text
need an Arrow function, as the built-in regular expressions give no offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .text import START_MAP, norm_service, squeeze

# ---- fixed values: years, names and the parts of reference starts ----
YEAR_TOKEN = r"(?:19\d{2}[a-z]?|20\d{2}[a-z]?|n\s*\.\s*d\s*\.?|no\s+date|in\s+press|印刷中|未刊)"
IN_PARENS = rf"[(（]\s*{YEAR_TOKEN}\s*[)）]"
NUMBER_IN_PARENS = r"[(（]\s*(?:19\d{2}|20\d{2}[a-z]?)\s*[)）]"
CITED_IN_PARENS = r"[(（]\s*(?:\d{4}[a-z]?|n\s*[.。]\s*d\s*[.。]?|in\s+press)\s*[)）]"
SURNAME = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+"
INITIALS = r"[A-Z](?:\.[A-Z])*\."
PERSON = r"[A-Z][A-Za-z'’\-]+,\s*(?:[A-Z]\.\s*)+"
ITEM_NUMBER = r"(?:\d+\s+)?"
NOT_CONNECTOR = r"(?!\s*(?:and|&)\b)"
CHINESE_COMMA_YEAR = rf"{ITEM_NUMBER}[㐀-䶿一-鿿豈-﫿][㐀-䶿一-鿿豈-﫿、，,與和及·．\s]{{0,40}}[,，]\s*(?:19\d{{2}}|20\d{{2}}[a-z]?)\s*[,，]"
BARE_YEAR = rf"{ITEM_NUMBER}{SURNAME},\s*(?:{INITIALS}\s*)+[^()\n]{{0,180}}?\b(?:19\d{{2}}[a-z]?|20\d{{2}}[a-z]?)\."
NAMED_YEAR = rf"(?:[A-Z][A-Za-z'\-]+(?:\s+(?:[A-Z][A-Za-z'\-]+|[a-z]{{1,5}})){{0,3}}(?:,\s*{INITIALS})?|[一-鿿]{{1,20}})\s*{IN_PARENS}"
CHINESE_YEAR = rf"{ITEM_NUMBER}[一-鿿][一-鿿,，、與和及]{{1,40}}\s*{NUMBER_IN_PARENS}"
TWO_AUTHORS = rf"{ITEM_NUMBER}{SURNAME},\s*{INITIALS}(?:\s*(?:and|&)\s*{SURNAME},\s*{INITIALS})?\s*,?\s*{IN_PARENS}"
LONG_LIST = rf"{ITEM_NUMBER}{SURNAME}(?:\s+(?:[A-Z]\.\s*){{1,4}})?\s*,\s*[^()\n]{{0,220}}?{IN_PARENS}"
ANY_START = rf"{NOT_CONNECTOR}(?:{NAMED_YEAR}|{CHINESE_YEAR}|{CHINESE_COMMA_YEAR}|{TWO_AUTHORS}|{LONG_LIST}|{BARE_YEAR})"
LINE_START = rf"^{NOT_CONNECTOR}(?:{NAMED_YEAR}|{CHINESE_COMMA_YEAR}|{BARE_YEAR}|[A-Z一-鿿][^()\n]{{0,100}}{IN_PARENS})"
YEAR_SEEN = r"\b(?:19\d{2}[a-z]?|20\d{2}[a-z]?|no\s+date|in\s+press)\b|n\s*\.\s*d\s*\.?|印刷中|未刊"
AFTER_PUNCTUATION = [rf"(?<=[.;。；])\s+(?={ANY_START})", rf"(?<=[.;。；])(?={ANY_START})"]
AFTER_TAIL = [
    rf"{SURNAME},\s*(?:{INITIALS}\s*)+[^()\n]{{0,40}}[^()\n]{{0,220}}{IN_PARENS}",
    rf"[A-Z][A-Za-z&.\-']+(?:\s+[A-Z][A-Za-z&.\-']+){{1,8}}\s*(?:\([A-Za-z][^)\n]{{0,20}}\)\s*)?{NUMBER_IN_PARENS}",
]
TAIL = r"(?:\d{1,4}\s*[-–—]\s*\d{1,4}|\d{1,4}\s*[(（]\s*\d{1,4}\s*[)）]\s*\.?|\bMAJ\s+\d{1,3}\s*,\s*\d+\s+\d{1,4}|\.\s*No)\s*$"
LIST_GOES_ON = rf"^{SURNAME},\s*(?:(?:and|&)\s+(?:[A-Z]\.\s*){{0,4}}{SURNAME}|(?:[A-Z]\.\s*){{1,4}}{SURNAME}(?:,\s*(?:and|&)\s+(?:[A-Z]\.\s*){{0,4}}{SURNAME})?)"
LIST_IS_OPEN = r"(?:,\s*(?:[A-Z]\.\s*){1,4}|(?:[A-Z]\.\s*){2,4})$"
NAME_BEHIND_COMMA, SOMETHING_IN_PARENS = r",\s*[A-Za-z一-鿿]", r"[(（].*[)）]"
STARTS = [
    rf"{PERSON}(?:,\s*{PERSON})*(?:\s*(?:&|and)\s*{PERSON})?\s*{CITED_IN_PARENS}",
    rf"[A-Z][A-Za-z'’\-]+,\s*[^()]{{0,220}}?{CITED_IN_PARENS}",
    BARE_YEAR,
    r"[一-鿿]{1,20}\s*[(（]\s*\d{4}[a-z]?\s*[)）]",
    CHINESE_COMMA_YEAR,
]
MIN_GAP = 8
# ---- end of fixed values ----

#: Java's flags for what Python's patterns mean by themselves: any case, and Unicode classes.
ANY_CASE = "(?iU)"
MARK = "\x01"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast("array<string>")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def islands(parts: Column, begins: Callable[[Column, Column], Column], glue: str = " ") -> Column:
    """Parts joined, from each that begins an island up to the next; begins(part, the one before). The first does."""

    def join(a: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | F.coalesce(begins(F.get(a, i - 1), F.get(a, i - 2)), F.lit(False)))
        whole = lambda h: F.transform(h, lambda p, k: F.array_join(F.slice(a, p, F.coalesce(F.get(h, k + 1), F.size(a) + 1) - p), glue))
        return F.when(F.size(a) > 0, _let(heads, whole)).otherwise(_none())

    return _let(parts, join)


def starts_line(line: Column) -> Column:
    """FLT10: a line that looks like the beginning of a reference."""
    return line.rlike(ANY_CASE + LINE_START)


def has_year(line: Column) -> Column:
    return line.rlike(ANY_CASE + YEAR_SEEN)


def unwrapped(lines: Column) -> Column:
    """SEG8a: a line that begins no reference belongs to the one before."""
    return islands(lines, lambda line, _: starts_line(line))


def inline_parts(line: Column) -> Column:
    """SEG8b: parts of a line, cut behind punctuation and behind page numbers where a reference starts, unless what
    follows goes on with an author list that is open."""
    cut = lambda x, pattern: _filled(F.split(F.regexp_replace(x, ANY_CASE + pattern, MARK), MARK))

    def behind_tail(x: Column, pattern: str) -> Column:
        marked = F.regexp_replace(x, f"{ANY_CASE}({ITEM_NUMBER})({pattern})", f"$1{MARK}$2")
        return _filled(islands(F.split(marked, MARK), lambda _, before: before.rlike(ANY_CASE + TAIL), glue=""))

    def each(parts: Column, how, pattern: str) -> Column:
        return F.flatten(F.transform(parts, lambda x: how(x, pattern)))

    parts = F.array(line)
    for how, patterns in ((cut, AFTER_PUNCTUATION), (behind_tail, AFTER_TAIL)):
        for pattern in patterns:
            parts = each(parts, how, pattern)
    return islands(parts, lambda x, before: ~(x.rlike(ANY_CASE + LIST_GOES_ON) & before.rlike(LIST_IS_OPEN)))


def by_years(lines: Column) -> Column:
    """SEG8c: an item ends before a line with a year, or one that starts a reference, once it has a year itself. That is
    the one rule whose test depends on all that was joined, so it is a fold."""
    parts = F.flatten(F.transform(unwrapped(lines), inline_parts))
    begin = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("dated"))

    def step(acc: Column, x: Column) -> Column:
        def put(y: Column) -> Column:
            ends = acc["dated"] & (y | starts_line(x))
            return F.struct(
                F.when(ends, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
                F.when(ends, x).otherwise(F.concat_ws(" ", acc["open"], x)).alias("open"),
                F.when(ends, y).otherwise(acc["dated"] | y).alias("dated"),
            )

        return _let(has_year(x), put)

    return F.aggregate(parts, begin, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def block_items(block: Column) -> Column:
    """Items of one of several blocks: one where it has a year or is one wrapped reference, else its lines."""

    def of(lines: Column) -> Column:
        one = lambda w: (F.size(lines) > 1) & (F.size(w) == 1) & F.get(w, F.lit(0)).rlike(NAME_BEHIND_COMMA) & F.get(w, F.lit(0)).rlike(SOMETHING_IN_PARENS)
        return F.when(has_year(block), F.array(F.array_join(lines, " "))).otherwise(_let(unwrapped(lines), lambda w: F.when(one(w), w).otherwise(lines)))

    return _let(_filled(F.transform(F.split(block, "\n"), squeeze)), of)


def by_blocks(text: Column) -> Column:
    """SEG8: blank lines part the items where they make several blocks; else lines and years do. text: as norm_service
    leaves it, so blank lines are empty and other white space is single."""
    blocks = F.filter(F.split(text, "\n\n+"), lambda b: F.trim(b) != "")
    lines = lambda b: _filled(F.transform(F.split(b, "\n"), squeeze))
    return _let(blocks, lambda b: F.when(F.size(b) > 1, F.flatten(F.transform(b, block_items))).when(F.size(b) == 1, by_years(lines(F.get(b, F.lit(0))))).otherwise(_none()))


def start_places(text: str | None) -> list[int]:
    """SEG9: offsets at which references start: a start pattern matches, no connector stands there, and FLT9 holds: the
    place is the first, or behind a sentence, a URL, or a line that does not reach into the next. At least MIN_GAP apart."""
    seen = (text or "").translate(str.maketrans(START_MAP))
    found = {m.start() for p in _STARTS for m in p.finditer(seen)}
    places: list[int] = []
    for at in sorted(found):
        if (not places or at - places[-1] >= MIN_GAP) and not _CONNECTOR.match(seen, at, at + 24) and _BOUNDARY.search(seen, seen.rfind("\n", 0, max(seen.rfind("\n", 0, at), 0)) + 1, at):
            places.append(at)
    return places


_STARTS = [re.compile(p, re.I) for p in STARTS]
_CONNECTOR = re.compile(r"\s*(?:and|&)\b", re.I)
_BOUNDARY = re.compile(r"(?:\A|[.;!?]|https?://[^ \t\n]*|(?<!&)(?<!,)(?<!\band)\n)[ \t]*\Z", re.I)


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(texts: pd.Series) -> pd.Series:
    return texts.map(start_places)


def reference_starts(pasted: Column) -> Column:
    """Offsets in the normalised paste."""
    return _starts(norm_service(pasted))


def reference_items(pasted: Column) -> Column:
    """SEG10: what lies between starts, if that is more than blocks and lines give."""

    def choose(p: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(p["at"], k + 1), F.char_length(p["text"]))
        between = F.filter(F.transform(p["at"], lambda a, k: squeeze(p["text"].substr(a + 1, upto(k) - a))), lambda x: x != "")
        more = lambda q: F.when((F.size(q["between"]) >= 2) & (F.size(q["between"]) > F.size(q["plain"])), q["between"]).otherwise(q["plain"])
        return _let(F.struct(between.alias("between"), by_blocks(p["text"]).alias("plain")), more)

    t = norm_service(pasted)
    return _let(F.struct(t.alias("text"), _starts(t).alias("at")), choose)


def register(spark: SparkSession) -> None:
    """UDF0: functions by name for SQL; each is a SQL expression or an Arrow function behind it."""
    from .text import exact_forms, similar_names

    spark.udf.register("nfkc", exact_forms)
    spark.udf.register("similar_names", similar_names)
    spark.udf.register("reference_start_places", _starts)
