"""Citations and references as structured columns: extraction (EXT6 to EXT10), parsing (PRS1 to PRS9) and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CITED_YEAR, YEAR, is_cited_segment, is_initials
from .text import HAN, LETTER, PARSE_MAP, fold_accents, han_key, has_letter, mapped, norm_core, norm_segment, person_key, squeeze, surname_key, year_key

# ---- fixed values: patterns of citations and years ----
BLOCK = r"[(（]([^()（）]{1,240})[)）]"
NARRATIVE = rf"(?iu)\b([A-Z][A-Za-z'’\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'’\-]+|\s+et\s+al\.)?)\s*[(（]\s*({CITED_YEAR})\s*[)）]"
NARRATIVE_HAN = rf"([{HAN}]{{1,10}})\s*[(（]\s*(\d{{4}})\s*[)）]"
YEAR_IN_CITATION = r"(?i)(?:(?:19|20)\d{2}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)"
YEAR_IN_PAREN = r"(?i)[(（]\s*((?:19|20)\d{2}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)\s*[)）]"
ANY_YEAR = r"(?i)\(\s*(?:19\d{2}|20\d{2})\s*[a-z]?\s*\)|\b(?:19\d{2}|20\d{2})[a-z]?\b"
#: ANY_YEAR without the years that stand bare; of one in full-width parentheses the digits alone, as there.
ENCLOSED_YEAR = r"(?i)\(\s*(?:19\d{2}|20\d{2})\s*[a-z]?\s*\)|(?<=（)(?:19\d{2}|20\d{2})[a-z]?(?=）)"
DOTTED_YEAR = rf"(?:^|[.\s])({YEAR})\."
CORE_YEARS = [rf"\(({YEAR}(?:[- ]?[a-zA-Z])?)\)", r"\(([^)]*(?:19|20)\d{2}[^)]*)\)", rf"[,，\s]\s*({YEAR})\s*[,，.]", DOTTED_YEAR]
#: The forms of CORE_YEARS in parentheses, which come first.
ENCLOSED_FORMS = 2
# ---- end of fixed values ----


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def extract_citations(text: Column) -> Column:
    """EXT6: array of (raw, style), first of equal ones only, in the order parenthetical, narrative, Chinese narrative."""
    t = F.coalesce(text, F.lit(""))
    made = lambda style: lambda x: F.struct(x.alias("raw"), F.lit(style).alias("style"))
    segments = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(BLOCK), F.lit(1)), lambda b: F.split(b, "[;；]")))
    paren = F.transform(F.filter(F.transform(segments, norm_segment), is_cited_segment), made("parenthetical"))

    def told(pattern: str, style: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("y"))
        return F.transform(pairs, lambda p: F.struct(F.concat(F.trim(p["a"]), F.lit(" ("), F.trim(p["y"]), F.lit(")")).alias("raw"), F.lit(style).alias("style")))

    found = F.concat(paren, told(NARRATIVE, "narrative"), told(NARRATIVE_HAN, "narrative_zh"))
    key = lambda x: F.lower(squeeze(x["raw"]))
    return _let(found, lambda a: _let(F.transform(a, key), lambda k: F.filter(a, lambda x, i: (key(x) != "") & (F.array_position(k, F.get(k, i)) == i + 1))))


def _year_struct(token: Column) -> Column:
    """(year, year_suffix, year_token_type) of one token; null or empty is missing."""
    low = F.lower(F.coalesce(token, F.lit("")))
    digits = F.regexp_extract(low, r"((?:19|20)\d{2})", 1)
    kind = F.when(digits != "", "year").when(low.startswith("n"), "n.d.").when(low.startswith("in"), "in_press").otherwise("missing")
    return F.struct(
        F.when(digits != "", digits.cast("int")).alias("year"),
        F.nullif(F.regexp_extract(low, r"\d{4}([a-z])", 1), F.lit("")).alias("year_suffix"),
        kind.alias("year_token_type"),
    )


def citation_year(text: Column) -> Column:
    """EXT7: the last token counts."""
    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR_IN_CITATION), F.lit(0)), lambda a: _year_struct(F.get(a, F.size(a) - 1)))


def citation_authors(text: Column) -> Column:
    """EXT8."""
    t = F.trim(text)
    got = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit(""))
    before = F.regexp_extract(t, rf"(?s)^(.*?){YEAR_IN_CITATION}", 1)
    rest = F.when(t.rlike(YEAR_IN_CITATION), F.regexp_replace(before, r"^[ ,，(]+|[ ,，(]+$", "")).otherwise(t)
    return F.coalesce(got(rf"(?i)^\s*(.+?)\s*[(（]\s*{CITED_YEAR}\s*[)）]\s*$"), got(rf"(?i)^\s*(.+?)\s*[,，]\s*{CITED_YEAR}\s*$"), rest)


def citation_surname(authors: Column) -> Column:
    """EXT9."""
    a = squeeze(authors)
    han = F.regexp_extract(a, f"^([{HAN}]{{1,20}})", 1)
    first = F.regexp_replace(a, r"(?i)\bet\s+al\.\s*$", "")
    first = F.regexp_replace(F.trim(first), r"(?i)\s+(?:and|&)\s+.*$", "")
    first = F.trim(F.regexp_replace(F.regexp_replace(first, "[,，].*$", ""), rf"[^A-Za-z0-9'’\-\s{HAN}]", ""))
    return F.nullif(F.when(han != "", han).otherwise(first), F.lit(""))


def parse_citation(raw: Column) -> Column:
    """EXT10."""
    t = mapped(F.trim(raw), PARSE_MAP)
    return _let(citation_year(t), lambda y: F.struct(citation_surname(citation_authors(t)).alias("surname"), y["year"].alias("year"), y["year_suffix"].alias("year_suffix"), y["year_token_type"].alias("year_token_type")))


def reference_authors(item: Column) -> Column:
    """PRS3: what stands before the year, else before the first full stop, else 120 characters."""
    t = F.trim(item)
    seen = mapped(t, PARSE_MAP)
    has = seen.rlike(YEAR_IN_PAREN)
    before = F.left(t, F.char_length(F.regexp_extract(seen, rf"(?s)^(.*?){YEAR_IN_PAREN}", 1)))
    dot = F.regexp_extract(t, r"(?s)^(.*?)[.。]", 1)
    return F.trim(F.when(has, before).when(t.rlike("[.。]"), dot).otherwise(F.left(t, F.lit(120))))


def reference_surname(item: Column, authors: Column) -> Column:
    """PRS4: (surname, confidence)."""
    han = F.trim(F.regexp_extract(item, rf"(?i)^\s*([{HAN}]{{1,20}})\s*[(（]\s*(?:19|20)\d{{2}}[a-z]?\s*[)）]", 1))
    a = F.regexp_replace(squeeze(authors), "^[,，;；]+|[,，;；]+$", "")
    before = F.regexp_replace(squeeze(F.regexp_extract(a, "(?s)^(.*?)[,，]", 1)), "[.;:，, ]+$", "")
    name = F.when(han != "", han).when(a == "", F.lit(None)).when(a.rlike("[,，]"), F.nullif(before, F.lit(""))).otherwise(squeeze(F.left(a, F.lit(40))))
    sure = (han != "") | ((a != "") & a.rlike("[,，]") & (before != ""))
    return F.struct(name.alias("surname"), F.when(sure, "high").otherwise("low").alias("confidence"))


def parse_reference(item: Column) -> Column:
    """PRS2 and PRS5."""
    t = F.trim(F.coalesce(item, F.lit("")))
    year = _year_struct(F.regexp_extract(mapped(t, PARSE_MAP), YEAR_IN_PAREN, 1))
    parts = F.struct(year.alias("y"), reference_surname(t, reference_authors(t)).alias("s"), reference_authors(t).alias("a"))
    return _let(parts, lambda p: F.struct(p["a"].alias("authors_raw"), p["s"]["surname"].alias("surname"), p["s"]["confidence"].alias("confidence"), p["y"]["year"].alias("year"), p["y"]["year_suffix"].alias("year_suffix"), p["y"]["year_token_type"].alias("year_token_type")))


def match_key(parsed: Column) -> Column:
    """KEY2, KEY3, KEY5: surname_year; null without a surname."""
    name = person_key(parsed["surname"])
    token = F.when(parsed["year"].isNotNull(), F.concat(parsed["year"].cast("string"), F.coalesce(parsed["year_suffix"], F.lit("")))).when(parsed["year_token_type"] == "n.d.", "nd").when(parsed["year_token_type"] == "in_press", "inpress").otherwise("missing")
    return F.when(name != "", F.concat(name, F.lit("_"), token))


def title_key(surname: Column, year: Column, suffix: Column, title: Column) -> Column:
    """KEY4: ASCII surname, year and the title's first letters."""
    ascii_ = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    token = F.concat(F.trim(F.coalesce(year, F.lit(""))), F.lower(F.coalesce(suffix, F.lit(""))))
    more = F.left(ascii_(title), F.lit(12))
    return F.when((ascii_(surname) == "") | (token == ""), F.lit("")).otherwise(F.concat(ascii_(surname), F.lit("_"), token, F.when(more != "", F.concat(F.lit("_"), more)).otherwise("")))


def parse_core(text: Column, bare_years: bool = True) -> Column:
    """PRS1: (lang, author1, author2, year, raw), null if no year is found or no author can be.

    The year is sought in four forms, the first that occurs counts; the authors stand before it. Without bare_years only
    the two forms in parentheses count: where a list numbers its volumes, "Journal 1999." is no year. The normalised text,
    the form and its parts are each computed once and bound.
    """

    def form(t: Column, i: int) -> Column:
        f = CORE_YEARS[i]
        pre = F.trim(F.regexp_extract(t, rf"^(.*?)(?:{f})", 1))
        bare = F.trim(F.regexp_replace(pre, r"\.$", "")) if f == DOTTED_YEAR else pre
        # no form has an empty year
        return _let(F.regexp_extract(t, f, 1), lambda y: F.when(y != "", F.struct(y.alias("year"), bare.alias("pre"), t.alias("raw"))))

    def built(p: Column) -> Column:
        pre, raw = p["pre"], p["raw"]
        lead = rf"^([{LETTER}][{LETTER}'\-\s.]*?),"
        one = lambda a1, a2: F.struct(a1.alias("a1"), a2.alias("a2"))
        second = F.nullif(F.trim(F.regexp_extract(pre, rf"(?:&|and)\s*([{LETTER}][{LETTER}'\-\s.]*?)(?:,|$)", 1)), F.lit(""))
        alt = F.nullif(F.trim(F.regexp_extract(pre, r"(?:&|and)\s*([A-Za-z][A-Za-z'\-\s.]*)", 1)), F.lit(""))
        short = _let(alt, lambda a: one(F.when(a.isNotNull(), F.trim(F.regexp_extract(pre, "^(.*?)(?:&|and)", 1))).otherwise(pre), a))
        latin = F.when(pre.rlike(lead), one(F.trim(F.regexp_extract(pre, lead, 1)), second)).when(F.char_length(pre) < 100, short)
        names = F.regexp_extract_all(F.regexp_replace(pre, "[與和及&]", " "), F.lit(f"[{HAN}]{{1,10}}"), F.lit(0))
        chinese = _let(names, lambda a: one(F.get(a, F.lit(0)), F.when(F.size(a) >= 2, F.element_at(a, -1))))
        english = has_letter(F.when(pre != "", pre).otherwise(F.left(raw, F.lit(20))))
        whole = lambda lang, n: F.when(n["a1"].isNotNull(), F.struct(F.lit(lang).alias("lang"), n["a1"].alias("author1"), n["a2"].alias("author2"), year_key(p["year"]).alias("year"), raw.alias("raw")))
        return F.when(english, _let(latin, lambda n: whole("en", n))).otherwise(_let(chinese, lambda n: whole("zh", n)))

    found = _let(norm_core(text), lambda t: F.coalesce(*[form(t, i) for i in range(len(CORE_YEARS) if bare_years else ENCLOSED_FORMS)]))
    return _let(found, lambda p: F.when(p.isNotNull(), built(p)))


def core_key(lang: Column, author: Column, year: Column) -> Column:
    """KEY1: (lang, author, year) as the join key."""
    return F.struct(lang.alias("lang"), F.when(lang == "en", surname_key(author)).otherwise(han_key(author)).alias("author"), year_key(year).alias("year"))


def split_year(text: Column, bare_years: bool = True) -> Column:
    """PRS6: (year, suffix, before, after) around the first year; null without one. Without bare_years only a year in
    parentheses counts."""
    form = ANY_YEAR if bare_years else ENCLOSED_YEAR
    token = F.regexp_extract(text, form, 0)
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?:{form})", 1)

    def built(p: Column) -> Column:
        low = F.lower(p["t"])
        after = text.substr(F.char_length(p["b"]) + F.char_length(p["t"]) + 1, F.char_length(text))
        return F.when(p["t"] != "", F.struct(F.regexp_extract(low, r"(\d{4})", 1).alias("year"), F.regexp_extract(low, r"\d{4}\s*([a-z])", 1).alias("suffix"), p["b"].alias("before"), after.alias("after")))

    return _let(F.struct(token.alias("t"), before.alias("b")), built)


def authors_list(raw: Column) -> Column:
    """PRS7: array of names, an initials token joined to the surname before it."""
    whole = F.regexp_replace(F.regexp_replace(F.trim(raw), "^,+|,+$", ""), r"(?i)\s+(?:and|&)\s+", " & ")
    parts = F.filter(F.transform(F.split(whole, " & "), lambda x: F.trim(x)), lambda x: x != "")

    def paired(part: Column) -> Column:
        tokens = F.filter(F.transform(F.split(part, ","), lambda x: F.trim(x)), lambda x: x != "")
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

        def step(acc: Column, x: Column) -> Column:
            bare = F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")
            joined = acc["open"] & is_initials(x)
            last = F.element_at(acc["out"], -1)
            head = F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
            added = F.when(bare != "", F.concat(acc["out"], F.array(bare))).otherwise(acc["out"])
            return F.struct(F.when(joined, F.concat(head, F.array(F.concat(last, F.lit(", "), F.trim(x))))).otherwise(added).alias("out"), F.when(joined, F.lit(False)).otherwise(bare != "").alias("open"))

        return F.when(F.size(tokens) > 0, F.aggregate(tokens, start, step)["out"]).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(parts, paired))


def author_surname(name: Column) -> Column:
    """PRS8."""
    return F.trim(F.regexp_replace(F.when(name.contains(","), F.substring_index(name, ",", 1)).otherwise(F.regexp_extract(F.trim(name), r"^(\S*)", 1)), r"[^A-Za-z0-9'\-\s]", ""))


def title_and_source(after: Column) -> Column:
    """PRS9: what follows the year, at its first full stop."""
    rest = F.trim(F.regexp_replace(F.trim(after), r"^\.", ""))
    at = F.position(F.lit("."), rest)
    title = F.when(at > 0, F.trim(F.left(rest, at - 1))).otherwise(rest)
    return F.struct(F.nullif(title, F.lit("")).alias("title"), F.when(at > 0, F.trim(rest.substr(at + 1, F.char_length(rest)))).otherwise(F.lit("")).alias("source"))


__all__ = ["authors_list", "core_key", "extract_citations", "fold_accents", "match_key", "parse_citation", "parse_core", "parse_reference", "split_year", "title_and_source", "title_key"]
