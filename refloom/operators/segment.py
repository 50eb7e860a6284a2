"""Finding, trimming, merging and splitting bibliographies (SEG1 to SEG7): windows and folds over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import HEADINGS, YEAR, any_of, is_open_item, is_page_noise, is_tail_content, is_tail_heading, is_undated, starts_item
from ..functions.text import HAN, bound, norm_core, open_parens

# ---- fixed values: where lines are cut, and how many may be joined ----
AFTER_PAGES = r"(\d{2,5}[-–]\d{2,5}[.．]?)"
BEFORE_HAN = rf"([{HAN}]{{2,3}}(?:[、與和][{HAN}]+)*[,，\s]+(?:19|20)\d{{2}}[,，.])"
BEFORE_NAME = r"(?<=\d\.)\s+(?=[A-Z][a-zA-Z' -]+,)"
BEFORE_GLUED = rf"\s+(?=[A-Z][a-z]+[A-Z]{{1,3}}\({YEAR}\))"
#: One of these stands wherever one of the four cuts can be.
MAY_BE_CUT = rf"\n|\d[-–]\d|[{HAN}]|\d\.\s|[A-Z]\("
MAX_JOINED = 10
MAX_HEADING = 40
CONNECTOR_END = r"(?i)(?:,|and|&)\s*$"
# ---- end of fixed values ----


def section_start(paras: DataFrame) -> DataFrame:
    """SEG1: doc_id, start; the best kind of heading wins, then the first. No heading is longer than MAX_HEADING."""
    heads = [h.lower() for h in HEADINGS]

    def kind(t):
        return F.when(t.isin(heads), 1).when(F.replace(t, F.lit(" "), F.lit("")).isin(heads), 2).when((F.char_length(t) <= MAX_HEADING) & any_of(t, heads), 3)

    # the normalised text is bound, so it is made once for the three tests; as its blanks are single, the first two kinds
    # are no longer than MAX_HEADING either
    short = lambda t: F.when(F.char_length(t) <= MAX_HEADING, bound(F.lower(t), kind))
    found = paras.select("doc_id", "para_idx", bound(norm_core(F.col("text")), short).alias("kind")).filter("kind is not null")
    return found.groupBy("doc_id").agg(F.min(F.struct("kind", "para_idx")).alias("m")).select("doc_id", F.col("m.para_idx").alias("start"))


def split_sections(paras: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """SEG2: paras with part 'body' or 'references' (the heading counts to the latter); without heading all is body.
    starts: section_start(paras), where it is known already."""
    s = (section_start(paras) if starts is None else starts).withColumnRenamed("doc_id", "_d")
    part = F.when(F.col("start").isNotNull() & (F.col("para_idx") >= F.col("start")), "references").otherwise("body")
    return paras.join(s, F.col("doc_id") == F.col("_d"), "left").withColumn("part", part).drop("_d")


def reference_block(paras: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """SEG3: lines after the heading without noise, up to the first tail heading or tail content."""
    after = split_sections(paras, starts).filter((F.col("part") == "references") & (F.col("para_idx") > F.col("start")))
    tests = lambda t: F.struct(((t != "") & ~is_page_noise(t, normal=True)).alias("kept"), (is_tail_heading(t, normal=True) | is_tail_content(t, normal=True)).cast("int").alias("stop"))
    # a generator, so that the filter does not repeat the tests
    kept = after.select("*", F.explode(F.array(bound(norm_core(F.col("text")), tests))).alias("_x")).filter("_x.kept")
    w = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("_stop", F.max("_x.stop").over(w)).filter("_stop = 0").drop("_stop", "_x", "start", "part")


def merge_wrapped(lines: DataFrame, order: str = "line_idx") -> DataFrame:
    """SEG4: lines that end in a hyphen, a Han character or a connector take the next one. doc_id, first, text, and the
    first line's page where lines have one."""
    w = Window.partitionBy("doc_id").orderBy(order)
    t = F.col("text")
    hyphen = F.when(t.rlike("[-–]$"), F.when(F.lead(t).over(w).rlike(r"^\p{Lu}"), "keep").otherwise("drop"))
    tail = F.coalesce(hyphen, F.when(t.rlike(rf"[{HAN}]\s*$"), "glue"), F.when(t.rlike(CONNECTOR_END), "space"), F.lit("end"))
    marked = lines.withColumn("_tail", tail).withColumn("_before", F.coalesce(F.lag("_tail").over(w), F.lit("end")))
    marked = marked.withColumn("_first", F.max(F.when(F.col("_before") == "end", F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.when((F.col("_tail") == "drop") & F.lead(t).over(w).isNotNull(), F.substring(t, 1, F.char_length(t) - 1)).otherwise(t)
    piece = F.concat(F.when(F.col("_before") == "space", " ").otherwise(""), F.when(F.col("_before") == "end", whole).otherwise(F.trim(whole)))
    page = ["page"] * ("page" in lines.columns)
    parts = marked.select("doc_id", "_first", F.col(order).alias("o"), piece.alias("p"), *page)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda x: x["p"]), "")
    return parts.groupBy("doc_id", "_first").agg(joined.alias("text"), *[F.min_by(c, "o").alias(c) for c in page]).withColumnRenamed("_first", "first")


def split_inline(lines: DataFrame, order: str = "line_idx") -> DataFrame:
    """SEG5: doc_id, order, part_idx, text after four cuts, one after the other, and the line's page if it has one."""
    t = F.col("text")
    t = F.regexp_replace(t, AFTER_PAGES, "$1\n")
    t = F.regexp_replace(t, BEFORE_HAN, "\n$1")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n"), BEFORE_NAME, "\n")
    t = F.regexp_replace(t, BEFORE_GLUED, "\n")
    t = F.when(F.col("text").rlike(MAY_BE_CUT), t).otherwise(F.col("text"))
    parts = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select("doc_id", order, *["page"] * ("page" in lines.columns), F.posexplode(parts).alias("part_idx", "text"))


def assemble_items(lines: DataFrame, order: list[str], bare_years: bool = True) -> DataFrame:
    """SEG6: doc_id, items (array of raw, page): a fold over a document's lines, as whether a line begins an item depends on
    the text gathered so far. What a line tells by itself is read once, before the fold. An item has its first line's page
    (0 without pages). bare_years as in starts_item."""
    page = F.coalesce(F.col("page"), F.lit(0)).cast("int") if "page" in lines.columns else F.lit(0)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(F.col("text").alias("raw"), page.alias("page"), F.col("_kind").alias("kind")).alias("line")))), lambda x: x["line"])
    none = F.array().cast("array<struct<raw:string,page:int>>")
    start = F.struct(none.alias("done"), F.struct(F.lit("").alias("raw"), F.lit(0).alias("page")).alias("now"))

    def step(acc, x):
        now = acc["now"]
        new = (now["raw"] != "") & (x["kind"] > 0) & ~((x["kind"] == 2) & is_open_item(now["raw"]))
        line = F.struct(x["raw"].alias("raw"), x["page"].alias("page"))
        more = F.struct(F.concat(now["raw"], F.lit(" "), x["raw"]).alias("raw"), now["page"].alias("page"))
        moved = lambda n: F.struct(
            F.when(n, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"),
            F.when(n | (now["raw"] == ""), line).otherwise(more).alias("now"),
        )
        return bound(new, moved)

    def finish(acc):
        return F.when(acc["now"]["raw"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    # 1: it begins an item, 2: unless the one before is open
    kind = F.when(starts_item(F.col("text"), bare_years), F.when(is_undated(F.col("text"), bare_years), 2).otherwise(1)).otherwise(0)
    return lines.withColumn("_kind", kind).groupBy("doc_id").agg(ordered.alias("_l")).select("doc_id", F.aggregate("_l", start, step, finish).alias("items"))


def merge_paragraphs(paras: DataFrame) -> DataFrame:
    """SEG7: doc_id, merged (array of text, page): broken paragraphs joined while parentheses are open, a year begins the
    next line, or a hyphen or connector ends one; at most MAX_JOINED lines."""
    ordered = F.array_sort(F.collect_list(F.struct("para_idx", "text", "page")))
    blank = F.struct(F.lit("").alias("text"), F.lit(1).alias("page"), F.lit(0).alias("depth"), F.lit(0).alias("n"))
    start = F.struct(F.array().cast("array<struct<text:string,page:int>>").alias("done"), blank.alias("now"))

    def step(acc, x):
        now, t = acc["now"], x["text"]
        clean = F.trim(now["text"])
        hyphen = clean.rlike("[-–]$")
        year = t.rlike(rf"^\s*\({YEAR}") & (clean != "") & ~clean.rlike("[.?!;。？！；]$")
        join = (now["text"] != "") & (now["n"] < MAX_JOINED) & ((now["depth"] > 0) | year | hyphen | now["text"].rlike(CONNECTOR_END))
        text = F.when(hyphen, F.concat(F.substring(clean, 1, F.char_length(clean) - 1), t)).otherwise(F.concat(now["text"], F.lit(" "), t))
        fresh = F.struct(t.alias("text"), F.coalesce(x["page"], F.lit(1)).cast("int").alias("page"), open_parens(t).alias("depth"), F.lit(1).alias("n"))
        more = F.struct(text.alias("text"), now["page"].alias("page"), (now["depth"] + open_parens(t)).alias("depth"), (now["n"] + 1).alias("n"))
        out = F.concat(acc["done"], F.array(F.struct(now["text"].alias("text"), now["page"].alias("page"))))
        return bound(join, lambda j: F.struct(F.when(j | (now["text"] == ""), acc["done"]).otherwise(out).alias("done"), F.when(j, more).otherwise(fresh).alias("now")))

    def finish(acc):
        return F.when(acc["now"]["text"] != "", F.concat(acc["done"], F.array(F.struct(acc["now"]["text"].alias("text"), acc["now"]["page"].alias("page"))))).otherwise(acc["done"])

    return paras.groupBy("doc_id").agg(ordered.alias("_l")).select("doc_id", F.aggregate("_l", start, step, finish).alias("merged"))


def body_text(text, mode: str, marker: str | None = None, chars: int = 120_000):
    """SEG11: the part of a document's text that a test reads, as a column."""
    cut = {
        "full_text": text,
        "first_n_chars": F.left(text, F.lit(chars)),
        "until_marker": F.when(F.position(F.lit(marker or ""), text) > 0, F.left(text, F.position(F.lit(marker or ""), text) - 1)).otherwise(text),
        "before_heading": F.regexp_extract(F.concat(text, F.lit("\nreferences\n")), r"(?is)^(.*?)\n\s*(?:" + "|".join(HEADINGS) + r")\s*\n", 1),
    }
    return F.left(cut[mode], F.lit(chars))
