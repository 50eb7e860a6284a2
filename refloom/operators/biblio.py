"""Normalising and sorting bibliographies (Entry C): native parsing, windows for suffixes, ordered output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cites import author_surname, authors_list, split_year, title_and_source, title_key
from ..functions.text import HAN, norm_reference, put_year

UNKNOWN_STROKES = 9999


def parse_items(items: DataFrame, bare_years: bool = True) -> DataFrame:
    """PRS6 to PRS9 on items (doc_id, pos, raw): text, year, suffix, authors, surnames, first, reason (null if parsed).
    bare_years as in split_year."""
    t = items.select("doc_id", "pos", norm_reference(F.col("raw")).alias("text")).filter("text <> ''")
    t = t.withColumn("y", split_year(F.col("text"), bare_years))
    t = t.withColumn("authors_raw", F.regexp_replace(F.trim(F.col("y.before")), r"[,.;]+$", ""))
    t = t.withColumn("authors", F.when(F.col("authors_raw") != "", authors_list(F.col("authors_raw"))).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("surnames", F.filter(F.transform("authors", lambda a: F.lower(author_surname(a))), lambda s: s != ""))
    first = F.coalesce(F.get("surnames", F.lit(0)), F.lower(author_surname(F.substring_index("authors_raw", ",", 1))), F.lit(""))
    t = t.withColumn("first", first).withColumn("reason", F.when(F.col("y").isNull(), "year_missing").when(F.col("first") == "", F.when(F.size("authors") == 0, "author_parse_failed").otherwise("author_missing")))
    return t.withColumn("year", F.col("y.year")).withColumn("suffix", F.coalesce(F.col("y.suffix"), F.lit("")))


def _finished(t: DataFrame, bare_years: bool) -> DataFrame:
    s = title_and_source(split_year(F.col("text"), bare_years)["after"])
    t = t.withColumn("_s", F.when(F.col("reason").isNull(), s)).withColumn("title", F.col("_s.title")).withColumn("source", F.col("_s.source")).drop("_s")
    rank = F.struct((F.col("suffix") != "").cast("int").alias("a"), F.col("suffix").alias("b"))
    key = F.struct("first", F.slice("surnames", 2, F.greatest(F.size("surnames"), F.lit(1))).alias("more"), F.col("year").cast("int").alias("y"), rank.alias("r"), F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]", "").alias("t"), "pos")
    return t.withColumn("sort_key", F.when(F.col("reason").isNull(), key))


def auto_suffix(t: DataFrame) -> DataFrame:
    """AGG6: of items with equal authors and year, those without a suffix get the next free letter in sort order."""
    group = ["doc_id", "year", F.when(F.size("surnames") > 1, F.col("surnames")).otherwise(F.array("first"))]
    w = Window.partitionBy(*group)
    open_ = (F.col("reason").isNull()) & (F.col("suffix") == "")
    turn = F.row_number().over(Window.partitionBy(*group, open_).orderBy("sort_key"))
    free = F.array_except(F.array(*[F.lit(chr(97 + i)) for i in range(26)]), F.collect_set(F.when(F.col("suffix") != "", F.col("suffix"))).over(w))
    new = F.when(open_ & (F.count(F.when(F.col("reason").isNull(), 1)).over(w) > 1), F.get(free, turn - 1))
    t = t.withColumn("_new", new)
    return t.withColumn("auto", F.col("_new").isNotNull()).withColumn("suffix", F.coalesce("_new", "suffix")).drop("_new")


def sort_bibliography(items: DataFrame, bare_years: bool = True) -> DataFrame:
    """doc_id, ord (from 0), pos, text, key, auto, reason: parsed items in order, then the others as they came."""
    t = parse_items(items, bare_years)
    t = t.withColumn("text", F.when(F.col("reason").isNull(), put_year(F.col("text"), F.col("year"), F.col("suffix"))).otherwise(F.col("text")))
    t = auto_suffix(_finished(t, bare_years))
    t = t.withColumn("text", F.when(F.col("auto"), put_year(F.col("text"), F.col("year"), F.col("suffix"))).otherwise(F.col("text")))
    t = _finished(t, bare_years)
    key = F.when(F.col("reason").isNull(), title_key(F.col("first"), F.col("year"), F.col("suffix"), F.col("title"))).otherwise("")
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("reason").isNotNull(), F.col("sort_key"), "pos")) - 1
    return t.withColumn("key", key).withColumn("ord", ord_)


def report(sorted_items: DataFrame) -> DataFrame:
    """AGG7: counts of a document's items and of the reasons of failure."""
    ok = F.col("reason").isNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return sorted_items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_items"), n(ok).alias("parsed_items"), n(ok & (F.col("first") != "") & F.col("year").isNotNull()).alias("authors_year_parsed_items"), n(F.col("auto")).alias("auto_suffix_applied_items"), n(F.col("reason") == "year_missing").alias("year_missing"), n(F.col("reason") == "author_missing").alias("author_missing"))


def tool_sort(items: DataFrame, strokes: DataFrame | None = None) -> DataFrame:
    """SRT1, SRT2, JN10: doc_id, ord, raw; Chinese items by strokes first, then Latin ones, others, empty ones.
    strokes: ch, n (a dictionary of characters); characters outside count UNKNOWN_STROKES."""
    t = F.trim("raw")
    han = F.regexp_extract(t, f"[{HAN}]", 0)
    kind = F.when(t == "", 3).when(han != "", 0).when(t.rlike("^[A-Za-z]"), 1).otherwise(2)
    rows = items.withColumn("_k", kind).withColumn("_h", F.when(kind == 0, han).otherwise(""))
    if strokes is not None:
        rows = rows.join(strokes.select(F.col("ch").alias("_h"), F.col("n").alias("_n")), "_h", "left")
    else:
        rows = rows.withColumn("_n", F.lit(None).cast("int"))
    count = F.when(F.col("_k") == 0, F.coalesce("_n", F.lit(UNKNOWN_STROKES))).otherwise(0)
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("_k", count, "_h", F.lower(t), "pos")) - 1
    return rows.select("doc_id", ord_.alias("ord"), "pos", "raw")
