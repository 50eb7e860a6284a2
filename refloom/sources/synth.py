"""A citation corpus derived from the star tables, as DataFrames (the driver's tables hold no citations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = "Baier Chava Diaz Evans Fama French Gordon Hummel Ivanov Jensen Kothari Lakonishok Merton Nash Ohlson Powell Quinn Roll Schlick Titman Ulrich Vega Watts Young Zmijewski".split()

LONG_NAME = "Müller-Lüdenscheidt"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def name_at(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (n % len(NAMES) + 1).cast("int"))


def body(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, para_idx, text: nine kinds of paragraphs."""
    x, z = name_at(F.col("o_custkey") * 7 + F.col("o_orderkey")), name_at(F.col("o_custkey") * 5 + F.col("o_orderkey"))
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, F.concat(F.lit("Prior work ("), x, F.lit(" et al., "), y, F.lit(") shows an effect.")))
        .when(k == 1, F.concat(x, F.lit(" ("), y, F.lit(") reports an effect.")))
        .when(k == 2, F.lit("No source is named here, p < 0.05 (see below)."))
        .when(k == 3, F.concat(F.lit("Two studies ("), x, F.lit(", "), y, F.lit("; "), z, F.lit(", "), y, F.lit("a, p. 12) agree.")))
        .when(k == 4, F.concat(x, F.lit(" and "), z, F.lit(" ("), y, F.lit(") differ from ("), z, F.lit(", n.d.).")))
        .when(k == 5, F.concat(F.lit("李明（"), y, F.lit("）指出此點。")))
        .when(k == 6, F.lit(f"As {LONG_NAME} (in press) and others show, this holds."))
        .when(k == 7, F.concat(F.lit("Work by "), x, F.lit(", "), name_at(F.col("o_custkey") * 3 + 1), F.lit(" and "), z, F.lit(" ("), y, F.lit("a) agrees.")))
        .otherwise(F.concat(F.lit("More is told elsewhere (the tables of "), x, F.lit(" in "), y, F.lit(" and their notes).")))
    )
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("para_idx"), text.alias("text"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, raw: a reference for each line of an order, in eight forms; pos orders them within a document."""
    line, orders, part = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    x, z = name_at(F.col("o_custkey") * 7 + F.col("o_orderkey") + F.col("l_linenumber") - 1), name_at(F.col("l_suppkey"))
    y, k = F.year("l_shipdate").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    tail = F.concat(F.col("p_name"), F.lit(". Journal "), F.col("l_suppkey").cast("string"), F.lit("."))
    raw = (
        F.when(k <= 3, F.concat(x, F.lit(", A. ("), y, F.lit("). "), tail))
        .when(k == 4, F.concat(x, F.lit(", A. (n.d.). "), tail))
        .when(k == 5, F.concat(x, F.lit(", A., & "), z, F.lit(", B. ("), y, F.lit("a). "), tail))
        .when(k == 6, F.concat(F.lit("李明（"), y, F.lit("）。"), tail))
        .when(k == 7, F.concat(x, F.lit(", A. Working notes. "), tail))
        .when(k == 8, F.concat(F.lit(f"{LONG_NAME}, A. (in press). "), tail))
        .otherwise(F.concat(F.lit("王小明、李華（"), y, F.lit("）。"), tail))
    )
    pos = (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("pos")
    return j.select(F.col("o_custkey").alias("doc_id"), pos, raw.alias("raw")).groupBy("doc_id", "pos").agg(F.min("raw").alias("raw"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_idx, text: lines as page layout leaves them."""
    x, y, k = name_at(F.col("o_orderkey")), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 10
    n = F.col("o_orderkey").cast("string")
    kinds = [F.lit("12"), F.lit("This content downloaded from 10.0.0.1"), F.lit("Journal Of Finance Studies"), F.lit("Appendix B tables"), F.lit("Table IV results"), F.lit("Technical Manuals, Standards and Reports"), F.concat(x, F.lit(", A. ("), y, F.lit("). Study "), n, F.lit(".")), F.lit("45 running head of the journal"), F.concat(x, F.lit(" and others in "), y), F.concat(F.lit("Figure 3 shows p = 0."), n)]
    text = kinds[-1]
    for i, c in enumerate(kinds[:-1]):
        text = F.when(k == i, c).otherwise(text)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_idx"), text.alias("text"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, para_idx, text, page: body, a heading in one of three forms, references, for some an appendix."""
    docs = body(spark, d).select("doc_id").distinct()
    head = F.when(F.col("doc_id") % 3 == 0, "References").when(F.col("doc_id") % 3 == 1, "R e f e r e n c e s").otherwise("List of references")
    row = lambda df, section, ord_, text: df.select("doc_id", F.lit(section).alias("s"), ord_.cast("long").alias("o"), text.alias("text"))
    every = (
        row(body(spark, d), 0, F.col("para_idx"), F.col("text"))
        .union(row(docs, 1, F.lit(0), head))
        .union(row(refs(spark, d), 2, F.col("pos"), F.col("raw")))
        .union(row(docs.filter("doc_id % 2 = 0"), 3, F.lit(0), F.lit("Appendix A")))
        .union(row(docs.filter("doc_id % 2 = 0"), 3, F.lit(1), F.lit("Other, B. (1999). Not cited.")))
    )
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "o")) - 1
    return every.select("doc_id", idx.alias("para_idx"), "text").withColumn("page", (F.floor(F.col("para_idx") / 10) + 1).cast("int"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, line_idx, text: references broken over two lines, at a comma, a hyphen or a full stop."""
    r = refs(spark, d)
    k = F.col("pos") % 3
    first = F.when(k == 0, F.concat(F.lit("Notes on "), F.col("raw"), F.lit(","))).when(k == 1, F.concat(F.col("raw"), F.lit(" know-"))).otherwise(F.col("raw"))
    second = F.when(k == 1, F.lit("ledge of things.")).otherwise(F.lit("Second part of it."))
    return r.select("doc_id", F.posexplode(F.array(first, second)).alias("i", "text"), "pos").select("doc_id", (F.col("pos") * 2 + F.col("i")).alias("line_idx"), "text")
