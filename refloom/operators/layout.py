"""Reading order of two-column pages from word boxes (SRC3), and duplicates and rankings of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: the gutter, the header's share of the page, and its margin ----
GUTTER = (0.4, 0.6)
HEADER_SHARE, HEADER_MARGIN = 0.2, 5.0
# ---- end of fixed values ----


def page_text(words: DataFrame) -> DataFrame:
    """doc_id, page, columns, text. words: doc_id, page, word_idx, text, x0, x1, top, bottom, page_width, page_height.

    No word over the gutter: two columns from the top. Else, if the lowest such word ends in the header's share, two
    columns below it. Else one column.
    """
    over = (F.col("x1") > F.col("page_width") * GUTTER[0]) & (F.col("x0") < F.col("page_width") * GUTTER[1])
    w = Window.partitionBy("doc_id", "page")
    lowest = F.max(F.when(over, F.col("bottom"))).over(w)
    t = words.withColumn("_low", lowest)
    two = F.col("_low").isNull() | (F.col("_low") < F.col("page_height") * HEADER_SHARE)
    cut = F.when(F.col("_low").isNull(), F.lit(-1.0)).otherwise(F.col("_low") + HEADER_MARGIN)
    region = F.when(~two, 0).when(F.col("top") < cut, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, 1).otherwise(2)
    t = t.select("doc_id", "page", F.when(two, 2).otherwise(1).alias("columns"), F.struct(region.alias("r"), "top", "x0", "word_idx", "text").alias("w"))
    return t.groupBy("doc_id", "page", "columns").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["text"]), " ").alias("text"))


def distinct_contents(df: DataFrame, content: str, order: str) -> DataFrame:
    """KEY7, JOB1: a row a content: its SHA-256, the first order value and how many have it."""
    return df.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash")).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"))


def newest(df: DataFrame, by: list[str], ts: str, tie: str, keep: int) -> DataFrame:
    """SRT6: the keep newest rows of each group; what a bounded registry would still hold."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
