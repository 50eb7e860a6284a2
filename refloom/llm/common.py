"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lineage import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "freed", "give_back", "let", "partitions_for", "read_table", "whole_row"]
#: Bytes of text that one task should hold.
TASK_BYTES = 12 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, *text_cols: str, task_bytes: int = TASK_BYTES) -> int:
    """A partition count that follows the input: total text bytes over task_bytes, one job over the text columns."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in text_cols), F.lit(0).cast("long"))
    total = df.select(F.sum(size + F.lit(64)).alias("b")).first()["b"] or 0
    return max(8, math.ceil(total / task_bytes))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that a stage's own names cannot clash with theirs; ``select("_row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_row")


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        return lambda pad: 0


def give_back() -> None:
    """Give the system the memory that a task has freed. Its worker lives on, and would hold it beside later tasks' needs."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def freed(result):
    """A function's result, after what else it had used is given back."""
    give_back()
    return result
