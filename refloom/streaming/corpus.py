"""Citations of documents that arrive one by one: extraction is stateless, so the batch plan runs on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.match import citations


def citation_stream(paragraphs: DataFrame) -> DataFrame:
    """paragraphs: a stream of doc_id, para_idx, text. The same columns as the batch operator gives."""
    return citations(paragraphs).select("doc_id", "para_idx", "seq", "raw", "style", "key")
