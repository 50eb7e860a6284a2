"""The whole analysis of documents: paragraphs to citations, references, their matches and four reports. References
and citations are each read out of the texts once, and the reports start from what was written.

paras: doc_id, para_idx, text, page. overrides: doc_id, pos, raw, references that a user gives for a document; if any of a
document's can be read, they replace its own. A document without a heading of references has an error instead of reports,
unless it has overrides; then all of it is body. bare_years: whether years outside parentheses count in references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import error_code
from ..sources.lineage import cut_lineage
from . import match, segment, spans


@dataclass(frozen=True)
class Reports:
    summary: DataFrame  #: doc_id and six counts
    matched: DataFrame
    missing: DataFrame
    uncited: DataFrame
    errors: DataFrame  #: doc_id, code
    sources: DataFrame  #: doc_id, which references count, how many, and warnings


def reference_lines(paras: DataFrame, starts: DataFrame | None = None, bare_years: bool = True) -> DataFrame:
    """doc_id, pos, raw, page: the items of a document's reference section (SEG3 to SEG6), not yet parsed."""
    whole = segment.merge_wrapped(segment.reference_block(paras, starts), "para_idx")
    return segment.assemble_items(segment.split_inline(whole, "first"), ["first", "part_idx"], bare_years).select("doc_id", F.posexplode("items").alias("pos", "i")).select("doc_id", "pos", "i.raw", "i.page")


def cited(paras: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations of the body as the cascade takes them; cite_id is unique."""
    found = spans.first_of_each(spans.citations_in(paras, refs))
    return match.with_core_key(found.withColumn("cite_id", F.concat_ws(":", "doc_id", "para_idx", "seq")))


def analyse(paras: DataFrame, overrides: DataFrame | None = None, bare_years: bool = True) -> Reports:
    paras = cut_lineage(paras)  # seven steps read them
    starts = cut_lineage(segment.section_start(paras))
    parts = segment.split_sections(paras, starts)
    headed = starts.select("doc_id")
    own = cut_lineage(match.core_references(reference_lines(paras, starts, bare_years), bare_years))
    raw = parts.filter("part = 'references'").select("doc_id", F.col("para_idx").cast("long").alias("pos"), F.col("text").alias("raw"))
    docs = paras.select("doc_id").distinct()
    refs, asked = own, headed
    if overrides is not None:
        given = overrides.filter(F.trim("raw") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("raw"), F.lit(0).alias("page"))
        read = cut_lineage(match.core_references(given, bare_years))
        taken = read.select("doc_id").distinct()
        refs = own.join(taken, "doc_id", "left_anti").unionByName(read)
        raw = raw.join(taken, "doc_id", "left_anti").unionByName(given.join(taken, "doc_id", "left_semi").drop("page"))
        asked = headed.union(given.select("doc_id")).distinct()
    body = parts.filter("part = 'body'").join(asked, "doc_id", "left_semi").select("doc_id", "para_idx", "text", "page")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n")
    block = raw.groupBy("doc_id").agg(text.alias("ref_text"))
    cites = cut_lineage(cited(body, refs))
    matched, missing, uncited = match.cascade(cites, refs, block)
    known = docs.join(asked, "doc_id", "left_semi")
    summary = match.summary(known, body_paragraphs=body, reference_items=refs, citations=cites, matched=matched, missing=missing, uncited=uncited)
    errors = docs.join(asked, "doc_id", "left_anti").select("doc_id", error_code(F.lit("no reference section")).alias("code"))
    base = ["doc_id", F.col("raw").alias("citation_raw"), "lang", "author1", "year", "para_idx", "context", "page"]
    empty = overrides if overrides is not None else paras.limit(0).select("doc_id", F.lit(0).alias("pos"), F.lit("").alias("raw"))
    return Reports(
        summary,
        matched.select(*base, "match_type", "ref_raw", "ref_page"),
        missing.select(*base),
        uncited.select("doc_id", "item_idx", "lang", "author1", "year", "raw", "page"),
        errors,
        match.sources_of(own, empty, bare_years),
    )
