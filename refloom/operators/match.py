"""Matching citations with references (JN2 to JN9, AGG1 to AGG5): joins on the document and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cites import core_key, extract_citations, match_key, parse_citation, parse_core, parse_reference
from ..functions.text import fold_accents, han_key, norm_core, preview, similar, surname_key
from ..sources.lineage import cut_lineage


def once(parsed: Column) -> Column:
    """A row for a parsed struct, none for null. A generator, so that the optimizer does not repeat the whole parse for
    each of its fields."""
    return F.explode(F.filter(F.array(parsed), lambda x: x.isNotNull()))


def citations(paras: DataFrame) -> DataFrame:
    """doc_id, para_idx, seq, raw, style, c (parsed), key."""
    found = paras.select("doc_id", "para_idx", F.posexplode(extract_citations(F.col("text"))).alias("seq", "x")).select("doc_id", "para_idx", "seq", "x.raw", "x.style")
    parsed = found.select("*", once(parse_citation(F.col("raw"))).alias("c"))
    return parsed.withColumn("key", match_key(F.col("c")))


def references(items: DataFrame) -> DataFrame:
    """doc_id, pos, raw, r (parsed), key."""
    parsed = items.select("doc_id", "pos", "raw", once(parse_reference(F.col("raw"))).alias("r"))
    return parsed.withColumn("key", match_key(F.col("r")))


def four_way(paras: DataFrame, items: DataFrame) -> DataFrame:
    """JN8: doc_id, key, status, reason, candidate_count, candidates. Keys of each side are reduced before the join, so
    a key's rows meet as one; the candidates of a key are those of one document."""
    cited = citations(paras).filter("key is not null").select("doc_id", "key").distinct().withColumn("cited", F.lit(True))
    known = references(items).filter("key is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", preview(F.col("raw")).alias("raw")))).alias("c"))
    both = cited.join(known, ["doc_id", "key"], "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("cited").isNull(), "extra").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    out = both.withColumn("status", status)
    unclear = F.col("status") == "ambiguous"
    return out.select(
        "doc_id",
        "key",
        "status",
        F.when(unclear, "multiple_references_same_key").alias("reason"),
        F.coalesce("n", F.lit(0)).cast("long").alias("candidate_count"),
        F.when(unclear, F.array_join(F.transform("c", lambda x: x["raw"]), " | ")).alias("candidates"),
    )


def core_references(items: DataFrame, bare_years: bool = True) -> DataFrame:
    """Document engine: doc_id, pos, page, item_idx (dense over parsed items), lang, author1, author2, year, raw, k_author,
    k_year. items without page have page 0; bare_years as in parse_core."""
    page = F.col("page") if "page" in items.columns else F.lit(0)
    p = items.select("doc_id", "pos", page.cast("int").alias("page"), once(parse_core(F.col("raw"), bare_years)).alias("p")).select("doc_id", "pos", "page", "p.*")
    p = p.withColumn("item_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    return with_core_key(p)


def with_core_key(df: DataFrame) -> DataFrame:
    k = core_key(F.col("lang"), F.col("author1"), F.col("year"))
    return df.withColumn("_k", k).withColumn("k_author", F.col("_k.author")).withColumn("k_year", F.col("_k.year")).drop("_k")


ON = ["doc_id", "lang", "k_author", "k_year"]


def exact(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """JN2: cites with ref_raw, ref_idx and ref_page of the first reference of equal key; one row a citation."""
    return cites.join(_first_of_key(refs), ON)


def _first_of_key(refs: DataFrame) -> DataFrame:
    first = refs.groupBy(*ON).agg(F.min(F.struct("item_idx", "raw", "page")).alias("f"))
    return first.select(*ON, F.col("f.item_idx").alias("ref_idx"), F.col("f.raw").alias("ref_raw"), F.col("f.page").alias("ref_page"))


def cited_by_key(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """All references of a cited key count as cited."""
    return refs.join(cites.select(*ON).distinct(), ON, "left_semi").select("doc_id", "item_idx")


def not_exact(cites: DataFrame, refs: DataFrame) -> DataFrame:
    return cites.join(refs.select(*ON).distinct(), ON, "left_anti")


def _said(cites: DataFrame, block: DataFrame) -> DataFrame:
    """JN3: doc_id, _a, _y: the authors and years cited in a document that both stand somewhere in its reference text
    (doc_id, ref_text). A document's pairs meet its text once."""
    pair = F.struct(F.lower("author1").alias("a"), F.lower("year").alias("y"))
    asked = cites.groupBy("doc_id").agg(F.collect_set(pair).alias("_asked"))
    # line by line the same text as norm_core(ref_text), and lines of plain text cost little
    lines = F.filter(F.transform(F.split("ref_text", "\n"), norm_core), lambda x: x != "")
    text = block.select("doc_id", F.lower(F.array_join(lines, " ")).alias("_t"))
    there = lambda p: (F.col("_t").contains(p["a"]) | F.col("_t").contains(F.replace(p["a"], F.lit("-"), F.lit(" ")))) & F.col("_t").contains(p["y"])
    return asked.join(text, "doc_id").select("doc_id", F.explode(F.filter("_asked", there)).alias("p")).select("doc_id", F.col("p.a").alias("_a"), F.col("p.y").alias("_y"))


def with_raw_text(cites: DataFrame, block: DataFrame) -> DataFrame:
    """cites with in_text, whether JN3 holds: one join for the citations that are found and those that are not."""
    said = _said(cites, block).withColumn("in_text", F.lit(True))
    marked = cites.withColumn("_a", F.lower("author1")).withColumn("_y", F.lower("year"))
    return marked.join(said, ["doc_id", "_a", "_y"], "left").withColumn("in_text", F.col("in_text").isNotNull()).drop("_a", "_y")


def in_raw_text(cites: DataFrame, block: DataFrame) -> DataFrame:
    return with_raw_text(cites, block).filter("in_text").drop("in_text")


def by_context(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """JN4: cites recovered by year and context; cheap tests stand before the ratio. One row a citation, the first
    reference in order."""
    c = cites.select(*[F.col(x).alias(f"c_{x}") for x in ("doc_id", "cite_id", "lang", "author1", "author2", "year", "context")])
    second = F.when(F.col("lang") == "en", surname_key(F.col("author2"))).otherwise(han_key(F.col("author2")))
    r = refs.select(F.col("doc_id").alias("r_doc"), "item_idx", F.col("lang").alias("r_lang"), second.alias("r_author2"), F.col("year").alias("r_year"), F.col("raw").alias("r_raw"), "page", "k_author")
    pairs = c.join(r, (F.col("c_doc_id") == F.col("r_doc")) & (F.col("c_year") == F.col("r_year")) & (F.col("c_lang") == F.col("r_lang")))
    ctx = fold_accents(F.lower(norm_core(F.col("c_context"))))
    near = ctx.contains(F.col("k_author")) | ctx.contains(F.replace(F.col("k_author"), F.lit("-"), F.lit(" ")))
    sure = F.col("r_raw").contains(F.col("c_author1")) | F.coalesce(F.col("c_author2") == F.col("r_author2"), F.lit(False))
    pairs = pairs.filter(near).withColumn("_alike", F.when(sure, F.lit(True)).otherwise(similar(F.col("c_author2"), F.col("r_author2")))).filter("_alike")
    best = pairs.groupBy("c_cite_id").agg(F.min(F.struct("item_idx", "r_raw", "page")).alias("b"))
    return best.select(F.col("c_cite_id").alias("cite_id"), F.col("b.item_idx").alias("ref_idx"), F.col("b.r_raw").alias("ref_raw"), F.col("b.page").alias("ref_page"))


EXACT, RAW_TEXT, CONTEXT_FOUND = "Exact", "Found in Raw Text (Parser Missed)", "Context Recovery"


def staged(cites: DataFrame, refs: DataFrame, block: DataFrame) -> DataFrame:
    """cites, whose cite_id is unique, with match_type (null: missing), ref_raw, ref_idx and ref_page. Each stage sees what
    the ones before left: the first two are marks on one pass, the third is joined to what has neither."""
    keyed = cites.join(_first_of_key(refs), ON, "left")
    hit = keyed.filter("ref_idx is not null").withColumn("match_type", F.lit(EXACT))
    rest = cut_lineage(with_raw_text(keyed.filter("ref_idx is null").drop("ref_raw", "ref_idx", "ref_page"), block))
    said = rest.filter("in_text").drop("in_text").withColumns({"match_type": F.lit(RAW_TEXT), "ref_raw": F.lit("(Located in Reference Section text)"), "ref_idx": F.lit(None).cast("int"), "ref_page": F.lit(0)})
    open_ = rest.filter("not in_text").drop("in_text")
    tried = open_.join(by_context(open_, refs), "cite_id", "left").withColumn("match_type", F.when(F.col("ref_idx").isNotNull(), CONTEXT_FOUND))
    return hit.unionByName(said).unionByName(tried)


def cascade(cites: DataFrame, refs: DataFrame, block: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JN5 to JN7: (matched, missing, uncited), from one table of stages that is written once."""
    every = cut_lineage(staged(cites, refs, block))
    used = cited_by_key(cites, refs).union(every.filter(F.col("match_type") == CONTEXT_FOUND).select("doc_id", F.col("ref_idx").alias("item_idx")))
    missing = every.filter("match_type is null").drop("match_type", "ref_raw", "ref_idx", "ref_page")
    return every.filter("match_type is not null"), missing, refs.join(used.distinct(), ["doc_id", "item_idx"], "left_anti")


def summary(docs: DataFrame, **counted: DataFrame) -> DataFrame:
    """AGG1: a row a document with the number of rows of each named table, 0 where it has none."""
    parts = None
    for name, df in counted.items():
        one = df.select("doc_id", F.lit(name).alias("_what"))
        parts = one if parts is None else parts.union(one)
    counts = parts.groupBy("doc_id").pivot("_what", list(counted)).count()
    return docs.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in counted])


def resolve_override(auto: DataFrame, override: DataFrame, bare_years: bool = True) -> DataFrame:
    return sources_of(core_references(auto, bare_years), override, bare_years)


def sources_of(own: DataFrame, override: DataFrame, bare_years: bool = True) -> DataFrame:
    """JN9, PRS10, AGG8: doc_id, reference_source, reference_item_count, override_items_count,
    override_parse_failed_count, warning. Override items (doc_id, pos, raw) count if any of a document can be parsed."""
    o = override.filter(F.trim("raw") != "").select("doc_id", F.when(parse_core(F.col("raw"), bare_years).isNotNull(), 1).otherwise(0).cast("long").alias("ok"))
    o = o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("parsed"))
    a = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("auto"))
    both = a.join(o, "doc_id", "full_outer").na.fill(0, ["n", "parsed", "auto"])
    use = F.col("parsed") > 0
    return both.select(
        "doc_id",
        F.when(use, "user_override").otherwise("auto_extracted").alias("reference_source"),
        F.when(use, F.col("parsed")).otherwise(F.col("auto")).alias("reference_item_count"),
        F.col("n").alias("override_items_count"),
        (F.col("n") - F.col("parsed")).alias("override_parse_failed_count"),
        F.when((F.col("n") > 0) & ~use, "fallback").when(use & (F.col("parsed") < F.col("n")), "partial").alias("warning"),
    )
