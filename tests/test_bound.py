"""What is read out of a text is made once: plans do not repeat it, results stay."""

import pytest
from pyspark.sql import functions as F

from refloom.functions import rules, text
from refloom.operators import analysis, match, segment, spans
from refloom.plans.registry import QUERIES
from refloom.sources import synth

D = "/root/testdata/sf0.001"
ODD = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a b", "a\n", "a\n\n b", "a b", "a  b", "\x00a\x1f b", "（李）。", "don’t", "x​y", "~!", None, "a \n", "　", "é  è"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_plain_text_is_normal_already(spark):
    t = F.col("t")
    full = F.trim(F.regexp_replace(text.mapped(F.regexp_replace(t, "[​‎‏\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), text.DOCUMENT_MAP), r"(?U)\s+", " "))
    got = column(spark, ODD, text.norm_core(t), full)
    assert [a for a, _ in got] == [b for _, b in got]


def test_blocks_are_normalised_line_by_line(spark):
    blocks = ["\n".join(x or "" for x in ODD), "a\n\n\nb", "\n", " \n x", "Vega, A.\r\n（2019）。"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "doc_id int, ref_text string")
    lines = F.array_join(F.filter(F.transform(F.split("ref_text", "\n"), text.norm_core), lambda x: x != ""), " ")
    assert all(r["a"] == r["b"] for r in df.select(lines.alias("a"), text.norm_core(F.col("ref_text")).alias("b")).collect())


def test_filters_do_not_repeat_what_they_test(spark):
    paras = spark.createDataFrame([(1, 0, "References", 1), (1, 1, "Vega, A. (1999). Notes.", 1)], "doc_id int, para_idx int, text string, page int")
    squeezes = lambda df: plan_of(df).count("(?U)\\s{2,}") or plan_of(df).count("(?U)\\s+")
    assert squeezes(segment.reference_block(paras, spark.createDataFrame([(1, 0)], "doc_id int, start int"))) == 1
    one = spark.createDataFrame([(0, "Table 3")], "i int, t string")
    for test in (rules.is_not_author, rules.is_plausible_year, rules.is_numeric_fragment, rules.is_open_item, rules.is_undated):
        assert squeezes(one.filter(test(F.col("t")))) == 1, test


@pytest.mark.parametrize("name", ["document_matched", "document_summary", "document_uncited"])
def test_tables_are_read_once(spark, name, monkeypatch):
    """The texts are made out of the tables once, not by each step; the hits are told apart once."""
    written, found = [], []
    cut, told = analysis.cut_lineage, spans.narrative
    monkeypatch.setattr(analysis, "cut_lineage", lambda df: written.append(plan_of(df).count("lineitem.parquet") or plan_of(df).count("l_orderkey")) or cut(df))
    monkeypatch.setattr(spans, "narrative", lambda hits: found.append(1) or told(hits))
    out = QUERIES[name](spark, D)
    assert written[0] > 0 and not any(written[1:]) and "l_orderkey" not in plan_of(out) and len(found) == 1


def test_appending_needs_an_open_item_and_an_undated_line(spark):
    lines = ["Vega, A. (1999). Notes", "more of it", "（2019）。Lee", "Lee, K. (2001)", "Roll and notes (see 2003)", "Zhu, B. (n.d.). Rest."]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_idx int, text string")
    items = segment.assemble_items(df, ["line_idx"]).select(F.explode("items.raw").alias("x")).collect()
    assert [r["x"] for r in items] == ["Vega, A. (1999). Notes more of it （2019）。Lee", "Lee, K. (2001)", "Roll and notes (see 2003)", "Zhu, B. (n.d.). Rest."]
    pair = lambda a, b: [r["x"] for r in df.limit(1).select(rules.must_append(F.lit(a), F.lit(b)).alias("x")).collect()][0]
    assert pair("Vega, A. (1999). Notes", "more") and not pair("Vega, A. (1999). Notes.", "more") and not pair("Vega, A. (1999). Notes", "Lee, K. (2001)")


def test_lines_without_a_place_to_cut_stay_whole(spark):
    lines = ["pp. 12-34. Lee, K. (2001).", "Notes 5. Roll, A. (1999).", "see LeeAB(2001) and VegaC(1999)", "甲。王明, 2019, 題", "a \n b", " ", "Vega, A. (1999). Notes.", "12–34."]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_idx int, text string")
    got = [[r["text"] for r in segment.split_inline(df).filter(F.col("line_idx") == i).orderBy("part_idx").collect()] for i in range(len(lines))]
    assert got == [["pp. 12-34.", "Lee, K. (2001)."], ["Notes 5.", "Roll, A. (1999)."], ["see", "LeeAB(2001) and", "VegaC(1999)"], ["甲。", "王明, 2019, 題"], ["a", "b"], [], ["Vega, A. (1999). Notes."], ["12–34."]]


def test_year_keys(spark):
    years = ["2019", "2019A", " 2019 a", "N.D.", "n.d.-a", "No date b", "In Press", "in press-b", "1066", "99", "", None, "印刷中", "n.d.a"]
    assert [k for k, in column(spark, years, text.year_key(F.col("t")))] == ["2019", "2019a", "2019a", "n.d.", "n.d.a", "n.d.b", "in press", "in pressb", "1066", "99", "", None, "in press", "n.d."]
