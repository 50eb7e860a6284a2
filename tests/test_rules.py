"""Small inputs with known results."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from refloom.functions import cites, items, rules, text
from refloom.operators import analysis, biblio, layout, match, metrics, segment, spans
from refloom.sources import files


def col(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_safe_normalisation(spark):
    given = ["Baier， P. （2020） 。\n李明（2021）： 研究；", "A － B – C — D - E", "  Baier ,\t P .   ( 2020a )   \n\tSmith , J . ( n.d. )  ", "Ref A.\n\n\n\nRef B.\n\n \nRef C."]
    assert col(spark, text.norm_safe, *given) == ["Baier, P. (2020).\n李明(2021): 研究;", "A - B - C - D - E", "Baier, P. (2020a)\nSmith, J. (n.d.)", "Ref A.\n\nRef B.\n\nRef C."]


def test_keys_of_names_and_years(spark):
    assert col(spark, text.surname_key, "Müller", "Smith J.", "SmithJA", "O'Neil, P.") == ["muller", "smith", "smith", "o'neil"]
    assert col(spark, text.person_key, "Müller", " Li  ", None) == ["mller", "li", ""]
    assert col(spark, text.year_key, "2020 a", "N.D.", "Spring 2020 ed", "in press", "1999") == ["2020a", "n.d.", "2020d", "in press", "1999"]


@pytest.mark.parametrize(
    ("told", "keys"),
    [
        ("Prior research (Baier et al., 2020) shows outcomes.", {"baier_2020"}),
        ("Evidence appears in (DiMaggio & Powell, 1983).", {"dimaggio_1983"}),
        ("DiMaggio and Powell (1983) argue (DiMaggio & Powell, 1983).", {"dimaggio_1983"}),
        ("Reported in (Garcia, 2020a).", {"garcia_2020a"}),
        ("Studies converge (Baier et al., 2020; Chava, 2014).", {"baier_2020", "chava_2014"}),
        ("Argued before (Chava, 2014, p. 12).", {"chava_2014"}),
        ("中文文獻常見寫法為（李明，2020）。", {"李明_2020"}),
        ("Seen in (Smith, n.d.) and (Wang, in press).", {"smith_nd", "wang_inpress"}),
    ],
)
def test_citation_keys(spark, told, keys):
    df = spark.createDataFrame([(1, 0, told)], "doc_id long, para_idx long, text string")
    assert {r["key"] for r in match.citations(df).filter("key is not null").collect()} == keys


def test_four_ways(spark):
    body = spark.createDataFrame([(1, 0, "(Li, 2021)"), (2, 0, "(Li, 2020)"), (3, 0, None)], "doc_id long, para_idx long, text string")
    refs = spark.createDataFrame([(1, 0, "Li, M. (2020)."), (2, 0, "Li, M. (2020)."), (2, 1, "Li, X. (2020)."), (4, 0, "")], "doc_id long, pos long, raw string")
    got = {(r["doc_id"], r["key"], r["status"]) for r in match.four_way(body, refs).collect()}
    assert got == {(1, "li_2021", "missing"), (1, "li_2020", "extra"), (2, "li_2020", "ambiguous")}


def test_core_parse(spark):
    given = ["Smith, J., & Lee, K. (2020a). T. J.", "王小明、李華（2019）。題。", "No year at all", "SmithJA(2018) T."]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(given)], "doc_id long, pos long, raw string")
    got = [(r["lang"], r["author1"], r["author2"], r["year"], r["item_idx"]) for r in match.core_references(df).orderBy("pos").collect()]
    assert got == [("en", "Smith", "Lee", "2020a", 0), ("zh", "王小明", "李華", "2019", 1), ("en", "SmithJA", None, "2018", 2)]


def test_rules(spark):
    assert col(spark, rules.is_page_noise, "12", "Journal Of Finance Studies", "Smith, J. (2020)") == [True, True, False]
    assert col(spark, rules.is_plausible_year, "2020", "2999", "n.d.", "x", None) == [True, False, True, False, False]
    assert col(spark, rules.starts_item, "Smith, J. (2020). T", "and more text", "王小明, 2019, 題") == [True, False, True]


def test_split_items(spark):
    pasted = [
        ("A文獻\nB文獻\n\nC文獻", 3),
        ("Aaa, A. (2019). First line...\nline2...\n\nBbb, B. (2020). First line...\nline2...\n\nCcc, C. (2018). First line...", 3),
        ("Aaa, A. (2019). ... Ccc.\nBbb, B. (2020). ... Ddd.\nEee, E. (2018). ... Fff.", 3),
        ("Unknown author. Title without year. Journal, 1, 1-2.", 1),
        ("Aaa, A. (2019). T1. Bbb, B. (2020). T2.", 2),
        ("Kim, Y., M. S. Park, and B. Wier. 2012. Is it so? The Review 87, 761-796.", 1),
        ("Cole, C. (1986). Old news. Journal 1, 209-249 Dunn, A. and Eck, C. (1987). New news.", 2),
        ("Gay, G. (2020).\n Title, 10,\n21-40.", 1),
        ("王小明(2019)。題一。\n李華(2020)。題二。", 2),
        ("", 0),
        (None, 0),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pasted)], "i int, v string")
    got = {r["i"]: r["x"] for r in df.select("i", items.reference_items(F.col("v")).alias("x")).collect()}
    assert [len(got[i]) for i in range(len(pasted))] == [n for _, n in pasted]
    assert got[7] == ["Gay, G. (2020). Title, 10, 21-40."]


def test_functions_by_name(spark):
    items.register(spark)
    spark.createDataFrame([("Ｌｉ ①", "Müller", "Muller")], "t string, a string, b string").createOrReplaceTempView("told")
    assert tuple(spark.sql("SELECT nfkc(t), similar_names(a, b), reference_start_places('Li, M. (2020). T.') FROM told").first()) == ("Li 1", True, [0])


def test_folds(spark):
    lines = spark.createDataFrame([(1, 0, "Smith, J. (2020). A long"), (1, 1, "title. Journal."), (1, 2, "Lee, K. (2019). T.")], "doc_id long, line_idx long, text string")
    assert segment.assemble_items(lines, ["line_idx"]).first()["items"] == [("Smith, J. (2020). A long title. Journal.", 0), ("Lee, K. (2019). T.", 0)]
    paras = spark.createDataFrame([(1, 0, "Seen (Smith", 1), (1, 1, "2020) here.", 2), (1, 2, "know-", 2), (1, 3, "ledge.", 3)], "doc_id long, para_idx long, text string, page int")
    assert [tuple(m) for m in segment.merge_paragraphs(paras).first()["merged"]] == [("Seen (Smith 2020) here.", 1), ("knowledge.", 2)]


def test_spans(spark):
    told = "As Baier and Chava (2014) and (Smith, n.d.; Wang & Li, 2020a) 根據李明等(2015)指出 (Table 3, 2014)"
    known = spark.createDataFrame([(1, 0, "en", "Roll, A.", "2001"), (1, 1, "en", "Roll", "2001"), (1, 2, "en", "Wang", "2020a"), (2, 0, "en", "Roll", "2001")], "doc_id long, item_idx int, lang string, author1 string, year string")
    paras = spark.createDataFrame([(1, 0, told, 3), (1, 1, "See the list (as in Roll 2001 and", 4), (1, 2, "Wang 2020a in part) here.", 5), (1, 3, None, None)], "doc_id long, para_idx long, text string, page int")
    rows = spans.first_of_each(spans.citations_in(paras, known)).orderBy("para_idx", "seq").collect()
    assert [tuple(r[c] for c in ("para_idx", "page", "lang", "author1", "author2", "year")) for r in rows] == [
        (0, 3, "en", "Baier", "Chava", "2014"), (0, 3, "zh", "李明", None, "2015"), (0, 3, "en", "Smith", None, "n.d."), (0, 3, "en", "Wang", "Li", "2020a"),
        (1, 4, "en", "Roll", None, "2001"), (1, 4, "en", "Wang", None, "2020a"),
    ]
    assert rows[0]["context"].startswith("...As Baier and Chava (2014)") and rows[0]["raw"] == "As Baier and Chava (2014)"
    assert spans.citations_in(paras).count() == 4


def test_analysis(spark):
    def paras(doc, *texts):
        return [(doc, i, t, 1 + i // 3) for i, t in enumerate(texts)]

    rows = paras(1, "Work by Roll, Fama and Vega (2001) and (Li, 2020).", "(Nash, 1999) is missing, (Baier, 2014) is there.", "References", "Fama, E., & Vega, C. (2001). A long title that is", "wrapped over lines. Journal, 1.", "Li, M. (2020). T.", "Notes on Baier of 2014", "12", "Xu, Q. (2019). U.", "Appendix", "Nothing more.")
    rows += paras(2, "No list here (Li, 2020).") + paras(3, "Own (Li, 2020).", "References", "Xu, Q. (2019). U.") + paras(4, "Also (Li, 2020).")
    df = spark.createDataFrame(rows, "doc_id long, para_idx long, text string, page int")
    mine = spark.createDataFrame([(3, 0, "Li, M. (2020). T."), (3, 1, "unreadable"), (4, 0, "Li, M. (2020). V.")], "doc_id long, pos long, raw string")
    out = analysis.analyse(df)
    assert sorted(map(tuple, out.summary.collect())) == [(1, 2, 3, 4, 3, 1, 1), (3, 1, 1, 1, 0, 1, 1)]
    kinds = {(r["author1"], r["match_type"], r["ref_page"]) for r in out.matched.collect() if r["doc_id"] == 1}
    assert kinds == {("Work by Roll", "Context Recovery", 2), ("Li", "Exact", 2), ("Baier", "Found in Raw Text (Parser Missed)", 0)}
    assert [(r["author1"], r["page"]) for r in out.missing.collect() if r["doc_id"] == 1] == [("Nash", 1)] and [tuple(r) for r in out.errors.orderBy("doc_id").collect()] == [(2, "REFERENCE_SECTION_NOT_FOUND"), (4, "REFERENCE_SECTION_NOT_FOUND")]
    given = analysis.analyse(df, mine)
    assert sorted(map(tuple, given.summary.collect()))[1:] == [(3, 1, 1, 1, 1, 0, 0), (4, 1, 1, 1, 1, 0, 0)] and [r[0] for r in given.errors.collect()] == [2]
    assert {(r["doc_id"], r["reference_source"], r["warning"]) for r in given.sources.collect()} == {(1, "auto_extracted", None), (3, "user_override", "partial"), (4, "user_override", None)}


def test_similar(spark):
    df = spark.createDataFrame([("Jensen", "Jenson"), ("Li", "Lu"), ("Baier", None)], "a string, b string")
    assert [r[0] for r in df.select(text.similar(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_suffixes(spark):
    refs = spark.createDataFrame([(1, i, r) for i, r in enumerate(["Li, M. (2020). B.", "Li, M. (2020). A.", "No year", "Al, B. (2019). C."])], "doc_id long, pos long, raw string")
    got = [r["text"] for r in biblio.sort_bibliography(refs).orderBy("ord").collect()]
    assert got == ["Al, B. (2019). C.", "Li, M. (2020a). A.", "Li, M. (2020b). B.", "No year"]


def test_two_columns(spark):
    w = [(1, 1, 0, "r", 380.0, 460.0, 100.0), (1, 1, 1, "l", 10.0, 200.0, 300.0), (1, 1, 2, "head", 100.0, 500.0, 10.0)]
    df = spark.createDataFrame([(*x, x[6] + 10, 600.0, 800.0) for x in w], "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, page_width double, page_height double")
    assert layout.page_text(df).first()["text"] == "head l r"


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    paras, bad = files.read_documents(spark, str(tmp_path))
    assert [(r["para_idx"], r["text"]) for r in paras.orderBy("para_idx").collect()] == [(0, "One\ttwo"), (1, "")]
    assert [r["code"] for r in bad.collect()] == ["PARSE_ERROR"]
    book = files.workbook({"summary": spark.createDataFrame([(1, "x<y")], "n int, t string")}, "en")
    assert b"x&lt;y" in zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml")


def test_year_in_place(spark):
    df = spark.createDataFrame([("X ( 2020 ) and (2020)", "2020", "a"), ("X. 2020. T", "2020", "b"), ("none", "2020", "")], "t string, y string, s string")
    assert [r[0] for r in df.select(text.put_year(F.col("t"), F.col("y"), F.col("s"))).collect()] == ["X (2020a) and (2020)", "X. (2020b). T", "none"]
    assert [tuple(r[0]) for r in df.select(cites.title_and_source(F.lit(". T. S, 1."))).limit(1).collect()] == [("T", "S, 1.")]


def test_places_of_texts(spark):
    items = spark.createDataFrame([(1, 0, "Li, M. (2020). A."), (1, 1, "absent"), (1, 2, "Li, M. (2020). A."), (1, 3, "Xu, Q. (2019). A long title that stays, but other"), (2, 0, "x"), (1, 4, "")], "doc_id long, pos long, text string")
    block = spark.createDataFrame([(1, "Li, M. (2020). A.\nLi, M. (2020). A.\nXu, Q. (2019). A long title that stays."), (3, "x")], "doc_id long, text string")
    got = [(r["pos"], r["start"], r["end"], r["found"]) for r in metrics.locate_spans(items, block).orderBy("pos").collect()]
    assert got == [(0, 0, 17, "exact"), (1, 17, 17, "none"), (2, 18, 35, "exact"), (3, 36, 75, "head"), (4, 75, 75, "none")]


def test_means_coverage_and_rules(spark):
    scores = spark.createDataFrame([(1, 1.0, 0.5, 0.6)], "doc_id long, precision double, recall double, f1 double")
    assert metrics.averages(scores).first().asDict() == {"cases": 1, "precision": 1.0, "recall": 0.5, "f1": 0.6}
    assert metrics.averages(scores.limit(0)).first()["f1"] is None
    keys = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, None)], "doc_id long, key string")
    assert sorted(map(tuple, metrics.key_coverage(keys).collect())) == [(1, 4, 2, 1, 0.5), (2, 1, 0, 0, 0.0)]
    status = spark.createDataFrame([(1, "a", "matched"), (1, "a", "missing"), (1, "b", "extra")], "doc_id long, key string, status string")
    assert [tuple(r) for r in metrics.key_rules(status).collect()] == [(1, 2, 1)]


def test_similar_names(spark):
    pairs = [("Müller", "Muller", True), ("Li", "li", True), ("Li", "Lee", False), ("", "x", False), ("Schlick", "Schlik", True), ("Baier", "Young", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(text.similar(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_strokes_and_markdown(spark, tmp_path):
    files.write_strokes(spark.createDataFrame([("李", 7), ("丁", 2)], "ch string, n int"), str(tmp_path / "s"))
    (tmp_path / "t.json").write_text('{"李": "7", "王": "x", "丁": 2, "木": "4.5"}', encoding="utf-8")
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"丁":2,"李":7}'
    assert sorted(map(tuple, files.load_strokes(spark, str(tmp_path / "t.json")).collect())) == [("丁", 2), ("李", 7)]
    files.write_markdown(spark.createDataFrame([(2, "a|b"), (1, None)], "n int, t string"), "T", str(tmp_path / "m"))
    lines = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    assert lines == ["# T", "", "| n | t |", "| --- | --- |", "| 1 |  |", "| 2 | a\\|b |"]
