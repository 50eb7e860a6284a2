"""Journal numbers of larger tables look like years (1000 to 2999); they must not be read as such."""

import os

import duckdb
import pytest

from refloom.functions import cites, rules
from refloom.operators import match
from refloom.plans.registry import QUERIES
from refloom.plans.sql import SQL

D = "/root/testdata/sf0.001"
OVER_REFERENCES = "authors_list bibliography_sort core_reference_parse document_uncited exact_match".split()


@pytest.fixture(scope="session")
def numbered(tmp_path_factory):
    """A few customers of the small tables, their supplier keys spread over 1000 to 2999."""
    folder, con = str(tmp_path_factory.mktemp("numbered")), duckdb.connect()
    shifted = "SELECT * REPLACE (1000 + (l_orderkey * 7 + l_linenumber * 370) % 2000 AS l_suppkey)"
    con.execute(f"COPY (FROM '{D}/orders.parquet' WHERE o_custkey < 40) TO '{folder}/orders.parquet'")
    con.execute(f"COPY ({shifted} FROM '{D}/lineitem.parquet' WHERE l_orderkey IN (SELECT o_orderkey FROM '{folder}/orders.parquet')) TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (FROM '{D}/part.parquet') TO '{folder}/part.parquet'")
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS FROM '{os.path.join(folder, t)}.parquet'")
    return folder, con


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", OVER_REFERENCES)
def test_same_rows(spark, numbered, name):
    folder, con = numbered
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.execute(SQL[name]).df())


def test_bare_years_are_an_option(spark):
    given = [(0, "Vega, A. Working notes. red plate. Journal 1695."), (1, "Lee, K. (n.d.). Notes. Journal 1999."), (2, "王小明, 2019, 題"), (3, "李明（1999）。題. Journal 1695.")]
    df = spark.createDataFrame([(1, *g) for g in given], "doc_id int, pos int, raw string")
    found = lambda bare: [(r["pos"], r["year"]) for r in match.core_references(df, bare).orderBy("pos").collect()]
    assert found(True) == [(0, "1695"), (1, "n.d."), (2, "2019"), (3, "1999")] and found(False) == [(1, "n.d."), (3, "1999")]
    one = lambda f: [r["x"] for r in df.orderBy("pos").select(f(df["raw"]).alias("x")).collect()]
    assert one(lambda c: cites.split_year(c, False)["year"]) == [None, None, None, "1999"]
    assert one(lambda c: cites.split_year(c)["year"]) == [None, "1999", "2019", "1999"]
    assert one(lambda c: rules.starts_item(c)) == [True, True, True, True] and one(lambda c: rules.starts_item(c, False)) == [True, True, False, False]
