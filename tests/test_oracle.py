"""Every query of the library against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as e
from millrace import queries as core

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.sql(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype != want[c].dtype and str(want[c].dtype) != "object" and "datetime" not in str(want[c].dtype):
            want[c] = want[c].astype(got[c].dtype)
        if "date" in str(want[c].dtype) or c.endswith("date"):
            got[c], want[c] = got[c].astype(str), want[c].astype(str).str.replace(" 00:00:00", "")
            got[c] = got[c].str.replace(" 00:00:00", "")
    assert rows(got) == rows(want)


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


ORDERED = {  # columns that a report is ordered by, and whether downwards
    "top_products": [("total_revenue", True), ("product_name", False)], "daily_revenue": [("sale_date", True)],
    "product_categories": [("product_name", False), ("category_name", False)],
    "product_categories_primary_first": [("product_name", False), ("is_primary", True), ("category_name", False)], "list_tables": [("table_name", False)],
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_reports_keep_their_order(spark, name):
    rows = core.QUERIES[name](spark, SF).collect()
    for column, down in reversed(ORDERED[name]):  # sorting is stable, so least significant first
        rows_sorted = sorted(rows if column == ORDERED[name][-1][0] else rows_sorted, key=lambda r: r[column], reverse=down)  # noqa: F821
    key = lambda r: tuple(r[c] for c, _ in ORDERED[name])
    assert [key(r) for r in rows] == [key(r) for r in rows_sorted]
