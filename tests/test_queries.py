"""Every registered query with SQL against DuckDB on the smallest tables; the others must run and keep their schema."""
import duckdb
import pandas as pd
import pytest

from domframe.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if type(v).__name__.startswith("float"):
            return str(int(v)) if v == int(v) else f"{v:.5f}"
        return str(v)

    out = [tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(out)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_against_sql(spark, duck, name):
    q = QUERIES[name]
    got, want = q.plan(spark, SF).toPandas(), duck.sql(q.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # integer columns with nulls
        if want[c].dtype.kind == "f" and got[c].dtype.kind == "f":
            got[c], want[c] = got[c].round(5) + 0.0, want[c].round(5) + 0.0
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    df = QUERIES[name].plan(spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_visuals_of_all_nodes(spark):
    """Every node of the page is checked and blended, text nodes and deep ones too."""
    nodes = QUERIES["dom_xpath"].plan(spark, SF).select("page_id", "xpath")
    known = nodes.where("xpath not in ('/html', '/html/body', '/html/body/article')")
    found = QUERIES["visuals_mismatches"].plan(spark, SF)
    assert known.exceptAll(found.where("problem = 'no visuals'").select("page_id", "xpath")).count() == 0
    assert nodes.exceptAll(QUERIES["visuals_blended"].plan(spark, SF).select("page_id", "xpath")).count() == 0
