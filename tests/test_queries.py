"""Every registered query of the library's own catalog against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

from quirekit.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame):
    def one(v):
        if v is None or pd.isna(v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")):
            return f"{float(v):.6f}"
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        assert normal(got) == normal(con.sql(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_registry_without_the_optional_part(monkeypatch):
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    def absent(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_scores_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    from quirekit.sources import fixtures

    monkeypatch.setattr(fixtures, "PER_TASK", 100)
    items = fixtures.table(spark, sf_dir, "lineitem")
    met = fixtures.scores(spark, sf_dir, "a").select("doc_id", "page_no")
    assert met.rdd.getNumPartitions() == -(-items.count() // 100)  # shares of 100 rows, however many there are
    assert met.count() == met.distinct().count() == items.select("l_orderkey", "l_linenumber").distinct().count()
