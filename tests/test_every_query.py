"""Every registered query runs; where there is SQL, it gives the same rows."""

import duckdb
import pytest

from tremolo.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Fits of many models: minutes each.  ``test_learning`` and ``test_whole`` cover what they call.
LONG = {n for n in catalogue.queries() if n.startswith("mdl_") and n not in catalogue.oracle_sql()} | {"fs_votes", "fs_rfe", "fs_boruta", "fs_curve", "fs_bias", "bal_pipe"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_its_sql(spark, duck, name):
    got, sql = catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name]
    columns = sorted(got.columns)
    assert columns == sorted(duck.sql(sql).columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - LONG))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
