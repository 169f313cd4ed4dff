"""The entry points, with and without the subpackage for training data."""

import importlib.util

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(o) > 100
    assert ("op1_language_id" in q) == (importlib.util.find_spec("tremolo.llm") is not None)


def test_without_the_subpackage(monkeypatch):
    found = __spark_entry__._found
    monkeypatch.setattr(__spark_entry__, "_found", lambda m: "llm" not in m and m != "corpus_pipeline" and found(m))
    assert not [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]


@pytest.mark.parametrize("name", ["win_guard", "f_gini", "met_prf", "fs_pearson", "snk_csv", "st_tumble", "st_ring"])
def test_equals_the_oracle(spark, name):
    import duckdb

    got = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = sorted(map(repr, (tuple(r) for r in c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({sql})").fetchall())))
    assert sorted(repr(tuple(r[x] for x in columns)) for r in got.collect()) == want
