"""The source divergence audit against plain loops and its SQL."""

import re
from collections import Counter

import brute
import duckdb
import pytest

import tremolo.llm.source_divergence as divergence
from tremolo.llm import catalogue
from tremolo.llm.source_divergence import source_divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def audit(rows, min_docs):
    """Every group and term by plain loops."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.AZ))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, t) for k, s, t in docs if k == lang]
        df = Counter(w for _, t in mine for w in set(t))
        kept = [w for w in df if df[w] >= min_docs]
        whole, by = Counter(), {s: Counter() for s, _ in mine}
        for s, t in mine:
            for w in t:
                if df[w] >= min_docs:
                    whole[w] += 1
                    by[s][w] += 1

        def p(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in by:
            pair = [(-sum(f(p(by[s], w), p(by[o], w)) for w in kept), o) for o in by if o != s]
            term = [(-f(p(by[s], w), p(whole, w)), w) for w in kept if by[s][w] and p(by[s], w) > p(whole, w)]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return out


def got(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_equals_plain_loops(spark, min_docs):
    """Null lang, source and text, empty and long texts, repeated rows, clashing columns."""
    assert brute.same(got(source_divergence(brute.table(spark), min_docs)), audit(brute.documents(), min_docs))


def test_small_blocks_and_tables(spark, monkeypatch):
    """A hot language in many blocks, flushed in many tables, ties included."""
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 7)
    monkeypatch.setattr(divergence, "KEPT_ROWS", 40)
    rows = brute.documents() + [(i, f"same words for everyone plus w{i % 5} É é", "en", f"s{i % 4}", 1) for i in range(60)]
    assert brute.same(got(source_divergence(brute.table(spark, rows), 2)), audit(rows, 2))


def test_no_rows_and_no_terms(spark):
    assert source_divergence(brute.table(spark, [])).count() == 0
    rows = [(1, None, None, None, 1), (2, "12 !!", "", "b", 1), (3, "few words", None, "c", 1)]
    want = audit(rows, 10)
    assert brute.same(got(source_divergence(brute.table(spark, rows))), want) and {r[4] for r in want} == {0} and len(want) == 6


def test_runs_cluster_equal_counts(spark):
    """Terms with equal counts lie together: a column has far fewer runs than the vocabulary has terms."""
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "xyz" if (ord(a) + i) % 2), "en", f"s{i % 2}", 1) for i in range(40)]
    runs = divergence.run_columns(divergence.term_vectors(brute.table(spark, rows)))
    assert runs.filter("source is not null").count() == 2 and runs.filter("source is null").collect()[0]["length"] == 24


def test_large_counts(spark):
    """10^9 times a count leaves 64 bits."""
    t = spark.createDataFrame([(10**14, 3 * 10**14)], "k long, d long")
    assert t.select(divergence.weight("k", "d").alias("p")).first()["p"] == 1 + 10**9 * (10**14 + 2) // (3 * 10**14)


def test_equals_its_sql(spark, tmp_path):
    brute.table(spark).select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({catalogue.oracle_sql()['op11_source_divergence']})").fetchall()
    assert brute.same(got(catalogue.queries()["op11_source_divergence"](spark, str(tmp_path))), want)
