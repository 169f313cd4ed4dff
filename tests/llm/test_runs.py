"""Periodic runs against plain loops and their SQL."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest

import tremolo.llm.periodic_runs as periodic
from tremolo.llm import catalogue
from tremolo.llm.periodic_runs import lag_scan, periodic_runs, repeat_tails, stable_segments

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def runs(w, least=6, repeats=4):
    """All maximal stretches of every period, longest first shifts excluded by trying every smaller period."""
    out, n = [], len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(least, repeats * q) and not any(all(w[k] == w[k + s] for k in range(i, j + q - s)) for s in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(rows):
    out = []
    for d, text, *_ in rows:
        w = tail(d, brute.words(text))
        if len(w) > 3000:
            found = [(0, len(w), 1)] if len(set(w)) == 1 else []
        else:
            found = runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))))
    return out


def texts(seed):
    """Words of few kinds, with planted runs of several periods, overlaps and runs inside runs."""
    r = random.Random(seed)
    for i in range(150):
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice("abxyz") for _ in range(r.choice([1, 1, 2, 3, 5, 9]))]
            if r.random() < 0.3:
                unit = unit * r.choice([3, 4, 6]) + [r.choice("abx")]
            at = r.randint(0, len(w))
            w[at:at] = (unit * 9)[: r.randint(len(unit), 7 * len(unit))]
        yield i, " ".join(w)


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (3, 3), (12, 5)])
def test_equals_plain_loops(spark, least, repeats):
    rows = [(i, t, None, None, 1) for i, t in texts(least)]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed_text, r.n_words) for r in periodic_runs(brute.table(spark, rows), least, repeats).collect()}
    found = 0
    for i, t, *_ in rows:
        want = runs(t.split(), least, repeats)
        assert got[i] == (want, collapsed(t.split(), want), len(t.split()))
        found += len(want)
    assert found > 100


def test_query_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; planted tails."""
    rows = brute.documents() + [(i, t, None, None, 1) for i, t in texts(3)]
    brute.table(spark, rows).select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in catalogue.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    want = digest(rows)
    assert brute.same(got, want)
    short = [r for r in rows if r[0] != 406]  # SQL pairs equal words, so not 20,000 of them
    brute.table(spark, short).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/short.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/short.parquet/*.parquet'")
    sql = c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({catalogue.oracle_sql()['op13_periodic_runs']})").fetchall()
    assert brute.same(sql, digest(short))


def test_tails(spark):
    rows = brute.documents()
    got = [(r.doc_id, tuple(brute.words(r.text))) for r in repeat_tails(brute.table(spark, rows)).collect()]
    assert brute.same(got, [(d, tuple(tail(d, brute.words(t)))) for d, t, *_ in rows])


def test_no_rows(spark):
    assert periodic_runs(brute.table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="three times"):
        periodic_runs(brute.table(spark, []), repeats=2)


def test_splitting_is_stable_and_its_bound_changes_nothing(monkeypatch):
    """Every word of what is left is frequent there; without splitting the scan finds the same runs."""
    r = np.random.default_rng(5)
    ids = np.concatenate([np.tile(r.integers(0, 6, r.integers(1, 9)), r.integers(1, 8)) if r.random() < 0.5 else r.integers(0, 900, 30) for _ in range(200)])
    first = np.array([0, len(ids) // 3, len(ids) // 3, len(ids)])
    segments = stable_segments(ids, first)
    assert len(segments) and all(np.unique(ids[s:e], return_counts=True)[1].min() >= 4 and e - s >= 6 for s, e in segments)
    assert (segments[:, 1] - segments[:, 0]).sum() < len(ids)
    whole = sorted(lag_scan(ids, segments))
    monkeypatch.setattr(periodic, "ROUNDS", 0)
    assert sorted(lag_scan(ids, stable_segments(ids, first))) == whole


def test_a_long_hot_text_is_fast():
    """One word 300,000 times: every lag would match; the run of period 1 covers them all."""
    import time

    ids = np.zeros(300_000, np.int64)
    began = time.time()
    assert lag_scan(ids, stable_segments(ids, np.array([0, len(ids)]))) == [(0, 300_000, 1)]
    assert time.time() - began < 60


def test_steps_give_what_whole_batches_give(spark, monkeypatch):
    rows = [(i, t, None, None, 1) for i, t in texts(9)]
    whole = {r.doc_id: r for r in periodic_runs(brute.table(spark, rows)).collect()}
    monkeypatch.setattr(periodic, "STEP", 50)
    assert {r.doc_id: r for r in periodic_runs(brute.table(spark, rows)).collect()} == whole
