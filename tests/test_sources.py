"""Recordings of a folder through listing and scan, and the checks of assembled shards."""

import json

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, In

from tremolo.operators import extraction
from tremolo.sources import files, recordings


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two classes of recordings: some without a mask, some without an annotation, and files of other kinds."""
    top, r = tmp_path_factory.mktemp("recordings"), np.random.default_rng(2)
    truth = {}
    for c in ("walk", "dig.deep"):
        (top / c).mkdir()
        for k in range(5):
            x, m = r.normal(size=(3, 8 + k)), r.random((4, 3)) > 0.5
            np.savez(top / c / f"rec.{k}.npz", data=x, other=np.zeros(2))
            if k != 3:
                np.save(top / c / f"rec.{k}.npy", m)
            if k % 2:
                (top / c / f"rec.{k}.json").write_text(json.dumps({"curve1": k}))
            truth[c, f"rec.{k}"] = (x, m, json.dumps({"curve1": k}) if k % 2 else None)
        np.save(top / c / "lonely.npy", np.zeros((1, 1)))
        (top / c / "notes.txt").write_text("x")
    return f"file://{top}", truth


def test_recordings(spark, folder):
    root, truth = folder
    got = {(r.folder, r.stem): r for r in files.recordings(spark, root).collect()}
    assert set(got) == {k for k in truth if k[1] != "rec.3"}
    for k, r in got.items():
        x, m, text = truth[k]
        assert np.array_equal(np.array(r.data), x) and np.array_equal(np.array(r["mask"]), m) and r.annotation == text and r.has_json == (text is not None)


def test_only_the_kinds_asked_for_are_read(spark, folder):
    root, _ = folder
    df = files.recordings(spark, root, columns=("mask",))
    assert df.columns == ["folder", "stem", "has_json", "mask"] and df.count() == 8
    plan = files.recordings(spark, root, columns=())._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and files.recordings(spark, root, columns=()).count() == 8


def test_a_folder_without_recordings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert files.recordings(spark, f"file://{tmp_path}", columns=()).count() == 0


def test_assembled_shards_are_checked(spark):
    shards = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "sample_id string, chunk int")
    want = lambda *rows: spark.createDataFrame(rows, "chunk int, n long")
    assert extraction.assemble(shards, want((1, 2), (2, 1)), rows="n").count() == 3
    with pytest.raises(ValueError, match="no shard holds chunk 3"):
        extraction.assemble(shards, want((1, 2), (3, 1)))
    with pytest.raises(ValueError, match="chunk 1 has 2 rows, not 5"):
        extraction.assemble(shards, want((1, 5), (2, 1)), rows="n")
    with pytest.raises(ValueError, match="several rows hold sample_id a"):
        extraction.assemble(shards.union(shards.filter("sample_id = 'a'")), want((1, 3), (2, 1)), rows="n")


def test_recordings_in_splits(spark, folder):
    """Splits of one file and of few bytes give what one split gives; a split holds recordings of one folder."""
    root, _ = folder
    whole = sorted(map(tuple, recordings.scan(spark, root, ("folder", "stem", "annotation")).collect()))
    few = recordings.scan(spark, root, ("folder", "stem", "annotation"), splitFiles="1")
    assert few.rdd.getNumPartitions() == 8 and sorted(map(tuple, few.collect())) == whole
    assert recordings.scan(spark, root, ("folder", "mask"), splitBytes="1").rdd.getNumPartitions() == 8
    assert recordings.scan(spark, root, ("folder",)).rdd.getNumPartitions() == 2


def _reader(root, columns="folder string, mask array<array<boolean>>", **more):
    from pyspark.sql.types import _parse_datatype_string

    return recordings.PruningReader(_parse_datatype_string(columns), {"path": root, **more})


def test_filters_prune_folders(spark, folder):
    root, _ = folder
    r = _reader(root)
    rest = [EqualTo(("stem",), "rec.1"), In(("folder",), ("walk", "run"))]
    assert list(r.pushFilters(rest)) == rest[:1] and {s.path.rsplit("/", 1)[-1] for s in r.partitions()} == {"walk"}
    assert list(r.pushFilters([EqualTo(("folder",), "dig.deep")])) == [] and [s.stems for s in r.partitions()] == [[]]
    assert {s.path.rsplit("/", 1)[-1] for s in _reader(root, folders='["dig.deep"]').partitions()} == {"dig.deep"}
    wanted = lambda: [r.stem for r in recordings.scan(spark, root, ("folder", "stem")).filter("folder = 'walk' and stem > 'rec.2'").collect()]
    assert wanted() == ["rec.4"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        assert wanted() == ["rec.4"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_recordings_say_what_is_wrong(spark, folder, tmp_path):
    root, _ = folder
    with pytest.raises(ValueError, match="no column sound"):
        _reader(root, "sound string")
    with pytest.raises(ValueError, match="masks are .npy"):
        _reader(root, data="npy")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.npz").write_bytes(b"no archive")
    np.save(tmp_path / "a" / "x.npy", np.ones((1, 1), bool))
    top = f"file://{tmp_path}"
    assert recordings.scan(spark, top, ("stem", "mask")).collect()[0]["mask"] == [[True]]  # data isn't opened
    with pytest.raises(Exception, match="a/x.npz holds no data"):
        recordings.scan(spark, top).collect()


def test_stored_recordings_come_back(spark, tmp_path):
    top = f"file://{tmp_path}/r"
    rows = [("a", "x.1", [[1.0, 2.0]], [[True], [False]], "{}"), ("a", "y", [[3.0]], None, None), ("b", "x.1", [[4.0]], [[True]], None)]
    df = spark.createDataFrame(rows, "folder string, stem string, data array<array<double>>, mask array<array<boolean>>, annotation string")
    assert recordings.store(df, top) == 3 and recordings.store(df, top) == 3 and recordings.store(df.limit(0), top) == 0
    got = sorted(map(tuple, recordings.scan(spark, top).collect()))
    assert got == [("a", "x.1", True, [[1.0, 2.0]], [[True], [False]], "{}"), ("b", "x.1", False, [[4.0]], [[True]], None)]


def test_manifest_of_tables_in_parts(spark, tmp_path):
    """A table is one file or a folder of parts: a row each, with the rows and columns of all parts."""
    from tremolo.plans import io

    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/parts.parquet")
    spark.range(5).selectExpr("id", "id AS k").repartition(3).write.parquet(f"{tmp_path}/more.parquet")
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/held")
    next((tmp_path / "held").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    got = {r.component: r.version for r in io.src_env(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k.endswith(".parquet")} == {"parts.parquet": "7 x 1", "more.parquet": "5 x 2", "single.parquet": "4 x 1"}
