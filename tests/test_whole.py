"""Queries of selection, balancing and models run, and read all rows and features."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bal_none", "bal_smote", "bal_bsmote", "bal_smotetomek"])
def test_balancing_gives_class_sizes(spark, name):
    got = {r["y"]: r["n"] for r in __spark_entry__.queries()[name](spark, SF).collect()}
    labels = {min(r["label"], 4) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().collect()}  # the labels from 4 on are one class
    assert set(got) == labels and min(got.values()) > 0


@pytest.mark.parametrize("name", ["mdl_dt", "mdl_cnn1d"])
def test_models_predict_every_label(spark, name):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    test = rows.filter("vec_id % 10 >= 8")
    got = __spark_entry__.queries()[name](spark, SF).collect()
    assert sorted(r["id"] for r in got) == sorted(r["vec_id"] for r in test.collect())
    assert {r["y_true"] for r in got} == {str(r["label"]) for r in test.collect()}


@pytest.mark.parametrize("name", ["fs_mrmr", "fs_shap"])
def test_selectors_score_every_feature(spark, name):
    assert {r["feature"] for r in __spark_entry__.queries()[name](spark, SF).collect()} == set(range(64))


@pytest.mark.parametrize("name", ["mdl_dt", "mdl_lr", "mdl_mlp", "mdl_rf", "mdl_et", "mdl_lgbm", "mdl_xgb", "mdl_hgb", "bal_pipe"])
def test_each_test_row_is_predicted_once(spark, name):
    got = __spark_entry__.queries()[name](spark, SF).select("id", "y_true", "y_pred").collect()
    rows = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}
    want = {d: y for d, y in rows.items() if d % 10 >= 8}
    assert len(got) == len(want) and {r["id"]: int(r["y_true"]) for r in got} == want
    assert {int(r["y_pred"]) for r in got} <= set(rows.values())
