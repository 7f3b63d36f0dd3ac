"""Missing values, several files and unlucky column names."""

import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruptura.operators import neighbors, ood, split, stats
from ruptura.sources import ood_store, results, seeds, tables


def test_columns_that_look_internal_survive(spark):
    df = spark.createDataFrame([("1", "x", "2")], ["_cost", "_candidate", "_c3"])
    assert results.clean_results(df).columns == ["_cost", "_candidate"]


def test_rows_without_group_are_on_one_side(spark):
    df = spark.createDataFrame([(None if k % 3 == 0 else f"g{k % 7}", k) for k in range(60)], "g string, k int")
    cut = split.group_holdout(df, "g", 0.3, 1)
    test, train = cut.test(df), cut.train(df)
    assert test.count() + train.count() == 60
    assert 20 in (test.where("g is null").count(), train.where("g is null").count())


def test_missing_parts_of_a_group_key_differ(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, 2.0, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(split.group_key(["a", "b", "c"])).collect()] == ["1.0-nan-2.0", "1.0-2.0-nan"]


def test_moments_use_complete_rows(spark):
    rows = [(1.0, 2.0), (2.0, None), (4.0, 3.0), (6.0, 9.0), (None, 1.0)]
    got = stats.moments(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    whole = np.array([r for r in rows if None not in r])
    assert got.n == 3 and np.allclose(got.cov, np.cov(whole.T))


def test_distances_with_missing_values(spark):
    rows = [(float(k), float(k * k % 7)) for k in range(12)] + [(None, 1.0), (float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    ref = ood.fit_reference(df, ["a", "b"])
    filled = np.array([[0.0 if x is None or np.isnan(x) else x for x in r] for r in rows])
    assert np.allclose(ref.mean, filled.mean(axis=0))
    assert all(np.isfinite(r[0]) for r in df.select(ood.mahalanobis(ref)).collect())


def test_neighbours_with_missing_values(spark):
    known = spark.createDataFrame([(k, float(k), float("nan") if k == 3 else 1.0) for k in range(10)], "row_index long, a double, b double")
    asked = spark.createDataFrame([(0, float("nan"), 1.0), (1, None, None)], "candidate_id long, a double, b double")
    got = neighbors.nearest_neighbors(asked, known, ["a", "b"], 2).collect()
    assert sorted((r["candidate_id"], r["rank"], r["row_index"]) for r in got) == [(0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 2, 1)]


def test_seeds_of_a_folder_are_numbered(spark, tmp_path):
    for name, count in (("a", 3), ("b", 4), ("c", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"seeds": [{"composition": {"C": 0.1}}] * count}))
    assert sorted(r["seed_id"] for r in seeds.read_seeds(spark, str(tmp_path)).collect()) == list(range(1, 9))


def test_unparsable_sources_are_named_and_others_raise(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no table")
    spark.range(3).write.parquet(str(tmp_path / "good.parquet"))
    paths = [str(tmp_path / "bad.parquet"), str(tmp_path / "good.parquet")]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert tables.first_available(spark, paths, lambda s, p: s.read.parquet(p)).count() == 3
    assert any("bad.parquet" in str(w.message) for w in said)

    def refuse(spark, path):
        raise PermissionError(path)

    with pytest.raises(PermissionError):
        tables.first_available(spark, paths, refuse)


def test_payload_keeps_its_scale(spark):
    row = [([1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]], ["C", "Cr"], 3.0, [0.5, 2.0])]
    df = spark.createDataFrame(row, "mean array<double>, cov_inv array<array<double>>, features array<string>, threshold double, std array<double>")
    assert ood_store.reference_from_payload(df).std == (0.5, 2.0)
    assert ood_store.reference_from_payload(df.drop("std")).std == (1.0, 1.0)
    assert df.select(F.size("std")).first()[0] == 2
