import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruptura.constants import SWEEP_DEFAULTS
from ruptura.operators import lmp, metrics, modeling, ood, sweep
from ruptura.plans.ood import OodModel, ood_report
from ruptura.plans.sweeps import as_curves, run_sweep
from ruptura.plans.training import run_lmp_baseline


def creep(spark, n=300, constant=21.3, noise=0.05):
    rng = np.random.default_rng(8)
    temp, stress = rng.uniform(800, 1000, n), rng.uniform(50, 300, n)
    life = 1000 * (33 - 5 * np.log10(stress)) / temp - constant + rng.normal(0, noise, n)
    rows = [(i, i % 12, float(t), float(s), float(y)) for i, (t, s, y) in enumerate(zip(temp, stress, life))]
    return spark.createDataFrame(rows, "id int, g int, temp double, stress double, log_lifetime double"), temp, stress, life


def two_pass(temp, stress, life, grid, degree=1):
    best = None
    for c in grid:
        coef = np.polyfit(np.log10(stress), temp * (c + life) / 1000, degree)
        if degree == 1 and coef[0] >= 0:
            continue
        rmse = np.sqrt(np.mean((1000 * np.polyval(coef, np.log10(stress)) / temp - c - life) ** 2))
        if best is None or rmse < best[0]:
            best = (rmse, c, coef)
    return best


@pytest.mark.parametrize("degree", [1, 2])
def test_lmp_fit_matches_two_pass_fit(spark, degree):
    df, temp, stress, life = creep(spark)
    fit = lmp.fit_lmp(df, degree=degree)
    rmse, c, coef = two_pass(temp, stress, life, lmp.constant_grid(), degree)
    assert fit.c_value == c and 10 < c < 30
    assert np.allclose(fit.coefficients, coef, rtol=1e-6) and fit.train_rmse_log == pytest.approx(rmse, rel=1e-6)
    assert fit.text().count("log10(stress)") == degree


def test_lmp_fit_needs_a_falling_curve(spark):
    df, *_ = creep(spark)
    rising = df.withColumn("log_lifetime", F.log10("stress") * 30)
    with pytest.raises(ValueError):
        lmp.fit_lmp(rising)


def test_group_fits_and_augmentation_stay_inside(spark):
    df, temp, stress, life = creep(spark, 240)
    fits = lmp.fit_lmp_by_group(df, ["g"])
    for r in fits.collect():
        at = np.arange(240) % 12 == r["g"]
        rmse, c, _ = two_pass(temp[at], stress[at], life[at], lmp.constant_grid())
        assert r["c_value"] == c and r["rmse_log"] == pytest.approx(rmse, rel=1e-6) and r["accepted"]
    both, _ = lmp.augment(df, ["g"], 5, max_per_group=7)
    made = both.filter("is_synthetic")
    assert made.count() == 12 * 7 and both.filter("not is_synthetic").count() == 240
    assert lmp.outside_source_bounds(made, fits, ["g"]).count() == 0
    assert sorted(made.select("temp").collect()) == sorted(
        lmp.augment(df.repartition(5), ["g"], 5, max_per_group=7)[0].filter("is_synthetic").select("temp").collect())
    assert lmp.fit_lmp_by_group(df.filter("id < 24"), ["g"]).count() == 0  # groups of two rows are too small


def test_baseline_run(spark):
    df, *_ = creep(spark)
    model = spark.createDataFrame([("rmse_log", 0.01), ("r2_log", 0.999)], "metric string, value double")
    run = run_lmp_baseline(df, "g", model_metrics=model)
    assert run.test_metrics.first()["r2_log"] > 0.95
    gains = {r["metric"]: r["gain"] for r in run.comparison.collect()}
    assert gains["rmse_log"] > 0 and set(gains) == {"rmse_log", "r2_log"}
    assert run.predictions.columns[:2] == ["stress", "temp"]


def test_metrics_and_constant_targets(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row["rmse_log"] == 0.5 and row["mae_log"] == 0.5 and row["r2_log"] is None
    assert metrics.regression_metrics(df, "y", "p", constant_r2=0.0).first()["r2_log"] == 0.0


def test_weight_calibration_takes_the_first_best(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.8), (2.0, 0.0, 1.6)], "y double, b double, r double")
    row = metrics.calibrate_weight(df, "y", "b", "r").first()
    assert row["weight"] == pytest.approx(1.25) and row["rmse"] == pytest.approx(0.0, abs=1e-7)
    flat = df.withColumn("r", F.lit(0.0))
    assert metrics.calibrate_weight(flat, "y", "b", "r").first()["weight"] == 0.0


def reference_rows(spark, n=400):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_index long, a double, b double, c double")
    return df, x


def test_reference_matches_numpy_and_contributions_add_up(spark):
    df, x = reference_rows(spark)
    ref = ood.fit_reference(df, ["a", "b", "c"])
    inverse = np.linalg.pinv(np.cov(x, rowvar=False) + 1e-6 * np.eye(3))
    diff = x - x.mean(axis=0)
    dist = np.sqrt(np.einsum("ij,jk,ik->i", diff, inverse, diff))
    assert np.allclose(ref.cov_inv, inverse) and np.allclose(ref.std, x.std(axis=0))
    assert ref.threshold == pytest.approx(np.quantile(dist, 0.95)) and ref.distance_max == pytest.approx(dist.max())
    cand = df.withColumnRenamed("row_index", "candidate_id").filter("candidate_id < 20")
    model = OodModel(ref, df.select(ood.mahalanobis(ref).alias("ood_distance")), df)
    for r in ood_report(cand, model, k=3, top=2).collect():
        i = r["candidate_id"]
        assert r["ood_distance"] == pytest.approx(dist[i])
        assert r["ood_percentile"] == pytest.approx(100 * (dist <= dist[i] + 1e-12).mean())
        assert r["nearest_neighbors"][0]["row_index"] == i and len(r["nearest_neighbors"]) == 3
        raw = diff[i] * (inverse @ diff[i])
        top = sorted(raw, key=lambda v: -abs(v))[:2]
        assert [c["raw_contribution"] for c in r["ood_top_contributors"]] == pytest.approx(top)
    total = ood.contributions_long(cand, ref, ["candidate_id"]).groupBy("candidate_id").agg(F.sum("raw_contribution").alias("s"))
    assert all(r["s"] == pytest.approx(dist[r["candidate_id"]] ** 2) for r in total.collect())


def test_reference_that_does_not_fit_is_worst(spark):
    df, _ = reference_rows(spark)
    bad = ood.OodReference(("a", "b"), (0.0,), ((1.0,),), (1.0,))
    row = ood.ood_penalty(df, bad).first()
    assert row["ood_penalty"] == 9999.0 and "mean" in row["ood_error"]
    assert ood.ood_penalty(df, None).first()["ood_penalty"] == 0.0
    with pytest.raises(ValueError):
        ood.fit_reference_raw(df.limit(5), ["a", "b"])


def test_sweep_limits_and_grid(spark):
    rows = [(1, None, 5.0, 100.0, 100.0, 0.0, float("inf")), (2, 900.0, 900.0, 0.0, -3.0, -150.0, 873.0)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{p} double" for p in sweep.PARAMS))
    got = {r["id"]: r for r in sweep.sanitize_sweep(df).collect()}
    assert (got[1]["temp_min"], got[1]["temp_max"]) == (5.0, 700.0)
    assert (got[1]["stress_min"], got[1]["stress_max"], got[1]["fixed_stress"]) == (100.0, 101.0, 1.0)
    assert got[1]["fixed_temp"] == SWEEP_DEFAULTS["fixed_temp"]
    assert (got[2]["temp_min"], got[2]["temp_max"], got[2]["stress_min"], got[2]["stress_max"]) == (900.0, 901.0, 1.0, 3.0)

    def scorer(rows):
        return rows.withColumn("predicted_log_life", 5.0 - F.col("temp") / 1000 - F.col("stress") / 1000)

    points = run_sweep(spark.createDataFrame([("p",)], "name string"), {"stress_min": 10.0}, scorer)
    assert points.count() == 80 + 80 + 35 * 35
    curves = {r["sweep"]: r for r in as_curves(points).collect()}
    assert np.allclose(curves["temp"]["temp"], np.linspace(700, 1200, 80))
    assert np.allclose(curves["stress"]["stress"], np.logspace(1, math.log10(600), 80))
    t, s = np.meshgrid(np.linspace(700, 1200, 35), np.logspace(1, math.log10(600), 35))
    assert np.allclose(curves["heatmap"]["temp"], t.ravel()) and np.allclose(curves["heatmap"]["stress"], s.ravel())


def test_permutation_deals_every_value_once(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 2.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    dealt = modeling.permute_columns(df, ["x", "y"], ["id"], 3)
    rows = dealt.collect()
    assert sorted(r["_perm_x"] for r in rows) == sorted(r["x"] for r in rows)
    assert sorted(r["_perm_y"] for r in rows) == sorted(r["y"] for r in rows)
    assert sum(r["_perm_x"] == r["x"] for r in rows) < 10
    again = modeling.permute_columns(df.repartition(3, "y"), ["x", "y"], ["id"], 3)
    assert {(r["id"], r["_perm_x"]) for r in again.collect()} == {(r["id"], r["_perm_x"]) for r in rows}


def test_deals_of_very_many_rows_are_bijections_of_one_rule(spark):
    """Places beyond a billion follow the rule in whole numbers; the products of the old expression overflowed there."""
    n, keys = 2_000_000_000, modeling.deal_keys(5, "x")

    def plain(x):
        for k, a, b in keys:
            other = (k + n - x) % n
            x = other if ((max(x, other) % modeling.DEAL_PRIME + b) ** 2 % modeling.DEAL_PRIME * a % modeling.DEAL_PRIME) >> 7 & 1 else x
        return x

    places = [0, 1, 5, 999_999_999, 1_700_000_000, n - 1]
    df = spark.createDataFrame([(p,) for p in places], "p long")
    got = {r["p"]: r["to"] for r in df.withColumn("to", modeling.dealt_place(F.col("p"), n, keys)).collect()}
    assert got == {p: plain(p) for p in places}


def test_columns_of_several_types_are_dealt(spark):
    rows = [(i, i / 2, f"t{i}", None if i % 3 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, x double, t string, z double")
    dealt = modeling.permute_columns(df, ["x", "t", "z"], ["id"], 3).collect()
    for k, name in enumerate(("x", "t", "z"), 1):
        assert sorted(map(str, (r[f"_perm_{name}"] for r in dealt))) == sorted(str(r[k]) for r in rows)
    assert sorted(tuple(r)[:4] for r in dealt) == sorted(rows)


def test_checks_look_for_all_quantiles_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(900.0 + k, 50.0 + k % 7, 4.0 - k / 100) for k in range(60)], "temp double, stress double, log_lifetime double")
    scorer = lambda df: df.withColumn("predicted_log_life", 9.0 - F.col("temp") / 200 - F.col("stress") / 100)
    calls, plain = [], modeling.exact_quantiles
    monkeypatch.setattr(modeling, "exact_quantiles", lambda *a, **k: calls.append(a[1:]) or plain(*a, **k))
    got = modeling.physics_checks(scorer(rows), scorer, ["temp", "stress"], "log_lifetime")
    assert len(calls) == 1
    assert abs(got["temperature_sweep_slope"] + 1 / 200) < 1e-9 and abs(got["stress_sweep_slope_at_high_temp"] + 1 / 100) < 1e-9


def test_residual_ensemble_improves_and_reloads(spark, tmp_path):
    df, *_ = creep(spark, 300)
    rows = df.withColumn("log_lifetime", F.col("log_lifetime") + F.when(F.col("g") > 6, 0.8).otherwise(-0.8)).withColumn("g", F.col("g").cast("double"))
    split = rows.randomSplit([0.7, 0.3], 1)
    settings = modeling.ForestSettings(n_trees=5, depth=3)
    model = modeling.fit_residual_ensemble(split[0], split[1], None, ["temp", "stress", "g"], forest=settings)
    scored = model.score(split[1])
    base = metrics.regression_metrics(scored, "log_lifetime", "base_log_lifetime").first()["rmse_log"]
    full = metrics.regression_metrics(scored, "log_lifetime", "predicted_log_life").first()["rmse_log"]
    assert full < base and scored.filter("residual_uncertainty_log < 0").count() == 0
    model.save(str(tmp_path / "m"))
    again = modeling.ResidualEnsemble.load(str(tmp_path / "m")).score(split[1], members=False)
    a = [r[0] for r in scored.orderBy("id").select("predicted_log_life").collect()]
    b = [r[0] for r in again.orderBy("id").select("predicted_log_life").collect()]
    assert np.allclose(a, b)
    # The members of a row are what the trees predict one by one.
    inputs = modeling._residual_inputs(modeling._base_inputs(split[1], model.scaler, model.features), model.base)
    leaves = model.forest.setPredictionCol("").setLeafCol("_leaves").transform(inputs)
    rows = leaves.select("_inputs2", model._members(modeling.vector_to_array("_leaves")).alias("m")).limit(40).collect()
    assert all(np.allclose(r["m"], [tree.predict(r["_inputs2"]) for tree in model.forest.trees]) for r in rows)
