"""Rank index, deals, leaf tables and fits at few constants against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruptura.operators import lmp, modeling, pareto, ranks, stats


@pytest.mark.parametrize("block", [65_536, 7])
def test_rank_index_counts_like_a_sorted_list(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(ranks, "BLOCK_VALUES", block)
    rng = np.random.default_rng(3)
    values = np.where(np.arange(900) % 3 == 0, 2.5, np.round(rng.normal(0, 3, 900), 2))
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    kept = ranks.save_rank_index(rows, "x", str(tmp_path / "ranks"))
    assert kept.total() == 900
    asked = [float(v) for v in values[:40]] + [-99.0, 99.0, 2.5, 2.49, float("inf"), float("-inf"), None, float("nan")]
    table = spark.createDataFrame(list(enumerate(asked)), "id int, y double").withColumn("n", F.lit("kept"))
    for index in (kept, ranks.load_rank_index(spark, str(tmp_path / "ranks"))):
        got = {r["id"]: r["below"] for r in ranks.at_or_below(table, index, "y", "below").collect()}
        assert got == {i: None if y is None or np.isnan(y) else int((values <= y).sum()) for i, y in enumerate(asked)}
    assert ranks.at_or_below(table, kept, "y", "below").columns == ["id", "y", "n", "below"]


def test_rank_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(None,)], "x double")
    index = ranks.save_rank_index(none, "x", str(tmp_path / "ranks"))
    table = spark.createDataFrame([(1.0,), (None,)], "y double")
    assert [r[0] for r in ranks.at_or_below(table, index, "y", "below").select("below").collect()] == [0, None]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 999])
def test_deals_are_bijections_that_differ_by_column(spark, n):
    places = spark.range(n).select(*[modeling.dealt_place(F.col("id"), n, modeling.deal_keys(7, c)).alias(c) for c in "ab"]).toPandas()
    assert sorted(places["a"]) == sorted(places["b"]) == list(range(n))
    if n > 40:
        assert (places["a"] == places["b"]).mean() < 0.2 and (places["a"] == range(n)).mean() < 0.2


def test_permuted_columns_keep_their_values_and_nulls(spark):
    rows = spark.createDataFrame([(k, f"v{k % 4}" if k % 3 else None, float(k)) for k in range(60)], "k int, s string, x double")
    got = modeling.permute_columns(rows, ["s", "x"], ["k"], 5).toPandas()
    assert sorted(got["_perm_x"]) == sorted(got["x"]) and (got["_perm_x"] != got["x"]).any()
    assert sorted(map(str, got["_perm_s"])) == sorted(map(str, got["s"]))
    again = modeling.permute_columns(rows.repartition(5), ["s", "x"], ["k"], 5).toPandas().sort_values("k")
    assert again["_perm_x"].tolist() == got.sort_values("k")["_perm_x"].tolist()


def test_few_constants_find_the_best_of_the_grid(spark):
    """Groups of all kinds: clean curves, noise, curves that rise, one temperature, vertices off the grid."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        constant, slope = rng.uniform(5, 35), rng.choice([-5.0, -1.0, 0.2, 3.0])
        for _ in range(int(rng.integers(5, 12))):
            temp, stress = 800.0 if g % 10 == 9 else rng.uniform(750, 1000), rng.uniform(20, 400)
            life = 1000 * (30 + slope * np.log10(stress)) / temp - constant + rng.normal(0, [0, 0.1, 1.0][g % 3])
            rows.append((g, temp, stress, float(life)))
    df = spark.createDataFrame(rows, "g int, temp double, stress double, log_lifetime double")
    got = {r["g"]: r for r in lmp.fit_lmp_by_group(df, ["g"], min_rows=5).collect()}
    for g, r in got.items():
        trials = [t for t in lmp.lmp_grid(df.where(f"g = {g}")).collect() if t["slope"] < 0] if g < 20 else None
        if trials is None:
            continue
        if not trials:
            assert r["c_value"] is None and not r["accepted"]
        else:
            best = min(t["rmse_log"] for t in trials)
            assert r["rmse_log"] == pytest.approx(best, abs=1e-6) and r["slope"] < 0


def test_correlation_and_moments_like_pandas(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 5)) @ rng.normal(size=(5, 5)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.1
    import pandas as pd

    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["f"] = np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_pairs(df, list("abcdef")).collect()}
    want = pdf.corr()
    for a in "abcdef":
        for b in "abcdef":
            if np.isnan(want.loc[a, b]):
                assert got[a, b] is None or np.isnan(got[a, b])
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    full = pdf[list("abcd")].dropna()
    m = stats.moments(df, list("abcd"))
    assert m.n == len(full) and np.allclose(m.mean, full.mean()) and np.allclose(m.cov, full.cov(), rtol=1e-9) and np.allclose(m.std, full.std(ddof=0))


def test_skyline_cells_against_all_pairs(spark):
    """Fronts of every kind, with cells so small that many meet and large ones are cut in parts."""
    rng = np.random.default_rng(12)
    simplex = rng.dirichlet([1, 1, 1], 1500)  # all on the front
    cloud = rng.random((1500, 3)).round(2)
    line = np.stack([np.linspace(0, 1, 900), 1 - np.linspace(0, 1, 900)], axis=1)
    for points in (simplex, cloud, line, cloud[:, :1], np.tile(cloud[:1], (50, 1))):
        names = [f"c{k}" for k in range(points.shape[1])]
        df = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{c} double" for c in names)).repartition(5)
        keep = [not ((points <= p).all(axis=1) & (points < p).any(axis=1)).any() for p in points]
        for block in (40, 5000):
            got = pareto.pareto_front(df, {c: "min" for c in names}, block=block).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, points[keep]))
