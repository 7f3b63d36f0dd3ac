import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_BOUNDS, DESIGN_ELEMENTS
from ruptura.operators import composition, neighbors, order, pareto, ranks, split, stats
from ruptura.plans import design, ood
from ruptura.operators.ood import fit_with_distances, mahalanobis


def ordered_rows(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 1, (300, 2)), 1).tolist()
    keys = [(None if i % 17 == 0 else int(rng.integers(0, 40)), f"k{i % 3}") for i in range(300)]
    rows = [(*k, *v, float(i)) for i, (k, v) in enumerate(zip(keys, values))]
    rows += rows[:60]
    return spark.createDataFrame(rows, "p int, q string, a double, b double, temp double").repartition(5).cache()


def test_few_candidates_find_the_neighbours_that_the_indexed_rows_have(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SCAN_ROWS", 16)
    known = order.OrderedRows(ordered_rows(spark), ("p", "q"))
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, None), (3, 9.0, float("nan")), (4, -1.0, 0.5)], "candidate_id int, a double, b double")
    assert neighbors.is_few(asked) and not neighbors.is_few(asked.filter("false")) and known.countable()
    monkeypatch.setattr(order, "dense_index", None)  # nothing sorts the reference
    few = neighbors.nearest_in_order(asked, known, ["a", "b"], 5, std=[2.0, 0.5], carry=["temp"])
    monkeypatch.undo()
    whole = neighbors.nearest_neighbors(asked, known.indexed(), ["a", "b"], 5, std=[2.0, 0.5], carry=["temp"])
    assert few.columns == whole.columns
    show = lambda df: sorted(map(tuple, df.collect()))
    assert len(show(few)) == 20 and show(few) == show(whole)


def test_a_few_percentiles_are_those_of_the_rank_index(spark):
    known = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 0.0, -0.0, 7.0, None, float("nan"), float("inf"))], "x double")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate((2.0, 1.9, -1.0, 0.0, -0.0, None, float("nan"), float("inf"), 2.0))], "i int, x double")
    few = {r["i"]: r["p"] for r in ranks.distance_percentile(asked, known, "x", "p").collect()}
    whole = {r["i"]: r["p"] for r in ranks.distance_percentile(asked, ranks.rank_index(known, "x"), "x", "p").collect()}
    assert few == whole and few[0] == pytest.approx(100 * 5 / 6) and few[5] is None
    nothing = ranks.distance_percentile(asked, known.filter("false"), "x", "p").collect()
    assert len(nothing) == 9 and all(r["p"] is None for r in nothing)


def test_a_reference_is_not_sorted_for_a_few_candidates(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id AS k", "id % 10 AS g", "9e0 + (id % 7) / 10 AS Cr", "(id % 5) / 10 AS Ni", "2e0 AS log_lifetime")
    model = ood.build_reference(rows, "g", ["k"], ["Cr", "Ni"])
    assert model.distances.columns == ["ood_distance"] and model.distances.count() == model.reference.n_rows
    want = model.known.rows.select(mahalanobis(model.reference).alias("v"))
    assert sorted(r[0] for r in model.distances.collect()) == sorted(r["v"] for r in want.collect())
    monkeypatch.setattr(order, "dense_index", None)
    asked = spark.createDataFrame([(1, 9.1, 0.1)], "candidate_id int, Cr double, Ni double")
    told = ood.ood_report(asked, model).first()
    assert len(told["nearest_neighbors"]) == 5 and told["ood_percentile"] is not None
    monkeypatch.undo()
    numbered = {r["row_index"]: r["Cr"] for r in model.rows.collect()}
    assert all(numbered[n["row_index"]] == n["composition"]["Cr"] for n in told["nearest_neighbors"])


def test_written_objectives_are_the_columns_given_and_the_triple(spark):
    low = {e: float(v[0]) for e, v in DESIGN_BOUNDS.items()}
    drawn = spark.range(5).select(F.col("id").alias("candidate_id"), *[F.lit(low[e]).alias(e) for e in DESIGN_ELEMENTS])
    scored = design.objectives(drawn, lambda df: df.withColumn("predicted_log_life", 3.0 + F.col("W")), None, 1.7, 873.15, 150.0)
    assert scored.columns == ["candidate_id", *DESIGN_ELEMENTS, "predicted_log_life", "material_cost", "objective_risk"]


def test_a_front_counts_copies_once_before_they_travel(spark, monkeypatch):
    kept, plain = {}, pareto.written
    monkeypatch.setattr(pareto, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 1e0 ELSE 2e0 + id END AS a", "1e0 AS b").coalesce(1)
    front = pareto.pareto_front(rows, {"a": "min", "b": "min"})
    assert front.count() == 2000 and kept["skyline"].count() == 1 and kept["front"].count() == 1
    assert pareto.pareto_front(rows.filter("false"), {"a": "min", "b": "min"}).count() == 0


def test_the_train_side_is_what_the_test_side_leaves(spark):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 23 END AS g")
    cut = split.group_holdout(rows, "g", 0.3, 5)
    test, train = cut.test(rows).collect(), cut.train(rows).collect()
    assert sorted(r["id"] for r in test + train) == list(range(300)) and 0 < len(test) < 300
    assert not {r["g"] for r in test} & {r["g"] for r in train}
    assert "NOT" not in cut.train(rows)._jdf.queryExecution().analyzed().toString()


def test_unit_hashes_are_whole_numbers_before_they_are_doubles(spark):
    number = composition.unit_hash(["k"], "7:C")
    rows = spark.range(40).select(F.col("id").alias("k")).select("k", number.alias("u")).collect()
    assert all(r["u"] == int(hashlib.md5(f"7:C:{r['k']}".encode()).hexdigest()[:13], 16) / 16 ** 13 for r in rows)
    assert "bigint" in spark.range(1).select(F.col("id").alias("k")).select(number)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_moments_take_their_centre_from_one_pass(spark, monkeypatch):
    seen, plain = [], stats.gram
    monkeypatch.setattr(stats, "gram", lambda df, columns, centre=None: seen.append(centre) or plain(df, columns, centre))
    rows = spark.createDataFrame([(1.0, 4.0), (2.0, None), (3.0, 1.0), (5.0, 0.0)], "a double, b double")
    got = stats.moments(rows, ["a", "b"])
    assert seen == [list(got.mean)] and np.allclose(got.cov, np.cov([[1.0, 4.0], [3.0, 1.0], [5.0, 0.0]], rowvar=False))


def test_a_fit_keeps_its_distances(spark):
    rows = spark.range(50).selectExpr("id * 1e0 AS a", "id % 3 * 1e0 AS b")
    ref, distances = fit_with_distances(rows, ["a", "b"])
    assert distances.columns == ["d"] and distances.count() == ref.n_rows == 50
