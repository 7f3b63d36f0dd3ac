import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ruptura.constants import DESIGN_ELEMENTS, MIN_DISTANCE
from ruptura.operators import composition, diversity, neighbors, pareto, selection


def brute_front(points):
    keep = []
    for i, p in enumerate(points):
        if not ((points <= p).all(axis=1) & (points < p).any(axis=1)).any():
            keep.append(i)
    return set(keep)


@pytest.mark.parametrize("block", [20_000, 7])
def test_pareto_front_matches_brute_force(spark, block):
    rng = np.random.default_rng(2)
    points = np.round(rng.random((400, 3)), 2)
    points[:130] = points[0]  # a third are copies
    points[200:300, 2] = 2.0 - points[200:300, 0] - points[200:300, 1]  # many incomparable rows
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    want = brute_front(points)
    got = {r["id"] for r in pareto.pareto_front(df, {"a": "min", "b": "min", "c": "min"}, block=block).collect()}
    assert got == want
    flipped = df.withColumn("a", -F.col("a"))
    got = {r["id"] for r in pareto.pareto_front(flipped, {"a": "max", "b": "min", "c": "min"}, block=block).collect()}
    assert got == want


def test_pareto_keeps_equal_objectives_and_drops_full_copies(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5), (1.0, 1.0, 6), (1.0, 1.0, 6), (2.0, 2.0, 7), (None, 0.0, 8)], "a double, b double, g int")
    front = pareto.pareto_front(df, {"a": "min", "b": "min"}, ["g"])
    assert sorted(r["g"] for r in front.collect()) == [5, 6]
    bad = df.filter("a is null")
    assert pareto.pareto_front(bad, {"a": "min", "b": "min"}).count() == 1


def brute_diverse(points, limit, d):
    kept = []
    for i, p in enumerate(points):
        if len(kept) == limit:
            break
        if all(np.linalg.norm(p - points[k]) >= d for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("block", [4096, 16])
def test_diversity_matches_a_plain_loop(spark, block):
    rng = np.random.default_rng(4)
    points = rng.random((600, 3))
    points[100:300] = points[0]  # a third are copies
    points[300:420] = points[1] + rng.normal(0, 0.01, (120, 3))  # a crowd
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double")
    for limit in (25, 600):
        got = sorted(r["id"] for r in diversity.diverse(df, ["id"], ["x", "y", "z"], 0.2, limit, block).collect())
        assert got == brute_diverse(points, limit, 0.2)


def test_initial_population(spark):
    seeds = composition.seed_candidates(composition.rule_based_seeds(spark)).withColumnRenamed("seed_id", "candidate_id")
    seeds = seeds.withColumn("candidate_id", F.col("candidate_id").cast("long"))
    rows = diversity.initial_population(seeds, size=30, attempts=20).collect()
    points = np.array([[r[e] for e in DESIGN_ELEMENTS] for r in rows])
    gaps = np.linalg.norm(points[:, None] - points[None], axis=2) + np.eye(len(rows)) * 9
    assert len(rows) == 30 and gaps.min() >= MIN_DISTANCE and any(r["is_seed"] for r in rows)
    with pytest.raises(RuntimeError):
        diversity.initial_population(seeds, size=30, min_distance=5.0, attempts=2)


def test_neighbors_match_brute_force_with_copies(spark):
    rng = np.random.default_rng(6)
    ref = np.round(rng.normal(0, 1, (900, 4)), 2)
    ref[:300] = ref[0]
    cand = np.round(rng.normal(0, 1.5, (60, 4)), 2)
    cand[:5] = ref[0]
    std = ref.std(axis=0)
    std[3] = 0.0
    cols = ["a", "b", "c", "d"]
    ddl = ", ".join(f"{c} double" for c in cols)
    rdf = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ref)], "row_index long, " + ddl)
    cdf = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cand)], "candidate_id long, " + ddl)
    got = neighbors.nearest_neighbors(cdf, rdf, cols, 5, std=list(std)).collect()
    scale = np.where(std < 1e-12, 1.0, std)
    found = {}
    for r in got:
        found.setdefault(r["candidate_id"], {})[r["rank"]] = (r["row_index"], r["standardized_distance"])
    for i, c in enumerate(cand):
        dist = np.sqrt((((ref / scale) - (c / scale)) ** 2).sum(axis=1))
        want = sorted(range(len(ref)), key=lambda j: (round(dist[j], 12), j))[:5]
        assert [found[i][k][0] for k in range(1, 6)] == want
        assert np.allclose([found[i][k][1] for k in range(1, 6)], dist[want])
    structs = neighbors.neighbor_structs(neighbors.nearest_neighbors(cdf, rdf, cols, 3, std=list(std)), cdf, cols)
    first = structs.filter("candidate_id = 0").first()["nearest_neighbors"]
    assert [n["rank"] for n in first] == [1, 2, 3] and first[0]["delta_from_candidate"]["a"] == 0.0


def candidates(spark):
    cols = ("candidate_id int, predicted_log_life double, material_cost double, physics_risk double, "
            "metallurgy_penalty double, thermo_success boolean, laves_fraction double, ood_is_out_of_distribution boolean")
    return spark.createDataFrame([
        (1, 4.00, 3.0, 0.0, 0.0, True, 0.0, False), (2, 3.98, 1.5, 0.0, 0.0, True, 0.0, False),
        (3, 3.99, 2.5, 0.0, 0.0, True, 0.0, False), (4, 5.00, 1.0, 0.5, 0.5, True, 0.0, False),
        (5, 6.00, 1.0, 0.0, 0.0, False, 0.03, False), (6, 7.0, 1.0, float("nan"), 0.0, True, 0.0, True)], cols)


def test_violations_text_and_score(spark):
    rows = {r["candidate_id"]: r for r in selection.violation_score(candidates(spark), True).collect()}
    assert rows[1]["selection_physical_score"] == 0.0 and rows[1]["selection_physical_violations"] == []
    assert rows[4]["selection_physical_score"] == 1.0  # a penalty counts in the sum and on its own
    assert rows[5]["selection_physical_violations"] == ["thermo_success=False", "laves_fraction=0.030000"]
    assert rows[5]["selection_physical_score"] == pytest.approx(100.1)
    assert rows[6]["selection_physical_score"] == 100.0


def test_ranking_and_best(spark):
    df = candidates(spark)
    assert [r["candidate_id"] for r in selection.rank_candidates(df, 2.0, True).collect()] == [1, 3, 2, 4, 6, 5]
    best = selection.select_best(df, 2.0).first()
    assert best["candidate_id"] == 2 and best["selection_policy"].startswith("physical validity")
    assert selection.select_best(df, None).first()["candidate_id"] == 2  # cheapest in the band
    failed = df.withColumn("thermo_success", F.lit(False))
    assert selection.select_best(failed, 2.0).first()["candidate_id"] == 2
    none = df.withColumn("metallurgy_penalty", F.lit(1.0))
    assert selection.select_best(none, 2.0).first()["selection_policy"].startswith("fallback")


def test_sort_puts_missing_last_when_descending(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, 5.0), (4, None)], "id int, v double")
    assert [r["id"] for r in selection.sort_candidates(df, "v", False, ["id"]).collect()] == [3, 1, 2, 4]
    assert [r["id"] for r in selection.sort_candidates(df, "v", True, ["id"]).collect()] == [2, 4, 1, 3]


def test_candidate_summary_covers_every_drawn_candidate(spark):
    sf = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["candidate_summary"](spark, sf).select("candidate_id", "ood_percentile", F.size("nearest_neighbors").alias("near")).collect()
    drawn = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()
    assert sorted(r["candidate_id"] for r in rows) == sorted(r[0] for r in drawn)
    assert all(r["ood_percentile"] is not None and r["near"] == 5 for r in rows)
