"""Steps that grew too fast, or held too much at a time, on large tables."""

import numpy as np
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_BOUNDS, DESIGN_ELEMENTS
from ruptura.operators import neighbors, ood
from ruptura.plans import design


def test_few_leaves_are_near_where_features_depend_on_each_other():
    rng = np.random.default_rng(3)
    free = rng.uniform(0, 1, (4096, 2))
    rows = np.column_stack([free, 5 * free[:, 0], 2 * free[:, 1] - free[:, 0], free.sum(axis=1), 3 - free[:, 1]])
    asked = rows[:50] + rng.uniform(-0.5, 0.5, (50, 6))
    tree = neighbors._fit_tree(rows, 64)
    leaf = tree.leaf_of(rows)
    shapes = [neighbors._shape(tree.turned(rows[leaf == n])) for n in range(tree.leaves)]
    gaps = neighbors._gaps(tree.turned(asked), *(np.array([s[i] for s in shapes]) for i in range(4)))
    distance = np.sqrt(((asked[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
    nearest = np.array([distance[:, leaf == n].min(axis=1) for n in range(tree.leaves)]).T
    assert (gaps <= nearest).all()
    fifth = np.sort(distance, axis=1)[:, 4]
    assert (gaps <= fifth[:, None]).sum(axis=1).mean() < 4


def test_neighbours_with_small_leaves_large_leaves_and_several_tasks_a_leaf(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 16), ("BALL_ROWS", 4), ("ASK_ROWS", 8), ("TASK_ASKS", 12), ("TREE_ROWS", 40)):
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(4)
    known = np.round(rng.normal(0, 1, (700, 2)), 2)
    known[:400] = np.round(rng.uniform(0, 0.3, (400, 2)), 3)
    asked = np.round(rng.normal(0, 1, (90, 2)), 2)
    asked[0] = 1e200
    ref = spark.createDataFrame([(i, *map(float, r), float(r[0] + r[1])) for i, r in enumerate(known)], "row_index long, a double, b double, c double")
    cand = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(asked)], "candidate_id long, a double, b double, c double")
    got = {}
    for r in neighbors.nearest_neighbors(cand, ref, ["a", "b", "c"], 5).collect():
        got.setdefault(r["candidate_id"], {})[r["rank"]] = r["standardized_distance"]
    for i, x in enumerate(asked):
        d = np.sort(np.sqrt(((known - x) ** 2).sum(axis=1) + (known.sum(axis=1) - 1.0) ** 2))[:5]
        assert np.allclose([got[i][k] for k in range(1, 6)], d), i


def test_objectives_are_kept_as_columns_and_the_export_reads_the_phases_of_the_chosen_only(spark, monkeypatch):
    low = {e: float(v[0]) for e, v in DESIGN_BOUNDS.items()}
    drawn = spark.range(60).select(F.col("id").alias("candidate_id"), *[(F.lit(low[e]) + F.col("id") * 1e-4).alias(e) for e in DESIGN_ELEMENTS])
    phases = spark.range(60).select(F.col("id").alias("candidate_id"), F.lit("BCC_A2").alias("phase"), F.lit(1.0).alias("amount"))

    def scorer(df):
        return df.withColumn("predicted_log_life", 3.0 + F.col("W"))

    scored = design.objectives(drawn, scorer, None, 1.7, 873.15, 150.0)
    assert scored.inputFiles()
    seen, plain = [], design.summarize_candidates

    def watched(candidates, scorer, model, phases, *rest):
        seen.append(phases.count())
        return plain(candidates, scorer, model, phases, *rest)

    monkeypatch.setattr(design, "summarize_candidates", watched)
    ranked, best = design.export_pareto(scored, scorer, None, phases, 1.7, 873.15, 150.0, n=4)
    assert seen == [4] and ranked.count() == 4 and all(r["thermo_success"] for r in ranked.collect()) and best.count() == 1


def test_distances_are_worked_out_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ood, "written", lambda df, name: made.append(df.columns) or df, raising=True)
    rows = spark.range(100).select((F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    assert ood.fit_reference(rows, ["a", "b"]).threshold > 0
    assert made == [["d"]]
