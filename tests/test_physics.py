import math
import random

import pytest
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_BOUNDS, DESIGN_ELEMENTS, ELEMENT_COST, FIXED_ELEMENTS, FULL_ELEMENTS
from ruptura.functions import numeric, physics
from ruptura.operators import composition, features, penalties
from ruptura.plans.design import evaluate_physics

ALLOY = dict(zip(DESIGN_ELEMENTS, (0.10, 0.25, 0.45, 9.20, 0.50, 1.80, 0.10, 0.21, 0.060, 0.045, 0.005)))


def one(spark, values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` double" for k in values))


def test_half_even_rounds_like_python(spark):
    random.seed(3)
    values = [2.5, 0.5, -0.5, 2.675, 0.285, 0.575, 12.18555, 1.005, -1.005, 1e15 + 0.3, 0.0]
    values += [round(random.uniform(-20, 20), 5) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 4):
        got = [r[1] for r in df.select("v", numeric.half_even("v", digits)).collect()]
        assert got == [float(round(v, digits)) for v in values]


def test_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "t string")
    assert [r[0] for r in df.select(numeric.to_double_or("t", -1.0)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]
    assert [r[0] for r in df.select(numeric.number_or("t")).collect()][:3] == [1.5, 0.0, 0.0]


def test_severity_modes_differ_only_for_short_times(spark):
    df = one(spark, {"kelvin": 1000.0, "hours": 0.0})
    row = df.select(*[physics.severity("kelvin", "hours", m).alias(m) for m in ("training", "inference", "physics")]).first()
    assert row["training"] == pytest.approx(1000 * 14) and row["inference"] == pytest.approx(1000 * 14)
    assert row["physics"] == 0.0
    with pytest.raises(ValueError):
        physics.severity("kelvin", "hours", "other")


def test_excess_penalty(spark):
    df = one(spark, {"v": 12.0})
    row = df.select(
        physics.excess_penalty("v", 10.0, "upper", 1.5, 2.0), physics.excess_penalty("v", 10.0, "lower"),
        physics.excess_penalty("v", 14.0, "lower", 1.0, 0.0), physics.excess_penalty("v", 8.0, power=0.5)).first()
    assert [round(x, 9) for x in row] == [1.5, 0.0, 4.0, 2.0]
    with pytest.raises(ValueError):
        physics.excess_penalty("v", 1.0, "sideways")


def test_life_labels(spark):
    df = spark.createDataFrame([(5.0,), (3.5,), (2.0,), (None,)], "y double")
    assert [r[0] for r in df.select(physics.life_label("y")).collect()] == ["11년", "3.2k h", "100 h", "—"]


def test_full_composition_overrides_fixed_elements(spark):
    row = composition.full_composition(one(spark, {"Cr": 9.0, "Re": 5.0, "Zz": 1.0})).first().asDict()
    assert row["Re"] == 0.0 and row["Cr"] == 9.0 and row["P"] == 0.005 and row["Zz"] == 1.0


def test_metallurgy_by_hand(spark):
    scored = penalties.metallurgy(composition.full_composition(one(spark, ALLOY)))
    row = scored.withColumn("cost", composition.material_cost()).first()
    a = {**dict.fromkeys(FULL_ELEMENTS, 0.0), **ALLOY, **FIXED_ELEMENTS}
    total = sum(a.values())
    kn = (9.2 + 1.5 + 2.0 + 0.006 + 0.24 + 0.315 + 2.7) - (4.0 + 1.35 + 0.9 + 0.4)
    assert row["kn"] == pytest.approx(kn)
    assert row["ms_temp"] == pytest.approx(561 - 47.4 - 14.85 - 156.4 - 1.7 - 10.5)
    assert row["z_phase_risk"] == pytest.approx(0.27 / 0.045001)
    assert row["total_alloy"] == pytest.approx(total) and row["fe_balance"] == pytest.approx(100 - total)
    assert row["cost"] == pytest.approx(((100 - total) * 0.6 + sum(v * ELEMENT_COST[e] for e, v in a.items())) / 100)
    assert row["kn_penalty"] == pytest.approx(1.5 * max(0, kn - 8.5) ** 2)


def test_mole_fractions_sum_to_one_and_report_errors(spark):
    full = composition.full_composition(one(spark, ALLOY))
    out = composition.mole_fractions(full).first().asDict()
    assert sum(v for k, v in out.items() if k.startswith("x_") and v) == pytest.approx(1.0)
    assert out["mole_error"] is None
    rich = composition.full_composition(one(spark, {"C": 60.0, "N": 39.0}))
    assert "non-Fe" in composition.mole_fractions(rich).first()["mole_error"]


def test_phases_and_failed_candidates(spark):
    phases = spark.createDataFrame(
        [("a", "LAVES_PHASE", 0.05), ("a", "BCC_A2", 0.9), ("a", "BCC_A2", 0.05), ("a", "", 3.0), ("a", "nan", 1.0),
         ("a", "SIGMA", 1e-13), ("a", "M6C", float("nan"))], "candidate_id string, phase string, amount double")
    cands = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    got = {r["candidate_id"]: r for r in penalties.attach_thermo(cands, phases).collect()}
    assert got["a"]["laves_fraction"] == pytest.approx(0.05) and got["a"]["bcc_fraction"] == pytest.approx(0.95)
    assert got["a"]["thermo_penalty"] == pytest.approx(10 * 2.0 ** 2) and got["a"]["thermo_success"]
    assert set(got["a"]["phase_info"]) == {"LAVES_PHASE", "BCC_A2"}
    assert got["b"]["thermo_penalty"] == 100.0 and got["b"]["thermo_success"] is False
    skipped = penalties.attach_thermo(cands, None)
    assert set(skipped.columns) == set(penalties.attach_thermo(cands, phases).columns)
    assert skipped.first()["thermo_penalty"] == 0.0


def test_unified_penalty(spark):
    row = evaluate_physics(one(spark, {**ALLOY, "Co": 3.0}).withColumn("candidate_id", F.lit(1))).first()
    assert row["elemental_ood_penalty"] == 0.0  # Co is a fixed element
    assert row["final_penalty"] == pytest.approx(row["metallurgy_penalty"])


def repair_by_hand(v):
    lo = [DESIGN_BOUNDS[e][0] for e in DESIGN_ELEMENTS]
    hi = [DESIGN_BOUNDS[e][1] for e in DESIGN_ELEMENTS]
    budget = 15.0 - sum(FIXED_ELEMENTS.values())
    v = [min(max(x, a), b) for x, a, b in zip(v, lo, hi)]
    for _ in range(2):
        if sum(v) > budget:
            room = sum(x - a for x, a in zip(v, lo))
            v = [x - (sum(v) - budget) * (x - a) / room for x, a in zip(v, lo)]
    return v


def test_repair_keeps_bounds_and_budget(spark):
    random.seed(5)
    rows = [[random.uniform(-1, 2.5) * DESIGN_BOUNDS[e][1] for e in DESIGN_ELEMENTS] for _ in range(200)]
    rows.append([DESIGN_BOUNDS[e][1] for e in DESIGN_ELEMENTS])
    df = spark.createDataFrame(rows, ", ".join(f"{e} double" for e in DESIGN_ELEMENTS))
    for got, raw in zip(composition.repair(df).collect(), rows):
        assert list(got) == pytest.approx(repair_by_hand(raw), abs=1e-12)
        assert sum(got) <= composition.design_budget() + 1e-9
        assert all(DESIGN_BOUNDS[e][0] <= got[e] <= DESIGN_BOUNDS[e][1] for e in DESIGN_ELEMENTS)
    with pytest.raises(ValueError):
        composition.repair(df, budget=1.0)


def test_random_candidates_do_not_depend_on_partitions(spark):
    a = sorted(composition.random_candidates(spark, 50, 9).collect())
    rows = spark.range(50).repartition(3).withColumnRenamed("id", "candidate_id")
    b = sorted(composition.repair(composition.draw_uniform(rows, ["candidate_id"], 9)).collect())
    assert a == b


def test_seed_checks_keep_rejects_with_their_reason(spark):
    good = dict(ALLOY)
    rows = [(1, *good.values()), (2, *good.values()), (3, *{**good, "Cr": 12.0}.values()),
            (4, *{**good, "W": 2.5, "Cr": 11.5, "Mo": 1.2}.values())]
    df = spark.createDataFrame(rows, "seed_id int, " + ", ".join(f"{e} double" for e in DESIGN_ELEMENTS))
    accepted, rejected = penalties.validate_seeds(df, ["seed_id"])
    assert [r["seed_id"] for r in accepted.collect()] == [1]
    reasons = {r["seed_id"]: r["reason"] for r in rejected.collect()}
    assert reasons[3] == "Cr out of range: 12.000000 not in [8.5, 11.5]"
    assert reasons[4].startswith("total alloy too high")


def test_rule_based_seeds_all_pass(spark):
    accepted, rejected = penalties.validate_seeds(composition.rule_based_seeds(spark), ["seed_id"])
    assert accepted.count() == 10 and rejected.count() == 0


def test_scoring_features_fill_gaps(spark):
    row = features.scoring_features(one(spark, {"Cr": 9.0, "temp": 900.0})).first()
    assert list(row.asDict()) == features.MODEL_FEATURES
    assert row["stress"] == 0.0 and row["inverse_temperature"] == pytest.approx(1000 / 900)
    assert row["operating_severity"] == pytest.approx(0.9 * math.log10(1e-9 + 1), abs=1e-15)


def test_feature_catalog(spark):
    counts = {r["group_id"]: r["n_features"] for r in
              features.feature_group_counts(features.feature_catalog(spark, features.MODEL_FEATURES)).collect()}
    assert counts == {0: 2, 1: 19, 2: 9, 3: 4}
