import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_ELEMENTS, FULL_ELEMENTS
from ruptura.operators import cleaning, ood, stats
from ruptura.operators.composition import rule_based_seeds
from ruptura.operators.penalties import validate_seeds
from ruptura.plans.ood import ood_report
from ruptura.sources import ood_store, results, seeds, sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_table_by_suffix(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "Cr,Ni\n9.0,0.1\n10.0,0.2\n")
    assert tables.read_table(spark, csv, "Cr double, Ni double").agg(F.sum("Cr")).first()[0] == 19.0
    assert tables.read_table(spark, csv).schema["Cr"].dataType.simpleString() == "double"
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    assert tables.read_table(spark, str(tmp_path / "b.parquet")).count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_superalloy_table_is_named_by_position(spark, tmp_path):
    head = ",".join(f"h {i}" for i in range(25))
    row = ",".join(["G1", *["1"] * 23, ""])
    df = tables.read_superalloys(spark, write(tmp_path / "s.csv", f"{head}\n{row}\n"))
    assert df.columns[:2] == ["grade", "Ni"] and "note" not in df.columns and df.first()["temp"] == 1.0


def test_first_available_skips_missing_and_empty(spark, tmp_path):
    empty = write(tmp_path / "empty.csv", "a\n")
    full = write(tmp_path / "full.csv", "a\n1\n")
    got = tables.first_available(spark, [str(tmp_path / "no.csv"), empty, full])
    assert got.first()["source_file"] == "full.csv"
    assert tables.first_available(spark, [empty]) is None


def test_seed_files_in_both_forms_and_round_trip(spark, tmp_path):
    comp = dict.fromkeys(DESIGN_ELEMENTS, 0.1)
    wrapped = write(tmp_path / "w.json", json.dumps({"seed_count": 2, "seeds": [{"composition": comp}] * 2}, indent=1))
    listed = write(tmp_path / "l.json", json.dumps([{"composition": comp}] * 3))
    assert seeds.read_seeds(spark, wrapped).count() == 2
    assert seeds.read_seeds(spark, listed).count() == 3
    assert seeds.read_seeds(spark, str(tmp_path / "none.json")).count() == 0
    loaded = seeds.load_seeds(spark, [wrapped])  # all of them fail the checks, so the built-in ones are used
    assert loaded.count() == 10
    seeds.write_seeds(validate_seeds(rule_based_seeds(spark), ["seed_id"])[0], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/config")).first()["seed_count"] == 10
    assert spark.read.json(str(tmp_path / "out/seeds")).count() == 10


def test_seeds_from_text(spark):
    rows = [(1, 'Sure:\n```json\n[ {"composition": {"C": 0.1,\x01 "Cr": 9}} ,\n {"composition": {"C": 0.2}} ]\n``` done'),
            (2, ""), (3, "no json"), (4, '{"seeds": [{"composition": {"C": 0.3}}]}'), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = [(r["id"], r["composition"] and r["composition"].get("C")) for r in
           seeds.extract_seed_json(df, "t", key=["id"]).orderBy("id").collect()]
    # An object with a seeds list holds the block [ {...} ] too, as text search finds it first.
    assert got == [(1, 0.1), (1, 0.2), (2, None), (3, None), (4, 0.3), (5, None)]


def test_clean_results(spark):
    df = spark.createDataFrame(
        [("1", " 2.5 ", "{'a': 1.0, 'b': None}", "x", "0"), ("nan", "None", "", "null", "1"), ("3", "7", "{'a': 2}", "y=True", "2")],
        ["id ", "cost", "phases", "note", "Unnamed: 0"])
    out = results.clean_results(df, {"phases": "map<string,double>"})
    assert out.columns == ["id", "cost", "phases", "note"]
    rows = out.collect()
    assert rows[0]["cost"] == 2.5 and rows[0]["phases"] == {"a": 1.0, "b": None}
    assert rows[1].asDict() == {"id": None, "cost": None, "phases": None, "note": None}
    assert rows[2]["note"] == "y=True"


def test_envelopes(spark, tmp_path):
    best = write(tmp_path / "b.json", json.dumps({"generated_at": "t", "best": {"Cr": 9.0}}))
    many = write(tmp_path / "m.json", json.dumps({"count": 2, "candidates": [{"Cr": 9.0}, {"Cr": 10.0}]}))
    bare = write(tmp_path / "r.json", json.dumps([{"Cr": 9.0}]))
    rows, meta = results.unwrap_payload(results.read_payload(spark, best))
    assert rows.first()["Cr"] == 9.0 and meta.first()["generated_at"] == "t"
    rows, meta = results.unwrap_payload(results.read_payload(spark, many))
    assert rows.count() == 2 and meta.first()["count"] == 2
    rows, meta = results.unwrap_payload(results.read_payload(spark, bare))
    assert rows.count() == 1 and meta is None


def test_metric_log(spark, tmp_path):
    log = write(tmp_path / "log.txt", "x\n최종 RMSE(log10): 0.605123\n최종 R2(log10): -0.5\n")
    got = {r["metric"]: r["value"] for r in results.read_metrics(spark, log).collect()}
    assert got == {"rmse_log": 0.605123, "r2_log": -0.5}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, ["a"]), (2, 1.0, ["b"])], "candidate_id int, cost double, notes array<string>")
    sinks.write_candidates(df.orderBy("cost"), str(tmp_path / "c"), {"temp_c": 650.0, "cost_limit": None})
    doc = spark.read.json(str(tmp_path / "c/json")).first()
    assert doc["count"] == 2 and [c["candidate_id"] for c in doc["candidates"]] == [2, 1]
    assert doc["conditions"]["temp_c"] == 650.0
    assert spark.read.option("header", True).csv(str(tmp_path / "c/csv")).count() == 2
    many = spark.range(25).select(F.col("id").alias("candidate_id"), (25.0 - F.col("id")).alias("cost")).orderBy("cost")
    sinks.write_candidates(many, str(tmp_path / "d"), {"temp_c": 650.0}, most=10)
    parts = {r["part"]: r for r in spark.read.json(str(tmp_path / "d/json")).collect()}
    assert [parts[k]["count"] for k in (0, 1, 2)] == [10, 10, 5]
    assert [c["candidate_id"] for k in (0, 1, 2) for c in parts[k]["candidates"]] == list(range(24, -1, -1))
    assert spark.read.option("header", True).csv(str(tmp_path / "d/csv")).count() == 25
    sinks.write_best(df.orderBy("cost"), str(tmp_path / "b"), {"temp_c": 650.0})
    assert spark.read.json(str(tmp_path / "b/json")).first()["best"]["candidate_id"] == 2
    sinks.write_fit_summary(df.drop("notes"), str(tmp_path / "f"), "inner_train")
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first()["split"] == "inner_train"
    pred = spark.createDataFrame([tuple([1.0] * 7)], ", ".join(f"{c} double" for c in sinks.PREDICTION_COLUMNS))
    sinks.write_predictions(pred, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == sinks.PREDICTION_COLUMNS


def test_reference_store_and_aliases(spark, tmp_path):
    ref = ood.OodReference(("a", "b"), (1.0, 2.0), ((1.0, 0.0), (0.0, 1.0)), (1.0, 1.0), 2.5, 0.95, 10, 1.0, 3.0)
    path = str(tmp_path / "ref")
    ood_store.save_reference(ref, path, spark, spark.createDataFrame([(1.0,)], "ood_distance double"))
    assert ood_store.load_reference(spark, ["/nowhere", path]) == ref
    assert ood_store.load_train_distances(spark, path).count() == 1
    payload = write(tmp_path / "p.json", json.dumps({"composition_mean": [1, 2], "inverse_covariance": [[1, 0], [0, 1]], "features": ["a", "b"]}))
    old = ood_store.load_reference(spark, [payload])
    assert old.mean == (1.0, 2.0) and old.threshold == 3.0
    with pytest.raises(RuntimeError):
        ood_store.load_reference(spark, ["/nowhere"])
    assert ood_store.load_reference(spark, ["/nowhere"], required=False) is None


def test_stored_models_bring_rows_and_distances(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), 2.0 * k, 5.0 + k) for k in range(8)], "row_index long, a double, b double, temp double")
    ref = ood.fit_reference(rows, ["a", "b"])
    distances = rows.select(ood.mahalanobis(ref).alias("ood_distance"))
    path = str(tmp_path / "kept")
    ood_store.save_reference(ref, path, spark, distances, rows)
    asked = spark.createDataFrame([(1, 0.4, 1.0), (2, 90.0, -3.0)], "candidate_id int, a double, b double")
    payload = {"mean": list(ref.mean), "cov_inv": [list(r) for r in ref.cov_inv], "features": ["a", "b"], "threshold": ref.threshold, "std": list(ref.std),
               "train_distances": [r[0] for r in distances.collect()], "reference_rows": [r.asDict() for r in rows.drop("row_index").collect()]}
    stored = write(tmp_path / "p.json", json.dumps(payload))
    for place in (path, stored):
        got = {r["candidate_id"]: r for r in ood_report(asked, ood_store.load_model(spark, place), k=2).collect()}
        assert [n["row_index"] for n in got[1]["nearest_neighbors"]] == [0, 1] and got[2]["ood_percentile"] == 100.0
        assert got[1]["nearest_neighbors"][0]["temp"] == 5.0
    bare = write(tmp_path / "bare.json", json.dumps({k: payload[k] for k in ("mean", "cov_inv", "features")}))
    distances, rows = ood_store.rows_of_payload(spark.read.option("multiLine", True).json(bare))
    assert distances is None and rows is None


def test_products(spark):
    df = spark.createDataFrame([("9", "x", 5.0)], [" Cr ", "Rh", "Hours"])
    row = cleaning.normalize_products(df).first().asDict()
    assert row == {"name": "제품 1", "Cr": 9.0, "Re": 0.0}
    with pytest.raises(ValueError):
        cleaning.normalize_products(df.filter("false"))


def test_validity_filter_drops_missing_and_counts(spark):
    rows = [(10.0, 100.0, 900.0, 0.0, 0.0, 0.0), (-1.0, 100.0, 900.0, 0.0, 0.0, 0.0),
            (10.0, 100.0, 900.0, float("nan"), 0.0, 0.0), (10.0, 100.0, 900.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "lifetime double, stress double, temp double, Ntemp double, Ttemp double, Atemp double")
    seen = Observation()
    assert cleaning.drop_invalid(df, observation=seen).count() == 1
    assert seen.get == {"rows": 4, "removed": 3}


def test_family_filter_needs_its_columns(spark):
    with pytest.raises(KeyError):
        cleaning.family_filter(spark.createDataFrame([(9.0,)], "Cr double"))
    raw = spark.createDataFrame([("9.0", None), ("bad", "0.1"), ("12.4", "3")], "Cr string, Ni string")
    assert cleaning.family_filter_raw(raw).count() == 1


def test_union_shifts_celsius_but_not_absent_stages(spark):
    a = spark.createDataFrame([(600.0, 0.0, 9.0)], "temp double, aging_temp double, cr double")
    b = spark.createDataFrame([(900.0, 0.1)], "temp double, Rh double")
    out = {r["source"]: r for r in cleaning.union_sources({"a": a, "b": b}, {"a": ["temp", "aging_temp"]}).collect()}
    assert out["a"]["temp"] == pytest.approx(873.15) and out["a"]["aging_temp"] == 0.0 and out["b"]["Re"] == 0.1


def test_dedup_first_wins_and_batches(spark):
    df = spark.createDataFrame([(1, 0.10001), (2, 0.10002), (3, 0.2), (4, 0.30001)], "id int, x double")
    assert [r["id"] for r in stats.dedup_rounded(df, ["x"], ["id"]).orderBy("id").collect()] == [1, 3, 4]
    known = spark.createDataFrame([(0.2,)], "x double")
    assert [r["id"] for r in stats.dedup_batches(df, known, ["x"], ["id"], 2, 4).collect()] == [1, 4]


def test_full_elements_are_nineteen():
    assert len(FULL_ELEMENTS) == 19 and set(DESIGN_ELEMENTS) < set(FULL_ELEMENTS)
