"""Queries: sources, naming, cleaning and validity filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruptura.catalog.standins import (
    BALANCE_SQL, DESIGN, HEAT, KEY, KEYS, LOG_LIFE, STRESS, TEMP, alloys, lines, lines_sql, query, round_sql,
    rounded, table,
)
from ruptura.constants import METRIC_PATTERNS
from ruptura.functions.numeric import to_double_or
from ruptura.operators import cleaning, stats
from ruptura.sources.results import clean_results, parse_metrics, unwrap_payload
from ruptura.sources.seeds import extract_seed_json
from ruptura.sources.tables import first_available, read_table


@query("canonical_columns", 'SELECT s_suppkey AS id, s_acctbal AS "Cr", s_nationkey AS "Re" FROM supplier')
def canonical_columns(spark, d):
    raw = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").toDF("id", " CR ", "rh")
    return cleaning.normalize_columns(raw)


@query("product_table", 'SELECT s_name AS name, s_acctbal AS "Re", 0e0 AS "Cr", s_nationkey::DOUBLE AS "Mo" FROM supplier')
def product_table(spark, d):
    raw = table(spark, d, "supplier").select(
        F.col("s_name").alias("Name "), F.col("s_acctbal").alias(" Rh"), F.col("s_name").alias("Cr"),
        F.col("s_nationkey").cast("string").alias("Mo"), F.col("s_acctbal").alias("Rupture_Hours"))
    return cleaning.normalize_products(raw)


@query("first_source", "SELECT *, 'supplier.parquet' AS source_file FROM supplier")
def first_source(spark, d):
    return first_available(spark, [f"{d}/absent.parquet", f"{d}/supplier.parquet", f"{d}/nation.parquet"], read_table)


@query("seeds_from_text", """
WITH answers AS (
  SELECT conv_id, turn, trim(text || ' [ {"composition": {"C": ' || turn || ', "Cr": 9.5}}, {"composition": {"C": '
         || conv_id || '}} ]' || chr(10) || text) AS t FROM conversations),
blocks AS (SELECT conv_id, turn, regexp_extract(t, '(?s)\\[\\s*\\{.*\\}\\s*\\]', 0) AS b FROM answers),
parsed AS (SELECT conv_id, turn, unnest(from_json(regexp_replace(b, '[\\x00-\\x1F\\x7F]', '', 'g'),
           '[{"composition": {"C": "DOUBLE", "Cr": "DOUBLE"}}]')) AS s FROM blocks)
SELECT conv_id, turn, s.composition."C" AS c, s.composition."Cr" AS cr FROM parsed""")
def seeds_from_text(spark, d):
    answers = table(spark, d, "conversations").select("conv_id", "turn", F.concat(
        F.col("text"), F.lit(' [ {"composition": {"C": '), F.col("turn"), F.lit(', "Cr": 9.5}}, {"composition": {"C": '),
        F.col("conv_id"), F.lit("}} ]\n"), F.col("text")).alias("answer"))
    found = extract_seed_json(answers, "answer", key=["conv_id", "turn"])
    return found.select("conv_id", "turn", F.col("composition")["C"].alias("c"), F.col("composition")["Cr"].alias("cr"))


@query("cleaned_results", """
SELECT event_id::DOUBLE AS event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount,
       json_extract(props, '$.k')::INT AS k FROM events""")
def cleaned_results(spark, d):
    error = F.col("event_type") == "error"
    text = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias(" event_id "),
        F.when(error, " NaN ").otherwise(F.col("event_type")).alias("event_type"),
        F.when(error, "").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("amount"),
        F.regexp_replace("props", '"', "'").alias("props"), F.lit("0").alias("Unnamed: 0"))
    clean = clean_results(text, {"props": "map<string,int>"})
    return clean.select("event_id", "event_type", "amount", F.col("props")["k"].alias("k"))


@query("unwrapped_candidates", """
SELECT s_suppkey AS candidate_id, s_acctbal AS cost FROM supplier
UNION ALL SELECT s_suppkey, s_acctbal * 2e0 FROM supplier""")
def unwrapped_candidates(spark, d):
    one = F.struct(F.col("s_suppkey").alias("candidate_id"), F.col("s_acctbal").alias("cost"))
    two = F.struct(F.col("s_suppkey").alias("candidate_id"), (F.col("s_acctbal") * 2.0).alias("cost"))
    stored = table(spark, d, "supplier").select(F.col("s_name").alias("generated_at"), F.array(one, two).alias("candidates"))
    return unwrap_payload(stored)[0]


@query("metrics_from_logs", """
SELECT o_orderkey, 'rmse_log' AS metric, o_totalprice AS value FROM orders
UNION ALL SELECT o_orderkey, 'r2_log', -0.5e0 * o_totalprice FROM orders WHERE o_orderstatus <> 'P'""")
def metrics_from_logs(spark, d):
    labels = {m: p.replace("\\", "").split(":")[0] for m, p in METRIC_PATTERNS.items()}
    logs = table(spark, d, "orders").select("o_orderkey", F.concat(
        F.lit(f"run\n{labels['rmse_log']}: "), F.col("o_totalprice"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(f"\n{labels['r2_log']}: "), F.col("o_totalprice") * -0.5))
        .otherwise(F.lit("\nno fit"))).alias("log"))
    return parse_metrics(logs, "log", ["o_orderkey"])


RAW = {
    "temp": TEMP, "stress": f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {STRESS} END",
    "lifetime": f"CASE WHEN l_linenumber = 6 THEN -1e0 ELSE pow(10e0, {LOG_LIFE}) END",
    "C": "CASE WHEN l_tax = 0 THEN NULL ELSE 0.07e0 + l_discount END",
    "Ntemp": "300e0 * (l_linenumber - 2)", "Ttemp": HEAT["Ttemp"], "Atemp": HEAT["Atemp"],
}


@query("clean_valid_rows", f"""
WITH raw AS ({lines_sql(RAW)})
SELECT {KEYS}, coalesce("C", 0e0) AS "C", round(log10(lifetime), 6) AS log_lifetime FROM raw
WHERE lifetime > 0 AND stress > 0 AND temp > 0 AND "Ntemp" >= 0 AND "Ttemp" >= 0 AND "Atemp" >= 0""")
def clean_valid_rows(spark, d):
    rows = cleaning.drop_invalid(cleaning.handle_missing(lines(spark, d, RAW), ["C"]))
    return rounded(cleaning.log_target(rows), 6, "log_lifetime").select(*KEY, "C", "log_lifetime")


ODD = {
    "temp": TEMP, "stress": f"CASE WHEN l_linenumber = 1 THEN 0e0 WHEN l_linenumber = 2 THEN NULL ELSE {STRESS} END",
    "log_lifetime": f"CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) "
                    f"WHEN l_linenumber = 4 THEN CAST('Infinity' AS DOUBLE) ELSE {LOG_LIFE} END",
}


@query("usable_lmp_rows", f"""
WITH odd AS ({lines_sql(ODD)})
SELECT {KEYS}, stress, temp FROM odd
WHERE stress > 0 AND temp > 0 AND NOT isnan(log_lifetime) AND NOT isinf(log_lifetime)""")
def usable_lmp_rows(spark, d):
    return cleaning.valid_lmp_rows(lines(spark, d, ODD)).select(*KEY, "stress", "temp")


FAMILY = {**DESIGN, "Cr": "CASE WHEN l_linenumber = 1 THEN NULL ELSE 6e0 + l_extendedprice / 12000e0 END", "Ni": "30e0 * l_discount"}
FAMILY_TOTAL = " + ".join(f'coalesce("{e}", 0e0)' for e in DESIGN)


@query("family_filter", f"""
WITH a AS ({lines_sql(FAMILY)})
SELECT {KEYS}, "Cr", "Ni" FROM a WHERE "Cr" BETWEEN 8 AND 12 AND "Ni" BETWEEN 0 AND 2
AND 100e0 - ({FAMILY_TOTAL}) >= 80 AND ({FAMILY_TOTAL}) <= 20""")
def family_filter(spark, d):
    return cleaning.family_filter(lines(spark, d, FAMILY)).select(*KEY, "Cr", "Ni")


@query("family_filter_raw", f"""
WITH a AS ({lines_sql(FAMILY)})
SELECT {KEYS}, "Cr", "Ni" FROM a WHERE "Cr" BETWEEN 8 AND 12.5 AND "Ni" <= 2 AND ({FAMILY_TOTAL}) <= 20""")
def family_filter_raw(spark, d):
    return cleaning.family_filter_raw(lines(spark, d, FAMILY)).select(*KEY, "Cr", "Ni")


GIVEN_FE = {"Fe": "CASE WHEN l_linenumber = 1 THEN NULL ELSE 80e0 + l_tax END"}


@query("alloy_balance", f"""
WITH a AS ({lines_sql(DESIGN, GIVEN_FE)})
SELECT {KEYS}, round({' + '.join(f'"{e}"' for e in DESIGN)}, 6) AS total_alloy,
       round(coalesce("Fe", 100e0 - ({' + '.join(f'"{e}"' for e in DESIGN)})), 6) AS fe_balance FROM a""")
def alloy_balance(spark, d):
    out = cleaning.alloy_balance(alloys(spark, d, GIVEN_FE))
    return rounded(out, 6, "total_alloy", "fe_balance").select(*KEY, "total_alloy", "fe_balance")


@query("coerced_numbers", """
SELECT p_partkey, 0e0 AS from_text, p_size::DOUBLE AS from_digits,
       CASE WHEN p_size % 3 = 0 THEN -1e0 ELSE p_retailprice END AS from_mixed FROM part""")
def coerced_numbers(spark, d):
    mixed = F.when(F.col("p_size") % 3 == 0, "inf").otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, d, "part").select(
        "p_partkey", to_double_or(F.col("p_name"), 0.0).alias("from_text"),
        to_double_or(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("from_digits"),
        to_double_or(mixed, -1.0).alias("from_mixed"))


HOLES = {"a": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END",
         "b": "CASE WHEN l_linenumber = 2 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END", "c": "1e0"}


@query("complete_cases", f"SELECT {KEYS}, l_quantity AS a, l_extendedprice AS b, 1e0 AS c FROM lineitem WHERE l_linenumber > 2")
def complete_cases(spark, d):
    return cleaning.complete_cases(lines(spark, d, HOLES), ["a", "b", "c"])


@query("active_features", """
WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, 1e0 AS c FROM lineitem WHERE l_linenumber > 2),
s AS (SELECT stddev_samp(a) AS a, stddev_samp(b) AS b, stddev_samp(c) AS c, avg(a) AS ma, avg(b) AS mb FROM r)
SELECT 'a' AS feature, round(ma, 6) AS mean FROM s WHERE a > 1e-12
UNION ALL SELECT 'b', round(mb, 6) FROM s WHERE b > 1e-12
UNION ALL SELECT 'c', 1e0 FROM s WHERE c > 1e-12""")
def active_features(spark, d):
    rows = cleaning.complete_cases(lines(spark, d, HOLES), ["a", "b", "c"])
    return rounded(stats.mean_by_feature(rows, cleaning.active_features(rows, ["a", "b", "c"])), 6, "mean")


@query("united_sources", """
SELECT 'parts' AS source, p_size::DOUBLE AS "Cr", CASE WHEN p_size = 1 THEN 0e0 ELSE p_retailprice + 273.15e0 END AS temp, NULL::DOUBLE AS "Re" FROM part
UNION ALL SELECT 'suppliers', NULL, s_acctbal, s_nationkey::DOUBLE FROM supplier""")
def united_sources(spark, d):
    parts = table(spark, d, "part").select(
        F.col("p_size").cast("double").alias("cr"),
        F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_retailprice")).alias("temp"))
    suppliers = table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("temp"), F.col("s_nationkey").cast("double").alias("Rh"))
    return cleaning.union_sources({"parts": parts, "suppliers": suppliers}, {"parts": ["temp"]})


@query("normalised_alloys", f"""
WITH a AS ({lines_sql(DESIGN)})
SELECT {KEYS}, {round_sql(['C', 'Cr'], 6)}, round({BALANCE_SQL.replace('"P"', '0.005e0').replace('"S"', '0.002e0')
.replace('"Cu"', '0e0').replace('"Al"', '0.003e0').replace('"Co"', '0e0').replace('"Ta"', '0e0')
.replace('"O"', '0.001e0').replace('"Re"', '0e0')}, 6) AS fe FROM a""")
def normalised_alloys(spark, d):
    from ruptura.operators.composition import fe_balance, full_composition

    full = full_composition(alloys(spark, d, extra=["'x' AS `P`", "9e0 AS `Re`"])).withColumn("fe", fe_balance())
    return rounded(full.select(*KEY, "C", "Cr", "fe"), 6, "C", "Cr", "fe")
