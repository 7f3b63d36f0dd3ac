"""Queries: splits, statistics, metrics, ranks, dedup and row replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruptura.catalog.standins import (
    CONDITIONS, KEY, KEYS, TESTS_SQL, lines, lines_sql, query, rnd, rounded, table, tests,
)
from ruptura.operators import metrics, order, ranks, split, stats

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("iqr_outliers", "WITH q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}"
    for c, t in (("o_totalprice", "orders"), ("value", "events"))) + """),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)
SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper,
  CASE WHEN "column" = 'value' THEN (SELECT count(*) FROM events WHERE value < lower OR value > upper)
       ELSE (SELECT count(*) FROM orders WHERE o_totalprice < lower OR o_totalprice > upper) END AS n_outliers FROM f""")
def iqr_outliers(spark, d):
    out = stats.iqr_outliers(table(spark, d, "orders"), ["o_totalprice"]).unionByName(
        stats.iqr_outliers(table(spark, d, "events"), ["value"]))
    return rounded(out, 4, "q1", "q3", "lower", "upper")


@query("target_range", f"SELECT round(min(log_lifetime), 6) AS min_value, round(max(log_lifetime), 6) AS max_value FROM ({TESTS_SQL})")
def target_range(spark, d):
    return rounded(stats.min_max(tests(spark, d), "log_lifetime"), 6, "min_value", "max_value")


@query("corr_matrix_long", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM (SELECT * REPLACE (CASE WHEN l_linenumber > 1 THEN l_tax END AS l_tax) FROM lineitem)"
    for a in NUMBERS for b in NUMBERS))
def corr_matrix_long(spark, d):
    holes = table(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") > 1, F.col("l_tax")))
    return rounded(stats.correlation_pairs(holes, NUMBERS), 6, "corr")


@query("standard_scale", """
WITH m AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM part)
SELECT p_partkey, round((p_size - ms) / ss, 6) AS size_z, round((p_retailprice - mp) / sp, 6) AS price_z, 0e0 AS flat_z FROM part, m""")
def standard_scale(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.lit(3.0).alias("flat"))
    out = stats.Scaler.fit(rows, ["size", "price", "flat"]).transform(rows, "_z")
    return rounded(out.select("p_partkey", "size_z", "price_z", "flat_z"), 6, "size_z", "price_z", "flat_z")


@query("scale_round_trip", "SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part")
def scale_round_trip(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    scaler = stats.Scaler.fit(rows, ["size", "price"])
    return rounded(scaler.inverse(scaler.transform(rows)), 6, "size", "price")


# --- splits ---------------------------------------------------------------------

def cut_sql(source: str, key: str, seed: int, name: str, target: str) -> str:
    """CTE with the groups of the test side."""
    return f"""
{name}_g AS (SELECT {key} AS k, md5('{seed}:' || {key}) AS h, count(*) AS n FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (ORDER BY h, k::VARCHAR ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_g),
{name} AS (SELECT k FROM {name}_c WHERE cum - n < (SELECT greatest(1, round_even(count(*) * {target}, 0)) FROM {source}))"""


@query("group_holdout_counts", f"""
WITH {cut_sql('orders', 'o_custkey', 42, 'picked', '0.2e0')},
side AS (SELECT CASE WHEN o_custkey IN (SELECT k FROM picked) THEN 'test' ELSE 'train' END AS side, o_custkey FROM orders)
SELECT side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM side GROUP BY ALL""")
def group_holdout_counts(spark, d):
    orders = table(spark, d, "orders")
    cut = split.group_holdout(orders, "o_custkey", 0.2, 42)
    sided = orders.select("o_custkey", F.when(cut.is_test(), "test").otherwise("train").alias("side"))
    return stats.side_counts(sided, "side", "o_custkey")


@query("split_sides", f"""
WITH {cut_sql('orders', 'o_custkey', 42, 'picked', '0.2e0')}
SELECT o_orderkey, 'test' AS side FROM orders WHERE o_custkey IN (SELECT k FROM picked)
UNION ALL SELECT o_orderkey, 'train' FROM orders WHERE o_custkey NOT IN (SELECT k FROM picked)""")
def split_sides(spark, d):
    orders = table(spark, d, "orders")
    cut = split.group_holdout(orders, "o_custkey", 0.2, 42)
    return cut.test(orders).select("o_orderkey", F.lit("test").alias("side")).unionByName(
        cut.train(orders).select("o_orderkey", F.lit("train").alias("side")))




@query("group_share_split", """
WITH g AS (SELECT l_suppkey AS k, md5('42:' || l_suppkey) AS h, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS total FROM g)
SELECT k AS l_suppkey, n AS n_rows, i <= ceil(total * 0.2e0) AS is_test FROM r""")
def group_share_split(spark, d):
    rows = table(spark, d, "lineitem")
    cut = split.group_share(rows, "l_suppkey", 0.2, 42)
    return stats.group_counts(rows, "l_suppkey").withColumn("is_test", cut.is_test())


@query("nested_split", f"""
WITH {cut_sql('orders', 'o_custkey', 42, 'outside', '0.2e0')},
rest AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT k FROM outside)),
{cut_sql('rest', 'o_custkey', 59, 'inside', '0.15e0')}
SELECT CASE WHEN o_custkey IN (SELECT k FROM outside) THEN 'test' WHEN o_custkey IN (SELECT k FROM inside) THEN 'validation'
       ELSE 'train' END AS side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders GROUP BY ALL""")
def nested_split(spark, d):
    orders = table(spark, d, "orders")
    nested = split.nested_split(orders, "o_custkey")
    return stats.side_counts(orders.select("o_custkey", nested.side().alias("side")), "side", "o_custkey")


@query("composition_groups", """
WITH g AS (SELECT printf('%.2f', l_discount) || '-' || printf('%.2f', l_tax) || '-' || l_linenumber AS composition_group FROM lineitem)
SELECT composition_group, count(*) AS n_rows FROM g GROUP BY ALL""")
def composition_groups(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.format_string("%.2f", "l_discount").alias("a"), F.format_string("%.2f", "l_tax").alias("b"), "l_linenumber")
    keyed = rows.withColumn("composition_group", split.group_key(["a", "b", "l_linenumber"]))
    return stats.group_counts(keyed, "composition_group")


@query("rounded_groups", """
WITH g AS (SELECT round_even(l_extendedprice / 7919e0, 1) AS a FROM lineitem) SELECT a::VARCHAR AS composition_group, count(*) AS n_rows FROM g GROUP BY ALL""")
def rounded_groups(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 7919.0).alias("a"))
    return stats.group_counts(rows.withColumn("composition_group", split.group_key(["a"], 1)), "composition_group")


# --- metrics ----------------------------------------------------------------------

PREDICTED = "log_lifetime + 3e0 * l_tax - 0.1e0"
METRIC_SQL = ", ".join(
    f"sqrt(avg(({t} - {p}) ** 2)) AS rmse_{n}, avg(abs({t} - {p})) AS mae_{n}, 1 - sum(({t} - {p}) ** 2) / (count(*) * var_pop({t})) AS r2_{n}"
    for n, t, p in (("log", "y", "p"), ("hours", "pow(10e0, y)", "pow(10e0, p)")))
METRIC_ROUND = "round(rmse_log, 6) AS rmse_log, round(mae_log, 6) AS mae_log, round(r2_log, 6) AS r2_log, " \
    "round(rmse_hours, 2) AS rmse_hours, round(mae_hours, 2) AS mae_hours, round(r2_hours, 6) AS r2_hours"
PRED_CTE = f"t AS ({lines_sql(CONDITIONS, extra=['l_tax', 'l_returnflag'])}), yp AS (SELECT l_returnflag, log_lifetime AS y, {PREDICTED} AS p FROM t)"


def predicted(spark, d):
    rows = lines(spark, d, CONDITIONS, extra=["l_tax", "l_returnflag"])
    return rows.withColumn("p", F.col("log_lifetime") + 3.0 * F.col("l_tax") - 0.1)


def round_metrics(df):
    return rounded(rounded(df, 6, "rmse_log", "mae_log", "r2_log", "r2_hours"), 2, "rmse_hours", "mae_hours")


@query("regression_metrics", f"WITH {PRED_CTE}, m AS (SELECT l_returnflag, {METRIC_SQL} FROM yp GROUP BY ALL) SELECT l_returnflag, {METRIC_ROUND} FROM m")
def regression_metrics(spark, d):
    return round_metrics(metrics.regression_metrics(predicted(spark, d), "log_lifetime", "p", ["l_returnflag"]))


@query("model_comparison", f"""
WITH {PRED_CTE}, m AS (SELECT {METRIC_SQL} FROM yp), b AS (SELECT {METRIC_SQL.replace('{p}', 'p')} FROM (SELECT y, y + 0.2e0 AS p FROM yp)),
long AS (SELECT unnest(['rmse_log', 'mae_log', 'r2_log']) AS metric, unnest([m.rmse_log, m.mae_log, m.r2_log]) AS model,
                unnest([b.rmse_log, b.mae_log, b.r2_log]) AS baseline FROM m, b)
SELECT metric, round(model, 6) AS model, round(baseline, 6) AS baseline,
       round(CASE WHEN metric LIKE 'r2%' THEN model - baseline ELSE baseline - model END, 6) AS gain FROM long""")
def model_comparison(spark, d):
    rows = predicted(spark, d).withColumn("b", F.col("log_lifetime") + 0.2)
    model = metrics.metrics_long(metrics.regression_metrics(rows, "log_lifetime", "p").select("rmse_log", "mae_log", "r2_log"))
    base = metrics.metrics_long(metrics.regression_metrics(rows, "log_lifetime", "b"))
    return rounded(metrics.compare_models(model, base), 6, "model", "baseline", "gain")


@query("calibrate_weight", f"""
WITH {PRED_CTE}, e AS (SELECT y - p AS e, -0.7e0 * (p - y) + 0.01e0 AS r FROM yp),
g AS (SELECT i * 0.05e0 AS w FROM range(41) t(i)),
s AS (SELECT sum(e * e) AS ee, sum(e * r) AS er, sum(r * r) AS rr, count(*) AS n FROM e)
SELECT round(w, 6) AS weight, round(sqrt((ee - 2 * w * er + w * w * rr) / n), 6) AS rmse FROM g, s ORDER BY rmse, weight LIMIT 1""")
def calibrate_weight(spark, d):
    rows = predicted(spark, d).withColumn("r", -0.7 * (F.col("p") - F.col("log_lifetime")) + 0.01)
    return rounded(metrics.calibrate_weight(rows, "log_lifetime", "p", "r"), 6, "weight", "rmse")


@query("objective_stats", "SELECT l_returnflag, round(avg(l_quantity), 6) AS avg, max(l_quantity) AS max, min(l_quantity) AS min FROM lineitem GROUP BY ALL")
def objective_stats(spark, d):
    return rounded(stats.objective_stats(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), 6, "avg")


@query("member_spread", f"""
WITH m AS (SELECT {KEYS}, [l_quantity, l_quantity + 10 * l_tax, 2 * l_quantity, 30e0] AS x FROM lineitem)
SELECT {KEYS}, round(list_avg(x), 6) AS member_mean, round(list_stddev_pop(x), 6) AS member_std FROM m""")
def member_spread(spark, d):
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(*KEY, F.array(q, q + 10.0 * F.col("l_tax"), 2.0 * q, F.lit(30.0)).alias("x"))
    return rounded(rows.select(*KEY, *stats.member_stats("x")), 6, "member_mean", "member_std")


@query("mean_by_feature", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM lineitem" for c in NUMBERS))
def mean_by_feature(spark, d):
    return rounded(stats.mean_by_feature(table(spark, d, "lineitem"), NUMBERS), 6, "mean")


@query("covariance_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 5) AS cov FROM (SELECT l_quantity, l_extendedprice / 1000 AS l_extendedprice, l_discount, l_tax FROM lineitem)"
    for a in NUMBERS for b in NUMBERS))
def covariance_pairs(spark, d):
    m = stats.moments(table(spark, d, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000), NUMBERS)
    rows = [(a, b, m.cov[i][j]) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS)]
    return rounded(spark.createDataFrame(rows, "a string, b string, cov double"), 5, "cov")


@query("median_scenario", "SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in NUMBERS) + " FROM lineitem")
def median_scenario(spark, d):
    medians = stats.median_row(table(spark, d, "lineitem"), NUMBERS)
    return rounded(spark.createDataFrame([tuple(medians.values())], ", ".join(f"{c} double" for c in NUMBERS)), 6, *NUMBERS)


@query("suggest_params", """
SELECT round_even(min(l_extendedprice) FILTER (l_extendedprice > 0), 1) AS stress_min, round_even(max(l_extendedprice), 1) AS stress_max,
       round_even(median(l_extendedprice), 1) AS fixed_stress, round_even(min(l_quantity * 7.3e0), 0)::INT AS temp_min,
       round_even(max(l_quantity * 7.3e0), 0)::INT AS temp_max, round_even(median(l_quantity * 7.3e0), 0)::INT AS fixed_temp FROM lineitem""")
def suggest_params(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").cast("string").alias(" Rupture_Stress"), (F.col("l_quantity") * 7.3).alias("Test_Temp"))
    return stats.suggest_params(rows)


# --- ranks and indexes --------------------------------------------------------------

@query("average_rank", """
WITH r AS (SELECT l_extendedprice AS v, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS rank FROM lineitem)
SELECT v, any_value(rank) AS rank, count(*) AS n FROM r GROUP BY v""")
def average_rank(spark, d):
    return order.average_ranks(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v")), "v")


@query("spearman_rank", f"""
WITH t AS ({lines_sql(CONDITIONS)}), s AS (SELECT temp / 1000 * log10(stress + 1) AS a, round(log_lifetime, 3) AS b FROM t),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM s)
SELECT round(corr(ra, rb), 6) AS spearman FROM r""")
def spearman_rank(spark, d):
    rows = tests(spark, d).select(
        (F.col("temp") / 1000 * F.log10(F.col("stress") + 1)).alias("a"), rnd("log_lifetime", 3).alias("b"))
    return rounded(order.spearman(rows, "a", "b"), 6, "spearman")


@query("distance_percentile", """
WITH c AS (SELECT s_suppkey, abs(s_acctbal) * 10 AS dist FROM supplier),
t AS (SELECT dist, sum(train) OVER (ORDER BY dist) AS cum, train FROM (
  SELECT l_extendedprice AS dist, 1 AS train FROM lineitem UNION ALL SELECT dist, 0 FROM c))
SELECT s_suppkey, round(100e0 * max(cum) / (SELECT count(*) FROM lineitem), 6) AS ood_percentile
FROM c JOIN t USING (dist) GROUP BY s_suppkey""")
def distance_percentile(spark, d):
    candidates = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") * 10).alias("dist"))
    training = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("dist"))
    out = ranks.distance_percentile(candidates, training, "dist")
    return rounded(out.select("s_suppkey", "ood_percentile"), 6, "ood_percentile")


@query("dense_row_index", f"SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) - 1 AS row_index FROM lineitem")
def dense_row_index(spark, d):
    return order.dense_index(table(spark, d, "lineitem").select(*KEY), KEY, "row_index")


# --- sets -----------------------------------------------------------------------------

ROUND_KEYS = {"a": "l_discount", "b": "l_tax / 3e0", "c": "l_linenumber / 7e0"}


@query("dedup_rounded", f"""
WITH r AS ({lines_sql(ROUND_KEYS)})
SELECT {KEYS} FROM r QUALIFY row_number() OVER (PARTITION BY round_even(a, 4), round_even(b, 4), round_even(c, 4) ORDER BY {KEYS}) = 1""")
def dedup_rounded(spark, d):
    return stats.dedup_rounded(lines(spark, d, ROUND_KEYS), ["a", "b", "c"], KEY).select(*KEY)


@query("dedup_batches", f"""
WITH r AS ({lines_sql({'a': 'l_extendedprice / 30011e0', 'b': 'l_discount'}, extra=['l_linestatus'])}),
k AS (SELECT *, round_even(a, 2) AS ka, round_even(b, 2) AS kb FROM r)
SELECT {KEYS} FROM k WHERE l_linestatus = 'O' AND (ka, kb) NOT IN (SELECT (ka, kb) FROM k WHERE l_linestatus = 'F' AND b < 0.05)
QUALIFY row_number() OVER (PARTITION BY ka, kb ORDER BY {KEYS}) = 1 ORDER BY {KEYS} LIMIT 30""")
def dedup_batches(spark, d):
    rows = lines(spark, d, {"a": "l_extendedprice / 30011e0", "b": "l_discount"}, extra=["l_linestatus"])
    known = rows.filter("l_linestatus = 'F' AND b < 0.05")
    return stats.dedup_batches(rows.filter("l_linestatus = 'O'"), known, ["a", "b"], KEY, 30, 2).select(*KEY)


@query("replicated_rows", "SELECT p_partkey, i AS copy FROM part, range(4) t(i)")
def replicated_rows(spark, d):
    return stats.replicate(table(spark, d, "part").select("p_partkey"), 4)


