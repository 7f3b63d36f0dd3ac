"""Queries: Larson-Miller fits, augmentation and the baseline run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruptura.catalog.standins import CONDITIONS, HEAT, KEY, LOG_LIFE, STRESS, TEMP, lines, lines_sql, query, rnd, rounded, tests
from ruptura.catalog.stats import METRIC_ROUND, METRIC_SQL, cut_sql, round_metrics
from ruptura.operators import lmp
from ruptura.operators.stats import Scaler
from ruptura.plans.training import clean_tests, preprocess, run_lmp_baseline

GRID_SQL = "grid AS (SELECT 10e0 + i * 0.25e0 AS c FROM range(81) t(i))"


def fits_sql(source: str, by: str = "1") -> str:
    """CTEs for the two-pass fit: a line per constant, then its error on the rows."""
    return f"""rows_ AS (SELECT *, log10(stress) AS x, {by} AS g FROM ({source})), {GRID_SQL},
line AS (SELECT g, c, regr_slope(temp * (c + log_lifetime) / 1000, x) AS a, regr_intercept(temp * (c + log_lifetime) / 1000, x) AS b,
                count(*) AS n FROM rows_, grid GROUP BY g, c),
err AS (SELECT g, c, a, b, any_value(n) AS n, sqrt(avg((1000 * (a * x + b) / temp - c - log_lifetime) ** 2)) AS rmse
        FROM rows_ JOIN line USING (g) GROUP BY g, c, a, b)"""


@query("lmp_grid_fit", f"WITH {fits_sql(lines_sql(CONDITIONS))} SELECT c AS c_value, round(a, 5) AS slope, round(b, 5) AS intercept, round(rmse, 5) AS rmse_log FROM err")
def lmp_grid_fit(spark, d):
    return rounded(lmp.lmp_grid(tests(spark, d)), 5, "slope", "intercept", "rmse_log")


BY_GROUP = {"temp": TEMP, "stress": STRESS, "log_lifetime": f"{LOG_LIFE} + 0.02e0 * (l_linenumber % 3)"}


@query("lmp_fit_by_group", f"""
WITH {fits_sql(lines_sql(BY_GROUP), 'l_partkey')}, best AS (
  SELECT * FROM err WHERE a < 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY rmse, c) = 1),
sizes AS (SELECT g, count(*) AS n_rows FROM rows_ GROUP BY g HAVING count(*) >= 5)
SELECT g AS l_partkey, n_rows, c AS c_value, round(a, 4) AS slope, round(b, 4) AS intercept, round(rmse, 5) AS rmse_log,
       coalesce(rmse <= 0.35, false) AS accepted FROM sizes LEFT JOIN best USING (g)""")
def lmp_fit_by_group(spark, d):
    fits = lmp.fit_lmp_by_group(lines(spark, d, BY_GROUP), ["l_partkey"])
    out = fits.select("l_partkey", "n_rows", "c_value", "slope", "intercept", "rmse_log", "accepted")
    return rounded(rounded(out, 4, "slope", "intercept"), 5, "rmse_log")


@query("lmp_fit_summary", f"""
WITH {fits_sql(lines_sql(BY_GROUP), 'l_partkey')}, best AS (SELECT g, min(rmse) AS rmse FROM err WHERE a < 0 GROUP BY g),
sizes AS (SELECT g FROM rows_ GROUP BY g HAVING count(*) >= 5)
SELECT count(*) AS fit_groups_total, count(*) FILTER (rmse <= 0.35) AS fit_groups_accepted,
       round(count(*) FILTER (rmse <= 0.35) / count(*), 6) AS fit_acceptance_rate FROM sizes LEFT JOIN best USING (g)""")
def lmp_fit_summary(spark, d):
    fits = lmp.fit_lmp_by_group(lines(spark, d, BY_GROUP), ["l_partkey"])
    return rounded(lmp.fit_summary(fits), 6, "fit_acceptance_rate")


@query("augmented_union", f"""
WITH {fits_sql(lines_sql(BY_GROUP), 'l_partkey')}, best AS (SELECT g, min(rmse) AS rmse FROM err WHERE a < 0 GROUP BY g),
sizes AS (SELECT g, count(*) AS n FROM rows_ GROUP BY g HAVING count(*) >= 5)
SELECT l_partkey, false AS is_synthetic, count(*) AS n_rows FROM lineitem GROUP BY ALL
UNION ALL SELECT g, true, least(n, 20) FROM sizes JOIN best USING (g) WHERE rmse <= 0.35""")
def augmented_union(spark, d):
    both, _ = lmp.augment(lines(spark, d, BY_GROUP), ["l_partkey"], 42)
    return both.groupBy("l_partkey", "is_synthetic").agg(F.count(F.lit(1)).alias("n_rows"))


def unit_sql(name: str) -> str:
    return f"('0x' || substr(md5('42:{name}:' || g || ':' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0"


@query("augment_lmp", f"""
WITH {fits_sql(lines_sql(BY_GROUP), 'l_partkey')}, best AS (
  SELECT * FROM err WHERE a < 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY rmse, c) = 1),
span AS (SELECT g, count(*) AS n_rows, min(temp) AS tl, max(temp) AS th, min(stress) AS sl, max(stress) AS sh FROM rows_ GROUP BY g HAVING count(*) >= 5),
made AS (SELECT g, unnest(range(1, least(n_rows, 20) + 1)) AS i, tl, th, sl, sh, a, b, c FROM span JOIN best USING (g) WHERE rmse <= 0.35),
placed AS (SELECT *, tl + {unit_sql('temp')} * (th - tl) AS temp, sl + {unit_sql('stress')} * (sh - sl) AS stress FROM made)
SELECT g AS l_partkey, i AS synthetic_no, round(temp, 5) AS temp, round(stress, 5) AS stress,
       round(1000 * (a * log10(stress) + b) / temp - c, 4) AS log_lifetime FROM placed""")
def augment_lmp(spark, d):
    fits = lmp.fit_lmp_by_group(lines(spark, d, BY_GROUP), ["l_partkey"])
    made = lmp.synthesize(fits, ["l_partkey"], 42)
    out = made.select("l_partkey", "synthetic_no", "temp", "stress", "log_lifetime")
    return rounded(rounded(out, 5, "temp", "stress"), 4, "log_lifetime")


@query("synthetic_outside_bounds", "SELECT 0 AS n_outside")
def synthetic_outside_bounds(spark, d):
    fits = lmp.fit_lmp_by_group(lines(spark, d, BY_GROUP), ["l_partkey"])
    outside = lmp.outside_source_bounds(lmp.synthesize(fits, ["l_partkey"], 42), fits, ["l_partkey"])
    return outside.agg(F.count(F.lit(1)).alias("n_outside"))


@query("lmp_baseline", f"""
WITH t AS ({lines_sql(CONDITIONS)}), {cut_sql('t', 'l_partkey', 42, 'picked', '0.2e0')},
train AS (SELECT * FROM t WHERE l_partkey NOT IN (SELECT k FROM picked)), test AS (SELECT * FROM t WHERE l_partkey IN (SELECT k FROM picked)),
{fits_sql('SELECT * FROM train')}, best AS (SELECT * FROM err WHERE a < 0 ORDER BY rmse, c LIMIT 1),
yp AS (SELECT log_lifetime AS y, 1000 * (a * log10(stress) + b) / temp - c AS p FROM test, best),
m AS (SELECT {METRIC_SQL} FROM yp)
SELECT c AS c_value, round(a, 5) AS slope, round(b, 5) AS intercept, {METRIC_ROUND} FROM m, best""")
def lmp_baseline(spark, d):
    run = run_lmp_baseline(tests(spark, d), "l_partkey")
    fit = run.fit
    return round_metrics(run.test_metrics).withColumns({
        "c_value": F.lit(fit.c_value), "slope": rnd(F.lit(fit.coefficients[0]), 5),
        "intercept": rnd(F.lit(fit.coefficients[1]), 5)})


@query("lmp_baseline_predictions", f"""
WITH t AS ({lines_sql(CONDITIONS)}), {cut_sql('t', 'l_partkey', 42, 'picked', '0.2e0')},
train AS (SELECT * FROM t WHERE l_partkey NOT IN (SELECT k FROM picked)), test AS (SELECT * FROM t WHERE l_partkey IN (SELECT k FROM picked)),
{fits_sql('SELECT * FROM train')}, best AS (SELECT * FROM err WHERE a < 0 ORDER BY rmse, c LIMIT 1)
SELECT round(stress, 5) AS stress, temp, round(log_lifetime, 5) AS y_true_log,
       round(1000 * (a * log10(stress) + b) / temp - c, 5) AS y_pred_log FROM test, best""")
def lmp_baseline_predictions(spark, d):
    run = run_lmp_baseline(tests(spark, d), "l_partkey")
    out = run.predictions.select("stress", "temp", "y_true_log", "y_pred_log")
    return rounded(out, 5, "stress", "y_true_log", "y_pred_log")


RAW_TESTS = {
    "lifetime": f"pow(10e0, {LOG_LIFE})", "stress": STRESS, "temp": TEMP,
    "C": "CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END", "Cr": "8e0 + (l_partkey % 40) / 10e0", **HEAT,
}


@query("preprocess", f"""
WITH r AS ({lines_sql(RAW_TESTS)}), f AS (SELECT *, coalesce("C", 0e0) AS c0 FROM r),
k AS (SELECT *, printf('%.2f', c0) AS ck, "Cr"::VARCHAR AS rk FROM f)
SELECT count(*) AS n_rows, count(DISTINCT (c0, "Cr")) AS n_groups, 0 AS n_leaked,
       true AS train_centred FROM k""")
def preprocess_run(spark, d):
    raw = lines(spark, d, RAW_TESTS).select("l_linenumber", *RAW_TESTS)
    done = preprocess(raw.drop("l_linenumber"))
    groups = done.train.select("composition_group").distinct().withColumn("side", F.lit(1)).unionByName(
        done.test.select("composition_group").distinct().withColumn("side", F.lit(2)))
    per_group = groups.groupBy("composition_group").agg(F.count(F.lit(1)).alias("n"))
    counted = per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_leaked"))
    centred = done.train.agg(*[F.avg(c).alias(c) for c in ("stress", "temp", "Cr")])
    rows = done.train.unionByName(done.test).agg(F.count(F.lit(1)).alias("n_rows"))
    ok = centred.select((F.greatest(*[F.abs(c) for c in ("stress", "temp", "Cr")]) < 1e-6).alias("train_centred"))
    first = [x.first()[0] for x in (rows, ok)]
    return counted.withColumns({"n_rows": F.lit(first[0]), "train_centred": F.lit(first[1])})


@query("preprocess_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({sa}, {sb}), 5) AS corr FROM lineitem"
    for a, sa in (("stress", STRESS), ("temp", TEMP), ("log_lifetime", f"log10(pow(10e0, {LOG_LIFE}))"))
    for b, sb in (("stress", STRESS), ("temp", TEMP), ("log_lifetime", f"log10(pow(10e0, {LOG_LIFE}))"))))
def preprocess_correlation(spark, d):
    raw = lines(spark, d, RAW_TESTS).select(*RAW_TESTS)
    from ruptura.operators.stats import correlation_pairs

    return rounded(correlation_pairs(clean_tests(raw), ["stress", "temp", "log_lifetime"]), 5, "corr")


@query("scaled_training_side", f"""
WITH r AS ({lines_sql(CONDITIONS)}), {cut_sql('r', 'l_suppkey', 42, 'picked', '0.2e0')},
m AS (SELECT avg(temp) AS tm, stddev_pop(temp) AS ts, avg(stress) AS sm, stddev_pop(stress) AS ss FROM r WHERE l_suppkey NOT IN (SELECT k FROM picked))
SELECT {', '.join(KEY)}, round((temp - tm) / ts, 6) AS temp, round((stress - sm) / ss, 6) AS stress FROM r, m""")
def scaled_training_side(spark, d):
    from ruptura.operators.split import group_holdout

    rows = lines(spark, d, CONDITIONS)
    scaler = Scaler.fit(group_holdout(rows, "l_suppkey").train(rows), ["temp", "stress"])
    return rounded(scaler.transform(rows).select(*KEY, "temp", "stress"), 6, "temp", "stress")


