"""Queries: distance from known data, its explanation, and nearest neighbours."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from ruptura.catalog.standins import DESIGN, KEY, KEYS, alloys, lines_sql, query, rounded, table
from ruptura.catalog.stats import cut_sql
from ruptura.operators import neighbors, ood, stats
from ruptura.operators.order import dense_index
from ruptura.plans.ood import OodModel, build_reference, build_reference_raw, ood_report

TWO = ["l_quantity", "l_extendedprice"]
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def cov_name(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def minor_sql(rows: list[int], cols: list[int]) -> str:
    """Determinant of a submatrix of the covariance, as a sum over permutations."""
    if not rows:
        return "1e0"
    terms = []
    for perm in permutations(range(len(cols))):
        sign = (-1) ** sum(perm[a] > perm[b] for a in range(len(perm)) for b in range(a + 1, len(perm)))
        terms.append(f"{'+' if sign > 0 else '-'} " + " * ".join(cov_name(rows[k], cols[perm[k]]) for k in range(len(rows))))
    return "(" + " ".join(terms) + ")"


def reference_sql(features: list[str], source: str = "lineitem") -> str:
    """CTEs s and ref: means, ridged covariance and its inverse by cofactors."""
    d = range(len(features))
    cov = [f"covar_samp({features[i]}, {features[j]}) + {'1e-6' if i == j else '0e0'} AS {cov_name(i, j)}" for i in d for j in d if i <= j]
    mean = [f"avg({f}) AS m{i}" for i, f in enumerate(features)]
    inverse = [
        f"{'' if (i + j) % 2 == 0 else '-1 * '}{minor_sql([r for r in d if r != j], [c for c in d if c != i])} / {minor_sql(list(d), list(d))} AS v{i}{j}"
        for i in d for j in d if i <= j]
    return f"s AS (SELECT {', '.join(mean + cov)} FROM {source}), ref AS (SELECT *, {', '.join(inverse)} FROM s)"


def distance_sql(features: list[str]) -> str:
    d = range(len(features))
    terms = [f"({features[i]} - m{i}) * ({features[j]} - m{j}) * v{min(i, j)}{max(i, j)}" for i in d for j in d]
    return f"sqrt(greatest(0, {' + '.join(terms)}))"


@query("mahalanobis_2d", f"WITH {reference_sql(TWO)} SELECT {KEYS}, round({distance_sql(TWO)}, 6) AS ood_distance FROM lineitem, ref")
def mahalanobis_2d(spark, d):
    rows = table(spark, d, "lineitem")
    ref = ood.fit_reference(rows, TWO)
    return rounded(rows.select(*KEY, ood.mahalanobis(ref).alias("ood_distance")), 6, "ood_distance")


@query("mahalanobis_4d", f"WITH {reference_sql(FOUR)} SELECT {KEYS}, round({distance_sql(FOUR)}, 5) AS ood_distance FROM lineitem, ref")
def mahalanobis_4d(spark, d):
    rows = table(spark, d, "lineitem")
    ref = ood.fit_reference(rows, FOUR)
    return rounded(rows.select(*KEY, ood.mahalanobis(ref).alias("ood_distance")), 5, "ood_distance")


@query("ood_threshold", f"""
WITH {reference_sql(FOUR)}, dist AS (SELECT {distance_sql(FOUR)} AS x FROM lineitem, ref)
SELECT count(*) AS n_rows, round(quantile_cont(x, 0.95), 5) AS threshold, round(avg(x), 5) AS mean_distance, round(max(x), 5) AS max_distance FROM dist""")
def ood_threshold(spark, d):
    ref = ood.fit_reference(table(spark, d, "lineitem"), FOUR)
    row = [(ref.n_rows, ref.threshold, ref.distance_mean, ref.distance_max)]
    out = spark.createDataFrame(row, "n_rows long, threshold double, mean_distance double, max_distance double")
    return rounded(out, 5, "threshold", "mean_distance", "max_distance")


@query("ood_penalty", f"""
WITH {reference_sql(TWO)}, dist AS (SELECT *, {distance_sql(TWO)} AS x FROM lineitem, ref), q AS (SELECT quantile_cont(x, 0.95) AS t FROM dist)
SELECT {KEYS}, round(0.25 * greatest(0, x - t) ** 2, 6) AS ood_penalty, x > t AS is_out FROM dist, q""")
def ood_penalty(spark, d):
    rows = table(spark, d, "lineitem")
    out = ood.ood_penalty(rows, ood.fit_reference(rows, TWO))
    out = out.select(*KEY, "ood_penalty", (F.col("ood_distance") > F.col("ood_distance_threshold")).alias("is_out"))
    return rounded(out, 6, "ood_penalty")


PART2 = {0: "(l_quantity - m0) * ((l_quantity - m0) * v00 + (l_extendedprice - m1) * v01)",
         1: "(l_extendedprice - m1) * ((l_quantity - m0) * v01 + (l_extendedprice - m1) * v11)"}


@query("ood_contributions_2d", f"""
WITH {reference_sql(TWO)}, r AS (SELECT {KEYS}, {PART2[0]} AS r0, {PART2[1]} AS r1 FROM lineitem, ref),
long AS (SELECT {KEYS}, 'l_quantity' AS element, 0 AS i, r0 AS raw, abs(r0) / (abs(r0) + abs(r1)) AS share FROM r
   UNION ALL SELECT {KEYS}, 'l_extendedprice', 1, r1, abs(r1) / (abs(r0) + abs(r1)) FROM r)
SELECT {KEYS}, element, row_number() OVER (PARTITION BY {KEYS} ORDER BY abs(raw) DESC, i) AS rank,
       round(raw, 5) AS raw_contribution, round(share, 5) AS abs_share FROM long""")
def ood_contributions_2d(spark, d):
    rows = table(spark, d, "lineitem")
    out = ood.contributions_long(rows, ood.fit_reference(rows, TWO), KEY)
    return rounded(out.select(*KEY, "element", "rank", "raw_contribution", "abs_share"), 5, "raw_contribution", "abs_share")


@query("knn_standardised", """
WITH s AS (SELECT stddev_pop(p_size) AS a, stddev_pop(p_retailprice) AS b FROM part),
z AS (SELECT p_partkey, p_size / a AS x, p_retailprice / b AS y FROM part, s),
pair AS (SELECT c.p_partkey AS candidate, r.p_partkey AS row_index, sqrt((r.x - c.x) ** 2 + (r.y - c.y) ** 2) AS dist FROM z c, z r)
SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY round(dist, 9), row_index) AS rank, round(dist, 6) AS standardized_distance
FROM pair QUALIFY rank <= 5""")
def knn_standardised(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    std = stats.moments(rows, ["p_size", "p_retailprice"]).std
    found = neighbors.nearest_neighbors(rows, rows, ["p_size", "p_retailprice"], 5, "p_partkey", "p_partkey", std)
    return rounded(found.select(F.col("p_partkey").alias("candidate"), "rank", "standardized_distance"), 6, "standardized_distance")


# Whole numbers without scaling: distances are exact, so ties and the rows found are comparable.
@query("knn_rows", """
WITH z AS (SELECT p_partkey, p_size::DOUBLE AS x, floor(p_retailprice) AS y FROM part),
pair AS (SELECT c.p_partkey AS candidate, r.p_partkey AS row_index, sqrt((r.x - c.x) ** 2 + (r.y - c.y) ** 2) AS dist, r.x AS ref_size, r.y AS ref_price FROM z c, z r)
SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY dist, row_index) AS rank, row_index, round(dist, 6) AS standardized_distance, ref_size, ref_price
FROM pair QUALIFY rank <= 5""")
def knn_rows(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.floor("p_retailprice").cast("double").alias("price"))
    found = neighbors.nearest_neighbors(rows.withColumnRenamed("p_partkey", "candidate"), rows, ["size", "price"], 5, "candidate", "p_partkey")
    return rounded(found.select("candidate", "rank", "row_index", "standardized_distance", "ref_size", "ref_price"), 6, "standardized_distance")


def _report_sql() -> str:
    d = range(4)
    inverse = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    raw = [f"({f} - m{i}) * (" + " + ".join(f"({FOUR[j]} - m{j}) * {inverse(i, j)}" for j in d) + ")" for i, f in enumerate(FOUR)]
    gap = " + ".join(f"(r.{f} / s{i} - c.{f} / s{i}) ** 2" for i, f in enumerate(FOUR))
    parts = " UNION ALL ".join(f"SELECT candidate_id, '{f}' AS element, {i} AS i, {raw[i]} AS raw FROM prof, ref" for i, f in enumerate(FOUR))
    return f"""
WITH {reference_sql(FOUR)},
prof AS (SELECT l_suppkey AS candidate_id, {', '.join(f'avg({f}) AS {f}' for f in FOUR)} FROM lineitem GROUP BY 1),
dist AS (SELECT {distance_sql(FOUR)} AS x FROM lineitem, ref), q AS (SELECT quantile_cont(x, 0.95) AS t, count(*) AS n FROM dist),
own AS (SELECT candidate_id, {distance_sql(FOUR)} AS x FROM prof, ref),
told AS (SELECT candidate_id, own.x, t, 100e0 * (SELECT count(*) FROM dist WHERE dist.x <= own.x) / n AS p FROM own, q),
idx AS (SELECT row_number() OVER (ORDER BY {KEYS}) - 1 AS row_index, {', '.join(FOUR)} FROM lineitem),
sd AS (SELECT {', '.join(f'stddev_pop({f}) AS s{i}' for i, f in enumerate(FOUR))} FROM lineitem),
near AS (SELECT candidate_id, row_index, sqrt({gap}) AS gap FROM prof c, idx r, sd),
five AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY gap, row_index) AS rank FROM near QUALIFY rank <= 5),
part_ AS ({parts}), ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY abs(raw) DESC, i) AS rank FROM part_)
SELECT candidate_id, rank, round(x, 5) AS ood_distance, round(t, 5) AS ood_distance_threshold, round(p, 6) AS ood_percentile,
  x > t AS ood_is_out_of_distribution, row_index, round(gap, 5) AS standardized_distance, element, round(raw, 5) AS raw_contribution
FROM five JOIN told USING (candidate_id) LEFT JOIN ranked USING (candidate_id, rank)"""


@query("ood_report", _report_sql())
def report(spark, d):
    """Supplier profiles (mean of their order lines) against all order lines: a row for each neighbour, with the effect of its rank."""
    rows = table(spark, d, "lineitem")
    ref = ood.fit_reference(rows, FOUR)
    indexed = dense_index(rows.select(*KEY, *FOUR), KEY, "row_index").drop(*KEY)
    model = OodModel(ref, rows.select(ood.mahalanobis(ref).alias("ood_distance")), indexed)
    profiles = rows.groupBy(F.col("l_suppkey").alias("candidate_id")).agg(*[F.avg(c).alias(c) for c in FOUR])
    told = ood_report(profiles, model)
    effect = F.get(F.col("ood_top_contributors"), F.col("n.rank") - 1)
    out = told.withColumn("n", F.explode("nearest_neighbors")).select(
        "candidate_id", "n.rank", "ood_distance", "ood_distance_threshold", "ood_percentile", "ood_is_out_of_distribution",
        "n.row_index", "n.standardized_distance", effect["element"].alias("element"), effect["raw_contribution"].alias("raw_contribution"))
    return rounded(rounded(out, 5, "ood_distance", "ood_distance_threshold", "standardized_distance", "raw_contribution"), 6, "ood_percentile")


LOGGED = {"temp": "773.15e0 + 4e0 * l_quantity", "stress": "40e0 + l_extendedprice / 501.3e0", "log_lifetime": "3e0 + l_tax"}


DESIGN_TOTAL = "(" + " + ".join(f'"{e}"' for e in DESIGN) + ")"
REFERENCE_COLUMNS = [*DESIGN, "stress", "temp", "log_life", "total_alloy", "fe_balance"]


@query("ood_reference_build", f"""
WITH {cut_sql('lineitem', 'l_partkey', 42, 'picked', '0.2e0')},
a AS (SELECT *, log_lifetime AS log_life, {DESIGN_TOTAL} AS total_alloy, greatest(0e0, 100e0 - {DESIGN_TOTAL}) AS fe_balance
  FROM ({lines_sql(DESIGN, LOGGED)}) WHERE l_partkey NOT IN (SELECT k FROM picked)),
f AS (SELECT * FROM a WHERE "Cr" BETWEEN 8 AND 12 AND "Ni" BETWEEN 0 AND 2 AND fe_balance >= 80 AND total_alloy <= 20)
SELECT {', '.join(f'round("{c}", 6) AS "{c}"' for c in REFERENCE_COLUMNS)}, row_number() OVER (ORDER BY {KEYS}) - 1 AS row_index FROM f""")
def ood_reference_build(spark, d):
    model = build_reference(alloys(spark, d, LOGGED), "l_partkey", KEY)
    return rounded(model.rows, 6, *REFERENCE_COLUMNS)


@query("ood_reference_raw")
def ood_reference_raw(spark, d):
    ref = build_reference_raw(alloys(spark, d))
    rows = [(i, f, ref.mean[i], ref.std[i], list(ref.cov_inv[i]), ref.threshold) for i, f in enumerate(ref.features)]
    return spark.createDataFrame(rows, "idx int, feature string, mean double, std double, cov_inv array<double>, threshold double")


