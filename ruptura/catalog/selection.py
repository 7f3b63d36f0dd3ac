"""Queries: ranking, selection, Pareto front, diversity and candidate summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruptura.catalog.physics import BUDGET, DRAW_SQL, drawn, phase_table, repair_sql, round_sql
from ruptura.catalog.standins import COST_SQL, KEY, KEYS, alloys, alloys_sql, metallurgy_ctes, query, rounded, table
from ruptura.constants import DESIGN_BOUNDS, DESIGN_ELEMENTS, MIN_DISTANCE, POPULATION_SIZE
from ruptura.operators.order import dense_index
from ruptura.operators import composition, diversity, pareto, penalties, selection
from ruptura.plans import design
from ruptura.plans.ood import OodModel, build_reference

ID_SQL = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
LIFE_SQL = "3e0 + 0.3e0 * \"W\" + 0.2e0 * \"Cr\" - 2e0 * \"C\""


def candidates(spark, d):
    """Alloys of all order lines with penalties, cost and a stand-in life."""
    df = penalties.metallurgy(composition.full_composition(alloys(spark, d)))
    return df.select(
        F.concat_ws("-", *KEY).alias("candidate_id"), *KEY, "metallurgy_penalty",
        F.col("metallurgy_penalty").alias("physics_risk"), composition.material_cost().alias("material_cost"),
        (3.0 + 0.3 * F.col("W") + 0.2 * F.col("Cr") - 2.0 * F.col("C")).alias("predicted_log_life"),
        (F.col("l_linenumber") == 7).alias("ood_is_out_of_distribution"),
        (F.col("l_linenumber") != 6).alias("thermo_success"),
        F.when(F.col("l_linenumber") == 5, F.col("N")).otherwise(0.0).alias("laves_fraction"),
        F.when(F.col("l_linenumber") == 4, F.col("B")).otherwise(0.0).alias("sigma_fraction"))


CAND_SQL = f"""{metallurgy_ctes(alloys_sql())}, cand AS (SELECT {ID_SQL} AS candidate_id, {KEYS}, metallurgy_penalty,
  metallurgy_penalty AS physics_risk, {COST_SQL} AS material_cost, {LIFE_SQL} AS predicted_log_life,
  l_linenumber = 7 AS ood_out, l_linenumber <> 6 AS thermo_success,
  CASE WHEN l_linenumber = 5 THEN "N" ELSE 0e0 END AS laves_fraction, CASE WHEN l_linenumber = 4 THEN "B" ELSE 0e0 END AS sigma_fraction FROM met)"""


def scored_sql(thermo: bool, limit: float) -> str:
    flag = "CASE WHEN thermo_success THEN 0 ELSE 100e0 END" if thermo else "0"
    note = "CASE WHEN NOT thermo_success THEN 'thermo_success=False' END, " if thermo else ""
    return f"""sc AS (SELECT *, physics_risk + metallurgy_penalty + CASE WHEN ood_out THEN 100e0 ELSE 0 END + {flag}
  + CASE WHEN laves_fraction > 0.02 THEN 10 * (laves_fraction - 0.02) ELSE 0 END
  + CASE WHEN sigma_fraction > 1e-6 THEN 20 * sigma_fraction ELSE 0 END AS score,
  concat_ws('; ', CASE WHEN physics_risk > 1e-9 THEN printf('physics_risk=%.4f', physics_risk) END,
   CASE WHEN metallurgy_penalty > 1e-9 THEN printf('metallurgy_penalty=%.4f', metallurgy_penalty) END,
   CASE WHEN ood_out THEN 'ood_is_out_of_distribution=True' END, {note}
   CASE WHEN laves_fraction > 0.02 THEN printf('laves_fraction=%.6f', laves_fraction) END,
   CASE WHEN sigma_fraction > 1e-6 THEN printf('sigma_fraction=%.6f', sigma_fraction) END) AS notes,
  material_cost <= {limit}e0 AS cost_ok, greatest(0e0, material_cost - {limit}e0) AS excess FROM cand)"""


@query("violation_score", f"""
WITH {CAND_SQL}, {scored_sql(True, 1.9)}
SELECT {KEYS}, round(score, 5) AS score, notes, cost_ok, round(excess, 6) AS excess FROM sc""")
def violation_score(spark, d):
    rows = selection.assess(candidates(spark, d), 1.9, True)
    out = rows.select(*KEY, F.col("selection_physical_score").alias("score"),
                      F.array_join("selection_physical_violations", "; ").alias("notes"),
                      F.col("selection_cost_ok").alias("cost_ok"), F.col("selection_cost_excess").alias("excess"))
    return rounded(rounded(out, 5, "score"), 6, "excess")


@query("valid_candidates", f"WITH {CAND_SQL}, {scored_sql(True, 1.9)} SELECT {KEYS} FROM sc WHERE score <= 1e-9 AND notes = ''")
def valid_candidates(spark, d):
    rows = candidates(spark, d)
    return rows.filter(selection.is_valid(rows, True)).select(*KEY)


RANK_SQL = "score, predicted_log_life DESC, cost_ok DESC, excess, material_cost, candidate_id"


@query("rank_candidates", f"""
WITH {CAND_SQL}, {scored_sql(False, 1.9)}
SELECT candidate_id, round(score, 5) AS score, round(predicted_log_life, 6) AS predicted_log_life, round(material_cost, 6) AS material_cost,
  row_number() OVER (ORDER BY {RANK_SQL}) - 1 AS place FROM sc""")
def rank_candidates(spark, d):
    ranked = dense_index(selection.rank_candidates(candidates(spark, d), 1.9, False), None, "place")
    out = ranked.select("candidate_id", "place", F.col("selection_physical_score").alias("score"), "predicted_log_life", "material_cost")
    return rounded(rounded(out, 5, "score"), 6, "predicted_log_life", "material_cost")


@query("top_candidates", f"""
WITH {CAND_SQL}, {scored_sql(True, 1.9)}
SELECT candidate_id, round(material_cost, 6) AS material_cost FROM (SELECT * FROM sc ORDER BY {RANK_SQL} LIMIT 5)""")
def top_candidates(spark, d):
    top = selection.top_candidates(selection.rank_candidates(candidates(spark, d), 1.9, True), 5)
    return rounded(top.select("candidate_id", "material_cost"), 6, "material_cost")


@query("select_best_band", f"""
WITH {CAND_SQL}, {scored_sql(True, 1.9)}, v AS (SELECT * FROM sc WHERE score <= 1e-9 AND notes = '')
SELECT candidate_id, round(predicted_log_life, 6) AS predicted_log_life, round(material_cost, 6) AS material_cost,
       'physical validity >= predicted life > target cost satisfaction' AS selection_policy
FROM (SELECT * FROM v WHERE (SELECT max(predicted_log_life) FROM v) - predicted_log_life <= 0.03
ORDER BY cost_ok DESC, excess, material_cost, predicted_log_life DESC, candidate_id LIMIT 1)""")
def select_best_band(spark, d):
    best = selection.select_best(candidates(spark, d), 1.9)
    out = best.select("candidate_id", "predicted_log_life", "material_cost", "selection_policy")
    return rounded(out, 6, "predicted_log_life", "material_cost")


@query("select_best_fallback", f"""
WITH {CAND_SQL.replace('metallurgy_penalty AS physics_risk', 'metallurgy_penalty + 1e0 AS physics_risk')}, {scored_sql(False, 1.9)}
SELECT candidate_id, round(score, 5) AS score, 'fallback: minimum physical violation score > maximum life > cost' AS selection_policy
FROM (SELECT * FROM sc ORDER BY {RANK_SQL} LIMIT 1)""")
def select_best_fallback(spark, d):
    worse = candidates(spark, d).withColumn("physics_risk", F.col("physics_risk") + 1.0)
    best = selection.select_best(worse, 1.9)
    return rounded(best.select("candidate_id", F.col("selection_physical_score").alias("score"), "selection_policy"), 5, "score")


@query("prescreen_topn", """
SELECT o_orderkey AS candidate_id, o_totalprice FROM orders
ORDER BY o_orderpriority, o_totalprice DESC, o_custkey, o_orderkey LIMIT 10""")
def prescreen_topn(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "candidate_id")
    return selection.prescreen(rows, 10, "o_orderpriority", "o_totalprice", "o_custkey").select("candidate_id", "o_totalprice")


@query("sorted_table", """
SELECT p_partkey, p_retailprice,
  row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END DESC NULLS LAST, p_partkey) - 1 AS place FROM part""")
def sorted_table(spark, d):
    rows = table(spark, d, "part").withColumn(
        "key", F.when(F.col("p_size") > 40, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    ordered = dense_index(selection.sort_candidates(rows, "key", False, ["p_partkey"]), None, "place")
    return ordered.select("p_partkey", "p_retailprice", "place")


def front_sql(source: str, cols: dict[str, str]) -> str:
    better = " AND ".join(f"b.{c} {'<=' if w == 'min' else '>='} a.{c}" for c, w in cols.items())
    strict = " OR ".join(f"b.{c} <> a.{c}" for c in cols)
    return f"FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE {better} AND ({strict}))"


@query("pareto_front", f"SELECT p_partkey, p_retailprice, p_size {front_sql('part', {'p_retailprice': 'min', 'p_size': 'max'})}")
def pareto_front(spark, d):
    return pareto.pareto_front(table(spark, d, "part"), {"p_retailprice": "min", "p_size": "max"}) \
        .select("p_partkey", "p_retailprice", "p_size")


TRIPLE = {"price": "min", "balance": "max", "age": "min"}


@query("pareto_front_three", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS price, c_acctbal AS balance, (epoch(o_orderdate) / 86400)::BIGINT AS age
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, price, balance, age {front_sql('o', TRIPLE)}""")
def pareto_front_three(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
        F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("age"))
    return pareto.pareto_front(rows, TRIPLE)


@query("pareto_distinct_genes", f"""
WITH u AS (SELECT DISTINCT l_discount, l_tax, l_quantity FROM lineitem)
SELECT l_discount, l_tax, l_quantity {front_sql('u', {'l_discount': 'min', 'l_tax': 'min', 'l_quantity': 'max'})}""")
def pareto_distinct_genes(spark, d):
    rows = table(spark, d, "lineitem").select("l_discount", "l_tax", "l_quantity")
    return pareto.pareto_front(rows, {"l_discount": "min", "l_tax": "min", "l_quantity": "max"}, ["l_quantity"])


GAP_SQL = "sqrt(" + " + ".join(f"(x[{i + 1}] - f[{i + 1}]) ** 2" for i in range(len(DESIGN_ELEMENTS))) + ")"


# Each step keeps the first row left and drops those near it.
@query("diverse_greedy", f"""
WITH RECURSIVE {repair_sql(DRAW_SQL, DESIGN_BOUNDS, BUDGET)},
points AS (SELECT candidate_id, [{', '.join(f'"{e}"' for e in DESIGN_ELEMENTS)}] AS x FROM second),
left_over AS (SELECT 1 AS step, candidate_id, x FROM points
  UNION ALL SELECT step + 1, candidate_id, x
  FROM (SELECT *, first_value(x) OVER (ORDER BY candidate_id) AS f, min(candidate_id) OVER () AS kept FROM left_over)
  WHERE step < {POPULATION_SIZE} AND candidate_id <> kept AND {GAP_SQL} >= {MIN_DISTANCE}),
kept AS (SELECT min(candidate_id) AS candidate_id FROM left_over GROUP BY step)
SELECT candidate_id, {round_sql(DESIGN_ELEMENTS, 8)} FROM second SEMI JOIN kept USING (candidate_id)""")
def diverse_greedy(spark, d):
    found = diversity.diverse(drawn(spark, d), ["candidate_id"]).select("candidate_id", *DESIGN_ELEMENTS)
    return rounded(found, 8, *DESIGN_ELEMENTS)


@query("composition_comparison", f"""
WITH {CAND_SQL}, {scored_sql(True, 1.9)}, best AS (SELECT * FROM alloys SEMI JOIN (SELECT {KEYS} FROM sc ORDER BY {RANK_SQL} LIMIT 1) USING ({KEYS})),
last AS (SELECT * FROM alloys SEMI JOIN (SELECT {KEYS} FROM sc ORDER BY material_cost, candidate_id LIMIT 1) USING ({KEYS}))
""" + " UNION ALL ".join(
    f"SELECT '{e}' AS element, round((SELECT \"{e}\" FROM best), 6) AS best_wt, round((SELECT \"{e}\" FROM last), 6) AS selected_wt"
    for e in DESIGN_ELEMENTS))
def composition_comparison(spark, d):
    rows, wide = candidates(spark, d), alloys(spark, d)
    best = selection.rank_candidates(rows, 1.9, True, top=1).select(*KEY)
    cheap = rows.orderBy("material_cost", "candidate_id").limit(1).select(*KEY)
    out = composition.compare_composition(
        wide.join(F.broadcast(best), KEY, "left_semi"), wide.join(F.broadcast(cheap), KEY, "left_semi"))
    return rounded(out, 6, "best_wt", "selected_wt")


# --- the whole design run -------------------------------------------------------

def life_scorer(df):
    """Stand-in life of a candidate: a Larson-Miller law with a strengthening term."""
    curve = 27.0 + 0.25 * F.col("Mo") + 0.5 * F.col("W") + 4.0 * F.col("V") - 5.0 * F.log10("stress") + 0.2 * F.col("Cr")
    return df.withColumn("predicted_log_life", 1000.0 * curve / F.col("temp") - 20.0)


def design_model(spark, d) -> OodModel:
    """Distance reference from the alloys of all order lines."""
    rows = alloys(spark, d, {"temp": "773.15e0 + 4e0 * l_quantity", "stress": "40e0 + l_extendedprice / 501.3e0",
                             "log_lifetime": "3e0 + l_tax"})
    return build_reference(rows, "l_partkey", KEY)


@query("candidate_summary")
def candidate_summary(spark, d):
    model, phases = design_model(spark, d), phase_table(spark, d)
    out = design.summarize_candidates(drawn(spark, d), life_scorer, model, phases, 873.15, 150.0)
    return out.drop("phase_info")


@query("pareto_export")
def pareto_export(spark, d):
    model = design_model(spark, d)
    scored = design.objectives(drawn(spark, d), life_scorer, model.reference, 1.7, 873.15, 150.0)
    ranked, _ = design.export_pareto(scored, life_scorer, model, phase_table(spark, d), 1.7, 873.15, 150.0)
    return ranked.drop("phase_info")


@query("best_alloy")
def best_alloy(spark, d):
    model = design_model(spark, d)
    scored = design.objectives(drawn(spark, d), life_scorer, model.reference, 1.7, 873.15, 150.0)
    _, best = design.export_pareto(scored, life_scorer, model, phase_table(spark, d), 1.7, 873.15, 150.0)
    return best.drop("phase_info")


