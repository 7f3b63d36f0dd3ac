"""Queries: features, compositions, penalties, phases, repair and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruptura.catalog.standins import (
    BALANCE_SQL, CONDITIONS, COST_SQL, DESIGN, HEAT, INDEX_SQL, KEY, KEYS, PENALTY_OF, TOTAL_SQL, alloys,
    alloys_sql, excess_sql, lines, lines_sql, metallurgy_ctes, query, rnd, round_sql, rounded, table,
)
from ruptura.constants import (
    DESIGN_BOUNDS, DESIGN_ELEMENTS, PHYSICS_COLS, STATUS_LIMITS,
)
from ruptura.functions.numeric import half_even, linspace, logspace, polynomial
from ruptura.functions.physics import (
    excess_penalty, larson_miller, life_label, lmp_log_life, severity,
)
from ruptura.operators import composition, features, metrics, penalties, selection, stats
from ruptura.plans.design import evaluate_physics, objectives


def severity_sql(temp: str, time: str, mode: str) -> str:
    hours = f"{time} + 1e-6" if mode == "training" else f"greatest({time}, 1e-6)"
    active = f"{temp} > 0 AND {time} > 0" if mode == "physics" else f"{temp} > 0"
    return f"CASE WHEN {active} THEN {temp} * (20e0 + log10({hours})) ELSE 0e0 END"


@query("heat_severity", f"""
WITH h AS ({lines_sql(HEAT)})
SELECT {KEYS}, """ + ", ".join(
    f'round({severity_sql(f"{chr(34)}{p}temp{chr(34)}", f"{chr(34)}{p}time{chr(34)}", m)}, 5) AS "{p}_{m}"'
    for p in "NTA" for m in ("training", "inference", "physics")) + " FROM h")
def heat_severity(spark, d):
    return lines(spark, d, HEAT).select(*KEY, *[
        rnd(severity(f"{p}temp", f"{p}time", m), 5).alias(f"{p}_{m}")
        for p in "NTA" for m in ("training", "inference", "physics")])


HOT = {"stress": f"CASE WHEN l_linenumber = 1 THEN NULL ELSE {CONDITIONS['stress']} END", "temp": CONDITIONS["temp"]}
SEV_SUM = " + ".join(severity_sql(f'"{p}temp"', f'"{p}time"', "inference") for p in "NTA")


@query("physics_features", f"""
WITH h AS ({lines_sql(HOT, HEAT)}), s AS (SELECT *, greatest(coalesce(stress, 0e0), 1e-9) AS st FROM h)
SELECT {KEYS}, round((temp / 1000e0) * log10(st + 1e0), 6) AS operating_severity,
       round(st * temp / 1000e0, 6) AS stress_temperature_interaction, round(1000e0 / temp, 6) AS inverse_temperature,
       round({SEV_SUM}, 4) AS total_heat_treatment_severity FROM s""")
def physics_features(spark, d):
    out = features.add_physics_features(features.add_severities(lines(spark, d, HOT, HEAT)))
    out = rounded(out, 6, *PHYSICS_COLS[:3])
    return rounded(out, 4, PHYSICS_COLS[3]).select(*KEY, *PHYSICS_COLS)


@query("raw_heat_total", f"""
WITH h AS ({lines_sql(CONDITIONS, HEAT)})
SELECT {KEYS}, round({' + '.join(f'"{c}"' for c in HEAT)}, 5) AS total_heat_treatment_severity FROM h""")
def raw_heat_total(spark, d):
    out = features.add_physics_features(lines(spark, d, CONDITIONS, HEAT))
    return rounded(out, 5, PHYSICS_COLS[3]).select(*KEY, PHYSICS_COLS[3])


@query("scoring_features", f"""
WITH h AS ({lines_sql(CONDITIONS, HEAT, {"Cr": DESIGN["Cr"]})})
SELECT {KEYS}, round(stress, 6) AS stress, temp, round("Cr", 6) AS "Cr", 0e0 AS "Re", "Ntime",
       round({severity_sql('"Ttemp"', '"Ttime"', 'inference')}, 5) AS "T_severity",
       round((temp / 1000e0) * log10(stress + 1e0), 6) AS operating_severity FROM h""")
def scoring_features(spark, d):
    rows = lines(spark, d, CONDITIONS, HEAT, {"Cr": "cast(" + DESIGN["Cr"] + " AS string)"})
    wanted = ["stress", "temp", "Cr", "Re", "Ntime", "T_severity", "operating_severity"]
    out = features.scoring_features(rows, wanted, KEY)
    return rounded(rounded(out, 6, "stress", "Cr", "operating_severity"), 5, "T_severity")


@query("composition_totals", f"""
WITH a AS ({alloys_sql()})
SELECT {KEYS}, round({TOTAL_SQL}, 6) AS total_alloy, round({BALANCE_SQL}, 6) AS fe_balance,
       {TOTAL_SQL} <= 15 AS within_limit FROM a""")
def composition_totals(spark, d):
    full = composition.full_composition(alloys(spark, d))
    return full.select(*KEY, rnd(composition.total_alloy(), 6).alias("total_alloy"),
                       rnd(composition.fe_balance(), 6).alias("fe_balance"),
                       composition.within_total_limit().alias("within_limit"))


@query("larson_miller_curve", f"""
WITH t AS ({lines_sql(CONDITIONS)})
SELECT {KEYS}, round(temp * (20e0 + log_lifetime) / 1000e0, 6) AS lmp,
       round(1000e0 * (0.5e0 * pow(log10(stress), 2) - 5e0 * log10(stress) + 31e0) / temp - 20.5e0, 6) AS curve_life FROM t""")
def larson_miller_curve(spark, d):
    return lines(spark, d, CONDITIONS).select(
        *KEY, rnd(larson_miller("temp", "log_lifetime"), 6).alias("lmp"),
        rnd(lmp_log_life("temp", "stress", 20.5, [0.5, -5.0, 31.0]), 6).alias("curve_life"))


@query("threshold_penalties", f"""
SELECT {KEYS}, round({excess_sql('l_quantity', 25.0, 1.5, 10.0)}, 6) AS upper_penalty,
       round({excess_sql('l_quantity', 25.0, 1.2, 1.0, True)}, 6) AS lower_penalty,
       round(2e0 * pow(greatest(0e0, l_tax - 0.03e0) / 0.5e0, 1.5e0), 8) AS soft_penalty FROM lineitem""")
def threshold_penalties(spark, d):
    return table(spark, d, "lineitem").select(
        *KEY, rnd(excess_penalty("l_quantity", 25.0, "upper", 1.5, 10.0), 6).alias("upper_penalty"),
        rnd(excess_penalty("l_quantity", 25.0, "lower", 1.2, -1.0), 6).alias("lower_penalty"),
        rnd(excess_penalty("l_tax", 0.03, "upper", 2.0, 0.5, 1.5), 8).alias("soft_penalty"))


@query("material_cost", f"WITH a AS ({alloys_sql()}) SELECT {KEYS}, round({COST_SQL}, 6) AS material_cost FROM a")
def material_cost(spark, d):
    full = composition.full_composition(alloys(spark, d))
    return full.select(*KEY, rnd(composition.material_cost(), 6).alias("material_cost"))


PROFILE = [*INDEX_SQL, *PENALTY_OF.values(), "metallurgy_penalty"]


@query("metallurgy_profile", f"WITH {metallurgy_ctes(alloys_sql())} SELECT {KEYS}, {round_sql(PROFILE, 6)} FROM met")
def metallurgy_profile(spark, d):
    scored = penalties.metallurgy(composition.full_composition(alloys(spark, d)))
    return rounded(scored.select(*KEY, *PROFILE), 6, *PROFILE)


RARE = {"Co": "l_tax", "Ta": "0.5e0 * l_discount", "Re": "CASE WHEN l_linenumber = 1 THEN 0.1e0 ELSE 0e0 END"}


@query("element_risk", f"""
WITH a AS ({lines_sql(DESIGN, RARE)})
SELECT {KEYS}, round("Re" + 0.7e0 * "Ta" + 0.5e0 * "Co", 8) AS elemental_ood_penalty,
       round({' + '.join(f'greatest(0e0, {lo}e0 - "{e}") + greatest(0e0, "{e}" - {hi}e0)' for e, (lo, hi) in DESIGN_BOUNDS.items())}, 8)
       AS range_penalty FROM a""")
def element_risk(spark, d):
    return lines(spark, d, DESIGN, RARE).select(
        *KEY, rnd(penalties.elemental_ood(), 8).alias("elemental_ood_penalty"),
        rnd(penalties.range_penalty(DESIGN_BOUNDS), 8).alias("range_penalty"))


WEIGHTS = {"C": 12.011, "Cr": 51.996, "Mo": 95.95, "W": 183.84, "V": 50.942, "Nb": 92.906, "N": 14.007,
           "Mn": 54.938, "Si": 28.085, "Ni": 58.693}
MOLES_SQL = " + ".join(f'greatest("{e}", 0e0) / {w}e0' for e, w in WEIGHTS.items())


@query("mole_fractions", f"""
WITH a AS ({alloys_sql()}), m AS (SELECT *, {BALANCE_SQL} / 55.845e0 AS fe_moles, {MOLES_SQL} AS other FROM a)
SELECT {KEYS}, round(fe_moles / (fe_moles + other), 8) AS "x_Fe",
       """ + ", ".join(f'CASE WHEN "{e}" > 0 THEN round("{e}" / {w}e0 / (fe_moles + other), 8) END AS "x_{e}"'
                       for e, w in WEIGHTS.items()) + ", NULL::VARCHAR AS mole_error FROM m")
def mole_fractions(spark, d):
    cells = ["x_Fe", *[f"x_{e}" for e in WEIGHTS]]
    out = composition.mole_fractions(composition.full_composition(alloys(spark, d)))
    return rounded(out.select(*KEY, *cells, "mole_error"), 8, *cells)


PHASE_SQL = """
phases AS (SELECT l_orderkey AS candidate_id,
  CASE l_linenumber WHEN 1 THEN 'LAVES_PHASE' WHEN 2 THEN 'SIGMA' WHEN 3 THEN 'M23C6' WHEN 4 THEN 'M6C'
                    WHEN 5 THEN 'FCC_A1' WHEN 6 THEN '' ELSE 'BCC_A2' END AS phase,
  CASE WHEN l_linenumber = 7 THEN 9.81e0 * l_quantity ELSE l_discount * (1e0 + l_quantity / 977e0) END AS amount FROM lineitem),
clean AS (SELECT candidate_id, phase, sum(amount) AS a FROM phases
          WHERE phase <> '' AND amount > 1e-12 GROUP BY ALL),
fr AS (SELECT candidate_id,
  coalesce(sum(a) FILTER (phase = 'LAVES_PHASE') / sum(a), 0e0) AS laves_fraction,
  coalesce(sum(a) FILTER (phase = 'SIGMA') / sum(a), 0e0) AS sigma_fraction,
  coalesce(sum(a) FILTER (phase = 'M23C6') / sum(a), 0e0) AS m23c6_fraction,
  coalesce(sum(a) FILTER (phase = 'M6C') / sum(a), 0e0) AS m6c_fraction,
  coalesce(sum(a) FILTER (phase = 'BCC_A2') / sum(a), 0e0) AS bcc_fraction,
  coalesce(sum(a) FILTER (phase = 'FCC_A1') / sum(a), 0e0) AS fcc_fraction FROM clean GROUP BY ALL)"""
FRACTIONS = ["laves_fraction", "sigma_fraction", "m23c6_fraction", "m6c_fraction", "bcc_fraction", "fcc_fraction"]


def phase_table(spark, d):
    names = {1: "LAVES_PHASE", 2: "SIGMA", 3: "M23C6", 4: "M6C", 5: "FCC_A1", 6: ""}
    phase = F.coalesce(*[F.when(F.col("l_linenumber") == i, n) for i, n in names.items()], F.lit("BCC_A2"))
    amount = F.when(F.col("l_linenumber") == 7, 9.81 * F.col("l_quantity")).otherwise(F.col("l_discount") * (1.0 + F.col("l_quantity") / 977.0))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), phase.alias("phase"), amount.alias("amount"))


@query("phase_fractions", f"WITH {PHASE_SQL} SELECT candidate_id, {round_sql(FRACTIONS, 8)} FROM fr")
def phase_fractions(spark, d):
    out = penalties.phase_fractions(phase_table(spark, d))
    return rounded(out.select("candidate_id", *FRACTIONS), 8, *FRACTIONS)


THERMO_SQL = {
    "laves_penalty_calphad": excess_sql("laves_fraction", 0.03, 10.0, 0.01),
    "sigma_penalty_calphad": excess_sql("sigma_fraction", 0.01, 10.0, 0.01),
    "fcc_penalty_calphad": excess_sql("fcc_fraction", 0.05, 5.0, 0.02),
    "m6c_penalty_calphad": excess_sql("m6c_fraction", 0.05, 3.0, 0.02),
}


@query("thermo_penalty", f"""
WITH {PHASE_SQL}, pen AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in THERMO_SQL.items())} FROM fr)
SELECT o_orderkey AS candidate_id, {', '.join(f'round(coalesce({n}, 0e0), 4) AS {n}' for n in THERMO_SQL)},
       round(CASE WHEN candidate_id IS NULL THEN 100e0 ELSE {' + '.join(THERMO_SQL)} END, 4) AS thermo_penalty,
       candidate_id IS NOT NULL AS thermo_success
FROM orders LEFT JOIN pen ON o_orderkey = candidate_id""")
def thermo_penalty(spark, d):
    candidates = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    out = penalties.attach_thermo(candidates, phase_table(spark, d))
    wanted = [*THERMO_SQL, "thermo_penalty"]
    return rounded(out.select("candidate_id", *wanted, "thermo_success"), 4, *wanted)


@query("physics_total", f"""
WITH {metallurgy_ctes(alloys_sql())}
SELECT {KEYS}, round(metallurgy_penalty, 6) AS metallurgy_penalty, 0e0 AS ood_penalty, 0e0 AS thermo_penalty,
       round(metallurgy_penalty + "Re" + 0.7e0 * "Ta" + 0.5e0 * "Co", 6) AS final_penalty FROM met""")
def physics_total(spark, d):
    out = evaluate_physics(alloys(spark, d))
    wanted = ["metallurgy_penalty", "ood_penalty", "thermo_penalty", "final_penalty"]
    return rounded(out.select(*KEY, *wanted), 6, *wanted)


LIFE_LAW = "1000e0 * (31e0 - 5e0 * log10(150e0) + 0.2e0 * \"Cr\") / 873.15e0 - 20e0"


@query("candidate_objectives", f"""
WITH {metallurgy_ctes(alloys_sql())}, c AS (SELECT *, {COST_SQL} AS cost, {LIFE_LAW} AS life FROM met)
SELECT {KEYS}, round(CASE WHEN l_linenumber = 7 THEN -9999e0 ELSE life END, 6) AS predicted_log_life,
       round(CASE WHEN l_linenumber = 7 THEN 9999e0 ELSE cost END, 6) AS material_cost,
       round(CASE WHEN l_linenumber = 7 THEN 9999e0 ELSE metallurgy_penalty + greatest(0e0, cost - 1.8e0) END, 6) AS objective_risk
FROM c""")
def candidate_objectives(spark, d):
    def scorer(df):
        life = F.lit(1000.0) * (31.0 - 5.0 * F.log10("stress") + 0.2 * F.col("Cr")) / F.col("temp") - 20.0
        return df.withColumn("predicted_log_life", F.when(F.col("l_linenumber") != 7, life))

    out = objectives(alloys(spark, d), scorer, None, 1.8, 873.15, 150.0)
    wanted = ["predicted_log_life", "material_cost", "objective_risk"]
    return rounded(out.select(*KEY, *wanted), 6, *wanted)


@query("life_units", f"""
WITH t AS ({lines_sql(CONDITIONS)})
SELECT {KEYS}, round(pow(10e0, log_lifetime), 2) AS lifetime_hours, round(pow(10e0, log_lifetime) / 8760e0, 6) AS lifetime_years FROM t""")
def life_units(spark, d):
    out = metrics.life_units(lines(spark, d, CONDITIONS))
    return rounded(rounded(out, 2, "lifetime_hours"), 6, "lifetime_years").select(*KEY, "lifetime_hours", "lifetime_years")


BOUNDS_CASE = " ".join(
    f"WHEN \"{e}\" < {lo}e0 OR \"{e}\" > {hi}e0 THEN '{e} out of range: ' || printf('%.6f', \"{e}\") || ' not in [{lo}, {hi}]'"
    for e, (lo, hi) in DESIGN_BOUNDS.items())
GATE_SQL = f"""{metallurgy_ctes(alloys_sql())}, gate AS (SELECT *, CASE {BOUNDS_CASE}
  WHEN {TOTAL_SQL} > 15 THEN 'total alloy too high: ' || printf('%.4f', {TOTAL_SQL}) || ' > 15.0'
  WHEN metallurgy_penalty > 20 THEN 'physics penalty too high: ' || printf('%.4f', metallurgy_penalty) || ' > 20.0'
  END AS reason FROM met)"""


@query("seed_gate_reasons", f"WITH {GATE_SQL} SELECT {KEYS}, reason FROM gate")
def seed_gate_reasons(spark, d):
    return penalties.seed_gate(alloys(spark, d)).select(*KEY, "reason")


@query("reject_counts", f"WITH {GATE_SQL} SELECT coalesce(split_part(reason, ':', 1), 'accepted') AS reason, count(*) AS n_rows FROM gate GROUP BY ALL")
def reject_counts(spark, d):
    gated = penalties.seed_gate(alloys(spark, d))
    return stats.reason_counts(gated.withColumn("reason", F.split_part("reason", F.lit(":"), F.lit(1))))


@query("accepted_seeds", f"""
WITH {GATE_SQL}
SELECT {KEYS}, round("Cr", 6) AS "Cr" FROM gate WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY {', '.join(f'round_even("{e}", 4)' for e in DESIGN_ELEMENTS)} ORDER BY {KEYS}) = 1""")
def accepted_seeds(spark, d):
    accepted, _ = penalties.validate_seeds(alloys(spark, d), KEY)
    return rounded(accepted.select(*KEY, "Cr"), 6, "Cr")


# --- repair and random rows ---------------------------------------------------

def repair_sql(source: str, bounds: dict[str, tuple[float, float]], budget: float) -> str:
    """CTEs clipped, first and second over a select with one column per element."""
    names = list(bounds)

    def clip(e: str, v: str) -> str:
        lo, hi = bounds[e]
        return f"least(greatest({v}, {lo}e0), {hi}e0)"

    def shrink(previous: str, collapse: bool) -> str:
        total = " + ".join(f'"{e}"' for e in names)
        room = " + ".join(f'("{e}" - {bounds[e][0]}e0)' for e in names)
        cells = []
        for e in names:
            cut = clip(e, f'"{e}" - ex * ("{e}" - {bounds[e][0]}e0) / room')
            low = f"WHEN ex > 0 THEN {bounds[e][0]}e0 " if collapse else ""
            cells.append(f'CASE WHEN ex > 0 AND room > 1e-12 THEN {cut} {low}ELSE "{e}" END AS "{e}"')
        return (f"SELECT * REPLACE ({', '.join(cells)}) FROM "
                f"(SELECT *, ({total}) - {budget!r}::DOUBLE AS ex, {room} AS room FROM {previous})")

    clipped = f"SELECT * REPLACE ({', '.join(f'{clip(e, chr(34) + e + chr(34))} AS {chr(34)}{e}{chr(34)}' for e in names)}) FROM ({source})"
    return (f"clipped AS ({clipped}), first AS ({shrink('clipped', True)}), "
            f"second AS ({shrink('(SELECT * EXCLUDE (ex, room) FROM first)', False)})")


GENES = {"a": "l_quantity / 4e0", "b": "l_extendedprice / 9000e0", "c": "30e0 * l_discount", "e": "50e0 * l_tax"}
GENE_BOUNDS = {"a": (1.0, 10.0), "b": (2.0, 9.0), "c": (0.5, 2.5), "e": (0.1, 3.0)}


@query("repair_clip_sum", f"WITH {repair_sql(lines_sql(GENES), GENE_BOUNDS, 14.0)} SELECT {KEYS}, {round_sql(list(GENES), 8)} FROM second")
def repair_clip_sum(spark, d):
    out = composition.repair(lines(spark, d, GENES), GENE_BOUNDS, 14.0)
    return rounded(out.select(*KEY, *GENES), 8, *GENES)


BUDGET = composition.design_budget()


@query("repaired_seeds", f"WITH {repair_sql(lines_sql(DESIGN), DESIGN_BOUNDS, BUDGET)} SELECT {KEYS}, {round_sql(DESIGN_ELEMENTS, 9)} FROM second")
def repaired_seeds(spark, d):
    out = composition.seed_candidates(alloys(spark, d))
    return rounded(out.select(*KEY, *DESIGN_ELEMENTS), 9, *DESIGN_ELEMENTS)


DRAW_SQL = "SELECT o_orderkey AS candidate_id, " + ", ".join(
    f"{lo}e0 + ('0x' || substr(md5('7:{e}:' || o_orderkey), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 * ({hi}e0 - {lo}e0) AS \"{e}\""
    for e, (lo, hi) in DESIGN_BOUNDS.items()) + " FROM orders"


def drawn(spark, d):
    """One random design vector per order."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    return composition.repair(composition.draw_uniform(rows, ["candidate_id"], 7))


@query("random_design_rows", f"WITH {repair_sql(DRAW_SQL, DESIGN_BOUNDS, BUDGET)} SELECT candidate_id, {round_sql(DESIGN_ELEMENTS, 8)} FROM second")
def random_design_rows(spark, d):
    return rounded(drawn(spark, d).select("candidate_id", *DESIGN_ELEMENTS), 8, *DESIGN_ELEMENTS)


# --- tables for display ---------------------------------------------------------

SHARE_PARTS = {"Cr": "8e0 + l_suppkey / 1000e0", "Ni": DESIGN["Ni"], "C": DESIGN["C"]}


@query("composition_shares", f"""
WITH a AS ({lines_sql(SHARE_PARTS)}),
r AS (SELECT {KEYS}, round_even("Cr", 4) AS "Cr", CASE WHEN "Ni" > 0 THEN round_even("Ni", 4) END AS "Ni", round_even("C", 4) AS "C" FROM a),
f AS (SELECT *, round_even(100e0 - ("C" + "Cr" + coalesce("Ni", 0e0)), 3) AS fe FROM r)
SELECT {KEYS}, 'Fe (bal.)' AS element, fe AS wt FROM f WHERE fe > 0
UNION ALL SELECT {KEYS}, 'Cr', "Cr" FROM f UNION ALL SELECT {KEYS}, 'C', "C" FROM f
UNION ALL SELECT {KEYS}, 'Ni', "Ni" FROM f WHERE "Ni" IS NOT NULL""")
def composition_shares(spark, d):
    rows = lines(spark, d, SHARE_PARTS)
    return composition.composition_shares(rows, KEY, ["C", "Cr", "Ni"])


@query("heat_stages", f"""
WITH h AS ({lines_sql(HEAT)})
SELECT {KEYS}, '노말라이징' AS label, 'N' AS prefix, "Ntemp" AS temp_k, round_even("Ntemp" - 273.15e0, 1) AS temp_c, round_even("Ntime", 2) AS time_h FROM h
UNION ALL SELECT {KEYS}, '템퍼링', 'T', "Ttemp", round_even("Ttemp" - 273.15e0, 1), round_even("Ttime", 2) FROM h
UNION ALL SELECT {KEYS}, '시효처리', 'A', "Atemp", round_even("Atemp" - 273.15e0, 1), round_even("Atime", 2) FROM h WHERE "Atemp" > 0""")
def heat_stages(spark, d):
    return composition.heat_stages(lines(spark, d, HEAT), KEY)


STATUS_SQL = ", ".join(
    f"CASE WHEN {c} <= {ok}e0 THEN 'ok' WHEN {c} <= {warn}e0 THEN 'warn' ELSE 'bad' END AS {c}_status"
    for c, (ok, warn) in STATUS_LIMITS.items())


@query("status_bands", f"""
WITH {PHASE_SQL}, s AS (SELECT *, 2e0 + candidate_id % 4 AS predicted_log_life, 1e0 * (candidate_id % 97) AS material_cost, candidate_id % 61 AS physics_risk FROM fr)
SELECT candidate_id, {STATUS_SQL},
  CASE WHEN predicted_log_life >= 4 THEN 'ok' WHEN predicted_log_life >= 3 THEN 'warn' ELSE 'bad' END AS life_status,
  CASE WHEN material_cost < 30 THEN 'ok' WHEN material_cost < 60 THEN 'warn' ELSE 'bad' END AS cost_status,
  CASE WHEN physics_risk < 10 THEN 'ok' WHEN physics_risk < 50 THEN 'warn' ELSE 'bad' END AS risk_status FROM s""")
def status_bands(spark, d):
    rows = penalties.phase_fractions(phase_table(spark, d)).withColumns({
        "predicted_log_life": 2.0 + F.col("candidate_id") % 4, "material_cost": 1.0 * (F.col("candidate_id") % 97),
        "physics_risk": F.col("candidate_id") % 61})
    out = selection.status_bands(rows)
    return out.select("candidate_id", *[c for c in out.columns if c.endswith("_status")])


@query("life_labels", f"""
WITH t AS (SELECT {KEYS}, pow(10e0, 1e0 + l_quantity / 8e0) AS h FROM lineitem)
SELECT {KEYS}, CASE WHEN h > 87600 THEN printf('%.0f', h / 8760e0) || '년' WHEN h > 1000 THEN printf('%.1f', h / 1000e0) || 'k h'
       ELSE printf('%.0f', h) || ' h' END AS label FROM t""")
def life_labels(spark, d):
    return table(spark, d, "lineitem").select(*KEY, life_label(1.0 + F.col("l_quantity") / 8.0).alias("label"))


@query("scalar_functions", """
SELECT p_partkey, round_even(p_retailprice / 7e0, 2) AS half_even, round(100e0 + (p_size - 1) * (400e0 / 49e0), 6) AS spaced,
       round(pow(10e0, 1e0 + (p_size - 1) * (2e0 / 49e0)), 6) AS log_spaced,
       round(0.5e0 * p_size * p_size - 3e0 * p_size + 2e0, 6) AS poly FROM part""")
def scalar_functions(spark, d):
    i = F.col("p_size") - 1
    return table(spark, d, "part").select(
        "p_partkey", half_even(F.col("p_retailprice") / 7.0, 2).alias("half_even"),
        rnd(linspace(100.0, 500.0, 50, i), 6).alias("spaced"),
        rnd(logspace(10.0, 1000.0, 50, i), 6).alias("log_spaced"),
        rnd(polynomial([0.5, -3.0, 2.0], "p_size"), 6).alias("poly"))


@query("prediction_rows", f"""
WITH t AS ({lines_sql(CONDITIONS)})
SELECT round(stress, 6) AS stress, temp, round(log_lifetime, 6) AS y_true_log, round(log_lifetime + l_tax, 6) AS y_pred_log,
       round(pow(10e0, log_lifetime), 2) AS y_true_hours, round(pow(10e0, log_lifetime + l_tax), 2) AS y_pred_hours,
       round(l_tax, 6) AS error_log FROM (SELECT t.*, l_tax FROM t JOIN lineitem USING ({KEYS}))""")
def prediction_rows(spark, d):
    rows = lines(spark, d, CONDITIONS, extra=["l_tax"]).withColumn("pred", F.col("log_lifetime") + F.col("l_tax"))
    out = metrics.prediction_rows(rows, "log_lifetime", "pred")
    out = rounded(out, 6, "stress", "y_true_log", "y_pred_log", "error_log")
    return rounded(out, 2, "y_true_hours", "y_pred_hours")


