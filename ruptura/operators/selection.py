"""Violation score, lexicographic ranking, best pick and top-n."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.constants import (
    COST_STATUS, FLAG_VIOLATION, LIFE_BAND_LOG, LIFE_STATUS, PENALTY_COLS, POLICY_FALLBACK, POLICY_VALID,
    RISK_STATUS, SCORE_EPS, SELECTION_PHASE_RULES, STATUS_LIMITS,
)
from ruptura.functions.numeric import half_even, to_double_or

INF = float("inf")


def _value(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return to_double_or(F.col(name), default) if name in df.columns else F.lit(default)


def _text(name: str, digits: int, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), F.format_string(f"%.{digits}f", half_even(value, digits)))


def violation_score(df: DataFrame, require_thermo: bool = False) -> DataFrame:
    """Add ``selection_physical_score`` and the list of violations.

    The total risk and its parts are both added, so a penalty weighs twice;
    that is the wanted ranking. NaN and unreadable values count as 0.
    """
    score, notes = [], []
    for name in PENALTY_COLS:
        v = _value(df, name)
        score.append(v)
        notes.append(F.when(v > SCORE_EPS, _text(name, 4, v)))
    if "ood_is_out_of_distribution" in df.columns:
        out = F.coalesce(F.col("ood_is_out_of_distribution"), F.lit(False))
        score.append(F.when(out, F.lit(FLAG_VIOLATION)).otherwise(0.0))
        notes.append(F.when(out, F.lit("ood_is_out_of_distribution=True")))
    if require_thermo:
        ok = F.coalesce(F.col("thermo_success"), F.lit(False)) if "thermo_success" in df.columns else F.lit(False)
        score.append(F.when(~ok, F.lit(FLAG_VIOLATION)).otherwise(0.0))
        notes.append(F.when(~ok, F.lit("thermo_success=False")))
    for name, limit, weight, excess in SELECTION_PHASE_RULES:
        v = _value(df, name)
        score.append(F.when(v > limit, weight * (v - limit if excess else v)).otherwise(0.0))
        notes.append(F.when(v > limit, _text(name, 6, v)))
    return df.withColumns({
        "selection_physical_score": reduce(add, score),
        "selection_physical_violations": F.array_compact(F.array(*notes)),
    })


def is_valid(df: DataFrame, require_thermo: bool = False) -> Column:
    """No violation at all, said in terms of the plain columns so that it stays cheap to push down."""
    tests = [_value(df, name) <= SCORE_EPS for name in PENALTY_COLS]
    tests += [_value(df, name) <= limit for name, limit, _, _ in SELECTION_PHASE_RULES]
    # The parts may only pass together if their sum does.
    tests.append(reduce(add, [_value(df, name) for name in PENALTY_COLS]) <= SCORE_EPS)
    if "ood_is_out_of_distribution" in df.columns:
        tests.append(~F.coalesce(F.col("ood_is_out_of_distribution"), F.lit(False)))
    if require_thermo:
        tests.append(F.coalesce(F.col("thermo_success"), F.lit(False)) if "thermo_success" in df.columns else F.lit(False))
    return reduce(and_, tests)


def cost_check(df: DataFrame, limit: float | None) -> DataFrame:
    """Add whether the cost limit holds, and by how much it is missed."""
    cost = _value(df, "material_cost", INF)
    if limit is None:
        return df.withColumns({"selection_cost_ok": F.lit(True), "selection_cost_excess": F.lit(0.0)})
    return df.withColumns({
        "selection_cost_ok": cost <= limit,
        "selection_cost_excess": F.greatest(F.lit(0.0), cost - limit),
    })


def assess(df: DataFrame, limit: float | None, require_thermo: bool = False) -> DataFrame:
    return cost_check(violation_score(df, require_thermo), limit)


def _life(df: DataFrame) -> Column:
    return _value(df, "predicted_log_life", -1e9)


def _cost_order(df: DataFrame) -> list[Column]:
    return [
        F.col("selection_cost_ok").desc(),
        to_double_or(F.col("selection_cost_excess"), 1e9).asc(),
        _value(df, "material_cost", 1e9).asc(),
    ]


def rank_order(df: DataFrame, tie: list[str]) -> list[Column]:
    return [
        to_double_or(F.col("selection_physical_score"), 1e9).asc(), _life(df).desc(), *_cost_order(df),
        *[F.col(t).asc() for t in tie],
    ]


def rank_candidates(
    df: DataFrame, limit: float | None, require_thermo: bool = False,
    tie: list[str] = ("candidate_id",), top: int | None = None,
) -> DataFrame:
    """Order by violations, life, cost limit, excess and cost; ties by ``tie``.

    With ``top`` only that many rows are kept, without sorting the rest.
    """
    rows = assess(df, limit, require_thermo)
    ranked = rows.orderBy(*rank_order(rows, list(tie)))
    return ranked if top is None else ranked.limit(top)


def select_best(
    df: DataFrame, limit: float | None, require_thermo: bool = True,
    tie: list[str] = ("candidate_id",), band: float = LIFE_BAND_LOG,
) -> DataFrame:
    """One row: the cheapest valid candidate within the life band of the longest-lived one.

    Without any valid row the phase requirement is dropped; if that does not
    help, the first in ranking order is taken. ``selection_policy`` tells which.
    """
    for thermo in (True, False) if require_thermo else (False,):
        rows = assess(df, limit, thermo)
        valid = rows.filter(is_valid(df, thermo))
        longest = valid.agg(F.max(_life(rows)).alias("life")).first()["life"]
        if longest is not None:
            close = valid.filter(F.lit(longest) - _life(rows) <= band)
            order = [*_cost_order(rows), _life(rows).desc(), *rank_order(rows, list(tie))]
            return close.orderBy(*order).limit(1).withColumn("selection_policy", F.lit(POLICY_VALID))
    ranked = rank_candidates(df, limit, False, tie, top=1)
    return ranked.withColumn("selection_policy", F.lit(POLICY_FALLBACK))


def prescreen(df: DataFrame, n: int, risk="physics_risk", life="predicted_log_life", cost="material_cost",
              tie: list[str] = ("candidate_id",)) -> DataFrame:
    """The n most promising rows before a costly stage: least risk, longest life, least cost."""
    return df.orderBy(F.col(risk).asc(), F.col(life).desc(), F.col(cost).asc(), *[F.col(t) for t in tie]).limit(n)


def sort_candidates(df: DataFrame, key: str, ascending: bool = False, tie: list[str] = ()) -> DataFrame:
    """Sort by any column; missing and unreadable values rank below every number."""
    value = to_double_or(F.col(key), None)
    first = value.asc_nulls_first() if ascending else value.desc_nulls_last()
    return df.orderBy(first, *[F.col(t) for t in tie])


def top_candidates(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def status_bands(df: DataFrame) -> DataFrame:
    """ok / warn / bad per phase fraction, life, cost and risk."""
    def upto(c: str, ok: float, warn: float) -> Column:
        return F.when(F.col(c) <= ok, "ok").when(F.col(c) <= warn, "warn").otherwise("bad")

    def below(c: str, ok: float, warn: float) -> Column:
        return F.when(F.col(c) < ok, "ok").when(F.col(c) < warn, "warn").otherwise("bad")

    cells = {f"{c}_status": upto(c, *b) for c, b in STATUS_LIMITS.items() if c in df.columns}
    if "predicted_log_life" in df.columns:
        life = F.col("predicted_log_life")
        cells["life_status"] = F.when(life >= LIFE_STATUS[0], "ok").when(life >= LIFE_STATUS[1], "warn").otherwise("bad")
    if "material_cost" in df.columns:
        cells["cost_status"] = below("material_cost", *COST_STATUS)
    if "physics_risk" in df.columns:
        cells["risk_status"] = below("physics_risk", *RISK_STATUS)
    return df.withColumns(cells)
