"""Metallurgical indices, penalties and the phase (thermo) layer."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.constants import (
    DESIGN_BOUNDS, ELEMENTAL_RISK, FULL_ELEMENTS, MAX_TOTAL_ALLOY, METALLURGY_LIMITS,
    PHASE_COLUMNS, PHASE_LIMITS, SEED_MAX_PENALTY, THERMO_FAILURE_PENALTY,
)
from ruptura.functions.numeric import half_even, total
from ruptura.functions.physics import excess_penalty
from ruptura.operators.composition import fe_balance, full_composition, total_alloy
from ruptura.operators.stats import dedup_rounded

PENALTY_NAMES = {
    "kn": "kn_penalty", "ms_temp": "ms_penalty", "laves_risk": "laves_penalty",
    "z_phase_risk": "z_phase_penalty", "ceq": "ceq_penalty", "mx_balance": "mx_penalty",
    "total_alloy": "total_alloy_penalty",
}


def metallurgy_indices() -> dict[str, Column]:
    """Indices of a full composition, as expressions over its element columns."""
    c, n, mn, ni, cu = (F.col(x) for x in ("C", "N", "Mn", "Ni", "Cu"))
    si, cr, mo, w = (F.col(x) for x in ("Si", "Cr", "Mo", "W"))
    v, nb, al, co = (F.col(x) for x in ("V", "Nb", "Al", "Co"))
    ferrite = cr + 6.0 * si + 4.0 * mo + 2.0 * al + 4.0 * nb + 1.5 * v + 1.5 * w
    austenite = 40.0 * c + 30.0 * n + 2.0 * mn + 4.0 * ni + 2.0 * cu + co
    return {
        "kn": ferrite - austenite,
        "ms_temp": 561.0 - 474.0 * c - 33.0 * mn - 17.0 * cr - 17.0 * ni - 21.0 * mo,
        "laves_risk": mo + 0.5 * w,
        "z_phase_risk": (v + nb) / (n + 1e-6),
        "ceq": c + mn / 6.0 + (cr + mo + v) / 5.0 + (ni + cu) / 15.0,
        "mx_balance": (v + nb) / (c + n + 1e-6),
        "total_alloy": total_alloy(),
        "fe_balance": fe_balance(),
    }


def metallurgy(df: DataFrame) -> DataFrame:
    """Add the indices, their penalties and the summed metallurgy penalty."""
    df = df.withColumns(metallurgy_indices())
    df = df.withColumns({
        PENALTY_NAMES[k]: excess_penalty(k, limit, "lower" if k == "ms_temp" else "upper", scale, norm)
        for k, (limit, scale, norm) in METALLURGY_LIMITS.items()
    })
    return df.withColumn("metallurgy_penalty", total(PENALTY_NAMES.values()))


def elemental_ood() -> Column:
    return reduce(add, [F.col(e) * w for e, w in ELEMENTAL_RISK.items()])


def range_penalty(ranges: dict[str, tuple[float, float]]) -> Column:
    """Summed distance outside ``[low, high]`` per element."""
    zero = F.lit(0.0)
    return total(
        F.greatest(zero, low - F.col(e)) + F.greatest(zero, F.col(e) - high) for e, (low, high) in ranges.items()
    )


# --- phase layer --------------------------------------------------------------

def phase_fractions(df: DataFrame, candidate: str = "candidate_id", phase="phase", amount="amount") -> DataFrame:
    """Phase amounts ``(candidate, phase, amount)`` to normalised fractions, one row per candidate.

    Unnamed phases and amounts that are missing or at most 1e-12 are dropped;
    phases outside the named ones count in the total and in ``phase_info`` only.
    """
    named = F.trim(F.coalesce(F.col(phase), F.lit("")))
    clean = (
        df.filter((named != "") & (F.upper(named) != "NAN") & ~F.isnan(amount) & (F.col(amount) > 1e-12))
        .groupBy(candidate, phase).agg(F.sum(amount).alias("_a"))
    )
    # Few phases exist, so one row per candidate and phase is already small.
    wide = clean.groupBy(candidate).agg(
        F.sum("_a").alias("_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(phase, "_a")))).alias("_amounts"),
        *[F.sum(F.when(F.col(phase) == p, F.col("_a"))).alias(c) for p, c in PHASE_COLUMNS.items()],
    )
    return wide.select(
        candidate,
        F.transform_values("_amounts", lambda k, v: v / F.col("_total")).alias("phase_info"),
        *[F.coalesce(F.col(c) / F.col("_total"), F.lit(0.0)).alias(c) for c in PHASE_COLUMNS.values()],
    )


def thermo_penalty(fractions: DataFrame) -> DataFrame:
    """Penalties on the risky phases."""
    df = fractions.withColumns({
        f"{p}_penalty_calphad": excess_penalty(f"{p}_fraction", limit, "upper", scale, norm)
        for p, (limit, scale, norm) in PHASE_LIMITS.items()
    })
    return df.withColumn("thermo_penalty", total(f"{p}_penalty_calphad" for p in PHASE_LIMITS))


def attach_thermo(candidates: DataFrame, phases: DataFrame | None, candidate: str = "candidate_id") -> DataFrame:
    """Phase results on candidates, always under one schema.

    ``phases=None`` skips the layer at no penalty. A candidate without any phase
    has failed: it gets the failure penalty, not a free pass.
    """
    numbers = [*PHASE_COLUMNS.values(), *[f"{p}_penalty_calphad" for p in PHASE_LIMITS]]
    if phases is None:
        return candidates.withColumns(
            {c: F.lit(0.0) for c in (*numbers, "thermo_penalty")}
            | {"phase_info": F.expr("cast(map() as map<string,double>)"),
               "thermo_success": F.lit(False), "thermo_error": F.lit("skipped")}
        )
    scored = thermo_penalty(phase_fractions(phases, candidate)).withColumn("_ok", F.lit(True))
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    return (
        candidates.join(scored, candidate, "left")
        .withColumns(
            {c: F.coalesce(F.col(c), F.lit(0.0)) for c in numbers}
            | {"thermo_penalty": F.coalesce("thermo_penalty", F.lit(THERMO_FAILURE_PENALTY)),
               "phase_info": F.coalesce("phase_info", F.expr("cast(map() as map<string,double>)")),
               "thermo_success": ok, "thermo_error": F.when(~ok, F.lit("no phase amounts"))}
        )
        .drop("_ok")
    )


# --- seed checks --------------------------------------------------------------

def bounds_reason(bounds: dict[str, tuple[float, float]] = DESIGN_BOUNDS) -> Column:
    """First element outside its bounds, as text; NULL when all are inside."""
    return F.coalesce(*[
        F.when(
            (F.col(e) < low) | (F.col(e) > high),
            F.concat(F.lit(f"{e} out of range: "), F.format_string("%.6f", half_even(e, 6)), F.lit(f" not in [{low}, {high}]")),
        )
        for e, (low, high) in bounds.items()
    ])


def total_reason(limit: float = MAX_TOTAL_ALLOY) -> Column:
    return F.when(
        F.col("total_alloy") > limit,
        F.concat(F.lit("total alloy too high: "), F.format_string("%.4f", half_even("total_alloy", 4)), F.lit(f" > {limit}")),
    )


def seed_penalty() -> Column:
    return F.col("metallurgy_penalty") + elemental_ood()


def seed_passes(max_penalty: float = SEED_MAX_PENALTY) -> Column:
    """The seed checks as a plain test, cheap enough to be pushed into a scan."""
    tests = [F.col(e).between(low, high) for e, (low, high) in DESIGN_BOUNDS.items()]
    return reduce(and_, tests, (total_alloy() <= MAX_TOTAL_ALLOY) & (seed_penalty() <= max_penalty))


def seed_gate(df: DataFrame, max_penalty: float = SEED_MAX_PENALTY) -> DataFrame:
    """Add ``reason``: the first check a full composition fails, NULL when it passes all.

    The order is bounds, total alloy, physics penalty (without OOD and phases).
    """
    scored = metallurgy(full_composition(df))
    physics = F.when(
        seed_penalty() > max_penalty,
        F.concat(F.lit("physics penalty too high: "), F.format_string("%.4f", half_even(seed_penalty(), 4)), F.lit(f" > {max_penalty}")),
    )
    return scored.withColumn("reason", F.coalesce(bounds_reason(), total_reason(), physics))


def validate_seeds(df: DataFrame, order: list[str], digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Accepted seeds (without near copies, first wins) and rejected ones with their reason."""
    kept = [c for c in df.columns if c not in FULL_ELEMENTS]
    accepted = metallurgy(full_composition(df)).filter(seed_passes()).select(*kept, *FULL_ELEMENTS)
    rejected = seed_gate(df).filter(~seed_passes()).select(*kept, "reason")
    return dedup_rounded(accepted, FULL_ELEMENTS, order, digits), rejected
