"""Physics expressions: heat-treatment severity, Larson-Miller life, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruptura.constants import HOURS_PER_YEAR, LMP_CONSTANT
from ruptura.functions.numeric import clip, col_of, polynomial


def severity(temp, time, mode: str = "inference") -> Column:
    """``T * (20 + log10 t)`` of a heat-treatment stage; 0 when the stage is absent.

    The treatment of very short times differs by use: ``training`` adds 1e-6 h,
    ``inference`` floors the time at 1e-6 h, ``physics`` returns 0 for t <= 0.
    """
    t, h = col_of(temp), col_of(time)
    if mode == "training":
        hours, active = h + F.lit(1e-6), t > 0
    elif mode == "inference":
        hours, active = F.greatest(h, F.lit(1e-6)), t > 0
    elif mode == "physics":
        hours, active = F.greatest(h, F.lit(1e-6)), (t > 0) & (h > 0)
    else:
        raise ValueError(f"unknown severity mode: {mode}")
    return F.when(active, t * (F.lit(20.0) + F.log10(hours))).otherwise(F.lit(0.0))


def operating_severity(stress, temp) -> Column:
    return (col_of(temp) / 1000.0) * F.log10(col_of(stress) + 1.0)


def stress_temperature_interaction(stress, temp) -> Column:
    return col_of(stress) * col_of(temp) / 1000.0


def inverse_temperature(temp) -> Column:
    return F.lit(1000.0) / col_of(temp)


def larson_miller(temp, log_life, constant=LMP_CONSTANT) -> Column:
    """Larson-Miller parameter ``T * (C + log10 t) / 1000``."""
    return col_of(temp) * (col_of(constant) + col_of(log_life)) / 1000.0


def lmp_log_life(temp, stress, constant, coefficients) -> Column:
    """log10 life from a master curve ``LMP = poly(log10 stress)``."""
    x = F.log10(clip(stress, low=F.lit(1e-12)))
    return F.lit(1000.0) * polynomial(coefficients, x) / clip(temp, low=F.lit(1e-12)) - col_of(constant)


def excess_penalty(
    value, threshold, direction: str = "upper",
    scale: float = 1.0, norm: float = 1.0, power: float = 2.0,
) -> Column:
    """Zero inside the safe side, ``scale * (excess / norm) ** power`` outside."""
    if direction not in ("upper", "lower"):
        raise ValueError("direction must be 'upper' or 'lower'")
    if norm <= 0:
        norm = 1.0
    v, t = col_of(value), col_of(threshold)
    gap = v - t if direction == "upper" else t - v
    # One mention of the value: the optimizer may copy this expression into a filter.
    excess = F.greatest(F.lit(0.0), gap) / F.lit(float(norm))
    return F.lit(float(scale)) * F.pow(excess, F.lit(float(power)))


def hours_from_log(log_life) -> Column:
    return F.pow(F.lit(10.0), col_of(log_life))


def years_from_hours(hours) -> Column:
    return col_of(hours) / F.lit(HOURS_PER_YEAR)


def life_label(log_life) -> Column:
    """Short text for a life: years beyond 87,600 h, thousands of hours beyond 1,000 h."""
    h = hours_from_log(log_life)
    return (
        F.when(col_of(log_life).isNull(), F.lit("—"))
        .when(h > 87600, F.concat(F.format_string("%.0f", h / F.lit(HOURS_PER_YEAR)), F.lit("년")))
        .when(h > 1000, F.concat(F.format_string("%.1f", h / 1000.0), F.lit("k h")))
        .otherwise(F.concat(F.format_string("%.0f", h), F.lit(" h")))
    )
