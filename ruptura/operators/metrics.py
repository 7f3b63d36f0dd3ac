"""Regression metrics, prediction rows, model comparison and weight calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.constants import HOURS_PER_YEAR
from ruptura.functions.numeric import is_finite
from ruptura.functions.physics import hours_from_log

METRICS = ["rmse_log", "mae_log", "r2_log", "rmse_hours", "mae_hours", "r2_hours"]


def prediction_rows(df: DataFrame, y_true: str, y_pred: str, stress="stress", temp="temp") -> DataFrame:
    return df.select(
        F.col(stress).alias("stress"), F.col(temp).alias("temp"),
        F.col(y_true).alias("y_true_log"), F.col(y_pred).alias("y_pred_log"),
        hours_from_log(y_true).alias("y_true_hours"), hours_from_log(y_pred).alias("y_pred_hours"),
        (F.col(y_pred) - F.col(y_true)).alias("error_log"),
    )


def _r2(error: Column, truth: Column, constant_value: float | None) -> Column:
    n = F.count(truth)
    spread = n * F.var_pop(truth)
    return F.when(spread <= 1e-12, F.lit(constant_value).cast("double")).otherwise(
        F.lit(1.0) - F.sum(error * error) / spread)


def regression_metrics(
    df: DataFrame, y_true: str, y_pred: str, by: list[str] = (), constant_r2: float | None = None
) -> DataFrame:
    """RMSE, MAE and R2 in log10 and in hours, in one aggregation.

    ``constant_r2`` is R2 when the target does not vary (0.0 or NULL).
    """
    out = []
    for name, t, p in (
        ("log", F.col(y_true), F.col(y_pred)),
        ("hours", hours_from_log(y_true), hours_from_log(y_pred)),
    ):
        e = t - p
        out += [
            F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"), F.avg(F.abs(e)).alias(f"mae_{name}"),
            _r2(e, t, constant_r2).alias(f"r2_{name}"),
        ]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def compare_models(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per metric ``(metric, value)``: both values and the gain of the model.

    A gain is a rise for R2 and a drop for errors; metrics the model lacks are left out.
    """
    m = model.select("metric", F.col("value").alias("model"))
    b = baseline.select("metric", F.col("value").alias("baseline"))
    gain = F.col("model") - F.col("baseline")
    return (
        m.filter(F.col("model").isNotNull()).join(b, "metric", "left")
        .withColumn("gain", F.when(F.col("metric").startswith("r2"), gain).otherwise(-gain))
    )


def metrics_long(df: DataFrame) -> DataFrame:
    return df.unpivot([], [c for c in METRICS if c in df.columns], "metric", "value")


def calibrate_weight(
    df: DataFrame, y_true: str, base: str, correction: str, max_weight: float = 2.0, steps: int = 41
) -> DataFrame:
    """Weight on the correction with the least RMSE; the smallest weight wins ties.

    RMSE squared is quadratic in the weight, so three sums replace one scan per weight.
    """
    e, r = F.col(y_true) - F.col(base), F.col(correction)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("ee"), F.sum(e * r).alias("er"), F.sum(r * r).alias("rr")
    )
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    step = max_weight / (steps - 1) if steps > 1 else 0.0

    def trial(i: Column) -> Column:
        w = i.cast("double") * F.lit(step)
        mse = (F.col("ee") - F.lit(2.0) * w * F.col("er") + w * w * F.col("rr")) / F.col("n")
        return F.struct(F.sqrt(F.greatest(F.lit(0.0), mse)).alias("rmse"), w.alias("weight"))

    best = F.array_min(F.transform(grid, trial))
    return sums.select(best.alias("b")).select(F.col("b.weight").alias("weight"), F.col("b.rmse").alias("rmse"))


def life_units(df: DataFrame, log_life: str = "log_lifetime") -> DataFrame:
    return df.withColumn("lifetime_hours", hours_from_log(log_life)).withColumn(
        "lifetime_years", F.col("lifetime_hours") / F.lit(HOURS_PER_YEAR))


def safe_objectives(life: str, cost: str, risk: str, failed: tuple[float, float, float]) -> list[Column]:
    """Objectives of a candidate; any part that failed makes the whole triple the worst one."""
    ok = is_finite(life) & is_finite(cost) & is_finite(risk)
    return [F.when(ok, F.col(c)).otherwise(F.lit(w)).alias(c) for c, w in zip((life, cost, risk), failed)]
