"""Predicted life of whole product tables over operating conditions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruptura.constants import CONDITION_COLS, FULL_ELEMENTS, HEAT_COLS, HEATMAP_POINTS, SWEEP_DEFAULTS, SWEEP_POINTS
from ruptura.functions.numeric import number_or
from ruptura.functions.physics import hours_from_log, larson_miller
from ruptura.operators.features import add_severities
from ruptura.operators.sweep import sanitize_sweep, sweep_grid

Scorer = Callable[[DataFrame], DataFrame]


def product_features(products: DataFrame, keep: list[str]) -> DataFrame:
    """Composition, heat treatment and severities of each product; absent values are 0."""
    cells = [
        (number_or(F.col(c)) if c in products.columns else F.lit(0.0)).alias(c)
        for c in (*FULL_ELEMENTS, *HEAT_COLS)
    ]
    return add_severities(products.select(*keep, *cells), "inference")


def run_sweep(
    products: DataFrame, params: dict[str, float | None], scorer: Scorer, keep: list[str] = ("name",),
    points: int = SWEEP_POINTS, heatmap: int = HEATMAP_POINTS,
) -> DataFrame:
    """Long table of predicted life per product and sweep point, with the Larson-Miller curve.

    The curve is given on the stress sweep, at the fixed temperature.
    """
    base = product_features(products, list(keep))
    limits = base.withColumns({p: F.lit(params.get(p)).cast("double") for p in SWEEP_DEFAULTS})
    grid = sweep_grid(sanitize_sweep(limits), points, heatmap)
    scored = scorer(grid)
    on_stress = F.when(F.col("sweep") == "stress", larson_miller("fixed_temp", "predicted_log_life"))
    return scored.select(
        *keep, "sweep", "i", "j", *CONDITION_COLS, F.col("predicted_log_life").alias("log10_hours"),
        hours_from_log("predicted_log_life").alias("hours"), on_stress.alias("lmp"),
    )


def with_best(products: DataFrame, best: DataFrame, label: str) -> DataFrame:
    """The best candidate as one more product of the table."""
    return products.unionByName(best.withColumn("name", F.lit(label)), allowMissingColumns=True)


def as_curves(points: DataFrame, keep: list[str] = ("name",)) -> DataFrame:
    """Long sweep table to one row per product and sweep, with ordered arrays.

    A sweep has a fixed number of points, so the arrays are bounded.
    """
    entry = F.struct("i", "j", "temp", "stress", "log10_hours", "hours", "lmp")
    rows = points.groupBy(*keep, "sweep").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    return rows.select(*keep, "sweep", *[F.col(f"p.{c}").alias(c) for c in ("temp", "stress", "log10_hours", "hours", "lmp")])
