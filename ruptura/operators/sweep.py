"""Operating-condition sweeps: parameter checks and product x grid tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.constants import HEATMAP_POINTS, SWEEP_DEFAULTS, SWEEP_POINTS
from ruptura.functions.numeric import linspace, logspace, to_double_or

PARAMS = list(SWEEP_DEFAULTS)


def _positive(value: Column, default) -> Column:
    size = F.abs(value)
    return F.when(size < 1e-6, default).otherwise(size)


def _ordered(a: Column, b: Column, gap: float = 1.0) -> tuple[Column, Column]:
    b = F.when(a == b, a + gap).otherwise(b)
    return F.least(a, b), F.greatest(a, b)


def sanitize_sweep(df: DataFrame) -> DataFrame:
    """Sweep limits made usable: defaults for bad values, positive stresses, ordered ranges.

    One row per request; further columns stay.
    """
    for c in (c for c in PARAMS if c not in df.columns):
        df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumns({c: to_double_or(F.col(c), d) for c, d in SWEEP_DEFAULTS.items()})
    t_lo, t_hi = _ordered(F.col("temp_min"), F.col("temp_max"))
    df = df.withColumns({"_t_lo": t_lo, "_t_hi": t_hi, "_s_a": _positive(F.col("stress_min"), F.lit(1.0))})
    df = df.withColumn("_s_b", _positive(F.col("stress_max"), F.greatest(F.col("_s_a") + 1.0, F.lit(2.0))))
    s_lo, s_hi = _ordered(F.col("_s_a"), F.col("_s_b"))
    return df.withColumns({
        "temp_min": F.col("_t_lo"), "temp_max": F.col("_t_hi"), "stress_min": s_lo, "stress_max": s_hi,
        "fixed_stress": _positive(F.col("fixed_stress"), F.lit(1.0)),
        "fixed_temp": _positive(F.col("fixed_temp"), F.lit(1.0)),
    }).drop("_t_lo", "_t_hi", "_s_a", "_s_b")


def sweep_grid(products: DataFrame, points: int = SWEEP_POINTS, heatmap: int = HEATMAP_POINTS) -> DataFrame:
    """Each product at all its sweep points: ``sweep, i, j, temp, stress``.

    ``products`` carries sanitised sweep limits. The grid is generated inside
    each row, so nothing is shuffled and nothing is joined.
    """
    low = F.greatest(F.col("stress_min"), F.lit(1.0))

    def temps(n: int, i: Column) -> Column:
        return linspace("temp_min", "temp_max", n, i)

    def stresses(n: int, i: Column) -> Column:
        return logspace(low, "stress_max", n, i)

    def point(name: str, i: Column, j: Column, temp: Column, stress: Column) -> Column:
        return F.struct(F.lit(name).alias("sweep"), i.cast("int").alias("i"), j.cast("int").alias("j"),
                        temp.alias("temp"), stress.alias("stress"))

    along = F.sequence(F.lit(0), F.lit(points - 1))
    cells = F.sequence(F.lit(0), F.lit(heatmap * heatmap - 1))
    zero = F.lit(0)
    grid = F.concat(
        F.transform(along, lambda i: point("temp", i, zero, temps(points, i), F.col("fixed_stress"))),
        F.transform(along, lambda i: point("stress", i, zero, F.col("fixed_temp"), stresses(points, i))),
        F.transform(cells, lambda k: point(
            "heatmap", F.floor(k / heatmap), k % heatmap,
            temps(heatmap, k % heatmap), stresses(heatmap, F.floor(k / heatmap)))),
    )
    return products.withColumn("_p", F.explode(grid)).select(
        *products.columns, "_p.sweep", "_p.i", "_p.j", "_p.temp", "_p.stress")
