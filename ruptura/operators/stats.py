"""Column statistics: outliers, correlation, scaling, moments, sweep suggestions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruptura.constants import STRESS_ALIASES, TEMP_ALIASES
from ruptura.functions.numeric import finite, half_even, to_double
from ruptura.operators.quantiles import BRACKET_ROWS, exact_quantiles


def _long(df: DataFrame, columns: dict[str, list], names: list[str]) -> DataFrame:
    """One wide row to one row per entry, without a shuffle."""
    rows = F.array(*[
        F.struct(F.lit(key).alias("_key"), *[v.alias(n) for v, n in zip(values, names)])
        for key, values in columns.items()
    ])
    return df.select(F.explode(rows).alias("r"))


def iqr_outliers(df: DataFrame, columns: list[str], limit: int = BRACKET_ROWS) -> DataFrame:
    """Per column: quartiles, the 1.5-IQR fences and how many rows lie outside.

    A report only: no row is removed.
    """
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], limit)
    fences = {}
    for c, (q1, q3) in quartiles.items():
        spread = (q3 - q1) * 1.5 if q1 is not None else None
        fences[c] = (q1, q3, q1 - spread, q3 + spread) if spread is not None else (None,) * 4
    counts = df.agg(*[
        F.count_if((F.col(c) < fences[c][2]) | (F.col(c) > fences[c][3])).alias(c) for c in columns
    ])
    entries = {c: [F.lit(v).cast("double") for v in fences[c]] + [F.col(c)] for c in columns}
    names = ["q1", "q3", "lower", "upper", "n_outliers"]
    return _long(counts, entries, names).select(F.col("r._key").alias("column"), *[f"r.{n}" for n in names])


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in long form, from one Gram aggregate.

    Each pair uses the rows where both values exist, as a correlation table does. NULL
    without such rows, NaN where one side doesn't vary.
    """
    g = gram(df, columns)
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    covariance, a, b = F.col("xy") - x * y / n, F.col("xx") - x * x / n, F.col("yy") - y * y / n
    # What is left of a constant's squares is rounding: less than its digits can hold.
    flat = (a <= 1e-14 * F.col("xx")) | (b <= 1e-14 * F.col("yy"))
    corr = F.when(flat, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), covariance / F.sqrt(a * b))))
    names = F.array(*map(F.lit, columns))
    return g.select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
        F.when(n.isNotNull(), F.when((F.col("i") == F.col("j")) & ~flat, F.lit(1.0)).otherwise(corr)).alias("corr"))


#: Rows whose products are summed at a time.
GRAM_ROWS = 8192


def gram(df: DataFrame, columns: Sequence[str], centre: Sequence[float] | None = None) -> DataFrame:
    """Sums of every ordered pair (i, j) of columns over the rows where both are finite.

    Rows ``i, j, n, x, y, xx, yy, xy``: the count, and the sums of both values, their squares
    and their product, each value less a common centre of its column, so that the sums
    keep their digits: its mean, unless it is given. Every task multiplies its rows' value and mask matrices; d * d short
    rows per task are summed by pair.
    """
    d = len(columns)
    values = [finite(F.col(c).cast("double")) for c in columns]
    if centre is None:
        first = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
        centre = [first[f"m{i}"] or 0.0 for i in range(d)]
    rows = df.select(*[(v - F.lit(m)).alias(f"v{i}") for i, (v, m) in enumerate(zip(values, centre))])
    i, j = (k.ravel().astype("int32") for k in np.meshgrid(range(d), range(d), indexing="ij"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((d, d)) for _ in range(6)]
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(at, GRAM_ROWS)
                x = np.column_stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(d)])
                known = np.isfinite(x)
                x, mask = np.where(known, x, 0.0), known.astype(float)
                one, square = x.T @ mask, (x * x).T @ mask
                for sums, more in zip(total, (mask.T @ mask, one, one.T, square, square.T, x.T @ x)):
                    sums += more
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), *(pa.array(t.ravel()) for t in total)], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    sums = rows.mapInArrow(products, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    out = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    # A pair without rows has no count, so that quotients are NULL.
    return out.withColumn("n", F.when(F.col("n") > 0, F.col("n")))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column, fitted once and applied as literals."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> Scaler:
        aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
        aggs += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
        row = df.agg(*aggs).first()
        scale = [row[f"s{i}"] for i in range(len(columns))]
        return Scaler(
            tuple(columns), tuple(row[f"m{i}"] for i in range(len(columns))),
            tuple(1.0 if s is None or s < 1e-12 else s for s in scale),
        )

    def expressions(self) -> dict[str, Column]:
        return {c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale)}

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": e for c, e in self.expressions().items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, m, s in zip(self.columns, self.mean, self.scale)})


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def side_counts(df: DataFrame, side: str, key: str) -> DataFrame:
    """Rows and distinct groups per side of a split."""
    per_group = df.groupBy(side, key).agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy(side).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def median_row(df: DataFrame, columns: list[str], limit: int = BRACKET_ROWS) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], limit).items()}


@dataclass(frozen=True)
class Moments:
    """Mean, sample covariance and population deviation of d features."""

    features: tuple[str, ...]
    n: int
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]
    std: tuple[float, ...]


def moments(df: DataFrame, features: Sequence[str]) -> Moments:
    """Moments of the rows that have all features, from one Gram aggregate."""
    d = len(features)
    known = df.select(*[finite(F.col(f).cast("double")).alias(f"_f{i}") for i, f in enumerate(features)]).dropna()
    first = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"_f{i}").alias(f"m{i}") for i in range(d)]).first()
    n = first["n"]
    if n < 2:
        raise ValueError("moments need at least two rows")
    product = [[0.0] * d for _ in range(d)]
    for r in gram(known, known.columns, [first[f"m{i}"] for i in range(d)]).collect():  # d * d rows
        product[r["i"]][r["j"]] = r["xy"] - r["x"] * r["y"] / n
    cov = tuple(tuple(v / (n - 1) for v in row) for row in product)
    std = tuple((max(0.0, product[i][i]) / n) ** 0.5 for i in range(d))
    return Moments(tuple(features), n, tuple(first[f"m{i}"] for i in range(d)), cov, std)


def mean_by_feature(df: DataFrame, features: list[str]) -> DataFrame:
    wide = df.agg(*[F.avg(f).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "mean")


def objective_stats(df: DataFrame, batch: str, value: str) -> DataFrame:
    return df.groupBy(batch).agg(
        F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min")
    )


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("accepted")).alias(reason)).agg(
        F.count(F.lit(1)).alias("n_rows"))


def suggest_params(df: DataFrame, limit: int = BRACKET_ROWS) -> DataFrame:
    """Sweep limits taken from a table: min, max and median of its positive values.

    The first matching alias column is used; fewer than two values give NULL.
    Stress is rounded to one decimal, temperature to whole degrees, half to even.
    """
    lower = {c.strip().lower(): c for c in df.columns}
    found = {
        kind: next((lower[a] for a in aliases if a in lower), None)
        for kind, aliases in (("stress", STRESS_ALIASES), ("temp", TEMP_ALIASES))
    }
    present = {k: c for k, c in found.items() if c}
    values = df.select(*[
        F.when(to_double(F.col(f"`{c}`")) > 0, finite(to_double(F.col(f"`{c}`")))).alias(k)
        for k, c in present.items()
    ])
    middle = exact_quantiles(values, list(present), [0.5], limit) if present else {}
    digits = {"stress": 1, "temp": 0}
    aggs, cells = [F.count(F.lit(1)).alias("n")], []
    for k in present:
        aggs += [F.count(k).alias(f"{k}_n"), F.min(k).alias(f"{k}_lo"), F.max(k).alias(f"{k}_hi")]
    for k in ("stress", "temp"):
        kind = "double" if k == "stress" else "int"
        if k in present:
            parts = (F.col(f"{k}_lo"), F.col(f"{k}_hi"), F.lit(middle[k][0]).cast("double"))
            enough = F.col(f"{k}_n") >= 2
            parts = [F.when(enough, half_even(v, digits[k])).cast(kind) for v in parts]
        else:
            parts = [F.lit(None).cast(kind)] * 3
        cells += [v.alias(n) for v, n in zip(parts, (f"{k}_min", f"{k}_max", f"fixed_{k}"))]
    return values.agg(*aggs).select(*cells)


def member_stats(members: str, mean: str = "member_mean", std: str = "member_std") -> list[Column]:
    """Mean and population deviation of an array of member predictions, per row."""
    size = F.size(members).cast("double")
    avg = F.aggregate(members, F.lit(0.0), lambda s, x: s + x) / size
    var = F.aggregate(members, F.lit(0.0), lambda s, x: s + (x - avg) * (x - avg)) / size
    return [avg.alias(mean), F.sqrt(var).alias(std)]


def first_per_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """First row per key in ``order``; copies collapse before the shuffle."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return (
        df.withColumn("_key", key)
        .withColumn("_rn", F.row_number().over(W.partitionBy("_key").orderBy(*order)))
        .filter(F.col("_rn") == 1)
        .drop("_rn", "_key")
    )


def dedup_rounded(df: DataFrame, columns: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """Rows that agree on all columns after rounding are one; the first wins."""
    return first_per_key(df, [half_even(F.coalesce(F.col(c), F.lit(0.0)), digits) for c in columns], order)


def dedup_batches(
    batch: DataFrame, existing: DataFrame | None, columns: list[str], order: list[str],
    target: int | None = None, digits: int = 6,
) -> DataFrame:
    """New rows of a batch by rounded design variables, up to a target count."""
    fresh = dedup_rounded(batch, columns, order, digits)
    if existing is not None:
        keys = [f"_k{i}" for i in range(len(columns))]
        rounded = [half_even(F.coalesce(F.col(c), F.lit(0.0)), digits).alias(k) for c, k in zip(columns, keys)]
        known = existing.select(*rounded).distinct()
        fresh = fresh.select("*", *rounded).join(known, keys, "left_anti").drop(*keys)
    return fresh.orderBy(*order).limit(target) if target is not None else fresh


def replicate(df: DataFrame, n: int, index: str = "copy") -> DataFrame:
    """Every row ``n`` times, numbered from 0."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
