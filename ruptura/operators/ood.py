"""Distance of a composition from known data: fit, score, explain, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.constants import (
    DESIGN_ELEMENTS, OOD_DEFAULT_THRESHOLD, OOD_MISMATCH_VALUE, OOD_PENALTY_WEIGHT, OOD_QUANTILE, OOD_RIDGE,
)
from ruptura.functions.numeric import finite, total
from ruptura.functions.physics import excess_penalty
from ruptura.operators.cleaning import active_features, complete_cases
from ruptura.operators.quantiles import exact_quantiles
from ruptura.operators.stats import Moments, moments
from ruptura.runtime import written


@dataclass(frozen=True)
class OodReference:
    """Small fitted model: d means, a d x d inverse, d deviations and a threshold."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    cov_inv: tuple[tuple[float, ...], ...]
    std: tuple[float, ...]
    threshold: float | None = OOD_DEFAULT_THRESHOLD
    quantile: float = OOD_QUANTILE
    n_rows: int = 0
    distance_mean: float | None = None
    distance_max: float | None = None

    def mismatch(self) -> str | None:
        d = len(self.features)
        if len(self.mean) != d:
            return f"reference mean has {len(self.mean)} values for {d} features"
        if len(self.cov_inv) != d or any(len(r) != d for r in self.cov_inv):
            return f"reference inverse is not {d} x {d}"
        return None


def regularised_inverse(cov: Sequence[Sequence[float]], ridge: float = OOD_RIDGE, scaled: bool = False):
    """Pseudo-inverse of the covariance plus a ridge.

    With ``scaled`` the ridge is multiplied by the mean variance, at least 1.
    The matrix is d x d, so this is the one step done on the driver.
    """
    matrix = np.asarray(cov, dtype=float)
    d = matrix.shape[0]
    amount = ridge * max(float(np.trace(matrix)) / d, 1.0) if scaled else ridge
    inverse = np.linalg.pinv(matrix + amount * np.eye(d))
    return tuple(tuple(float(v) for v in row) for row in inverse)


def fit_reference(
    df: DataFrame, features: Sequence[str], quantile: float = OOD_QUANTILE,
    ridge: float = OOD_RIDGE, scaled_ridge: bool = False,
) -> OodReference:
    """Moments, inverse and the distance threshold of a reference table; a missing value counts as 0, as in distances."""
    return fit_with_distances(df, features, quantile, ridge, scaled_ridge)[0]


def fit_with_distances(
    df: DataFrame, features: Sequence[str], quantile: float = OOD_QUANTILE,
    ridge: float = OOD_RIDGE, scaled_ridge: bool = False,
) -> tuple[OodReference, DataFrame]:
    """A fitted reference, and the distances ``d`` of its rows, which the fit keeps anyway."""
    df = df.withColumns({f: F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) for f in features})
    m: Moments = moments(df, features)
    std = tuple(1.0 if s < 1e-12 else s for s in m.std)
    ref = OodReference(m.features, m.mean, regularised_inverse(m.cov, ridge, scaled_ridge), std, None, quantile, m.n)
    # Read by several scans, which would otherwise each work the long formula out, and more than once a row.
    distances = written(df.select(mahalanobis(ref).alias("d")), "distances")
    summary = distances.agg(F.avg("d").alias("mean"), F.max("d").alias("max")).first()
    threshold = exact_quantiles(distances, ["d"], [quantile])["d"][0]
    return OodReference(
        ref.features, ref.mean, ref.cov_inv, ref.std, threshold, quantile, m.n, summary["mean"], summary["max"]), distances


def fit_reference_raw(
    df: DataFrame, features: Sequence[str] = tuple(DESIGN_ELEMENTS),
    quantile: float = OOD_QUANTILE, ridge: float = OOD_RIDGE,
) -> OodReference:
    """Reference from a raw table: complete rows, varying features, scaled ridge."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns {missing}")
    rows = complete_cases(df, list(features))
    least = max(20, len(features) + 5)
    if len(rows.take(least)) < least:
        raise ValueError(f"fewer than {least} complete rows")
    return fit_reference(rows, active_features(rows, list(features)), quantile, ridge, scaled_ridge=True)


def _diff(ref: OodReference) -> list[Column]:
    return [F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) - m for f, m in zip(ref.features, ref.mean)]


def mahalanobis(ref: OodReference) -> Column:
    """Distance of a row from the reference, as one unrolled expression."""
    diff = _diff(ref)
    d = len(diff)
    terms = []
    for i in range(d):
        terms.append(diff[i] * diff[i] * ref.cov_inv[i][i])
        terms += [diff[i] * diff[j] * (ref.cov_inv[i][j] + ref.cov_inv[j][i]) for j in range(i + 1, d)]
    return F.sqrt(F.greatest(F.lit(0.0), total(terms)))


def ood_penalty(df: DataFrame, ref: OodReference | None) -> DataFrame:
    """Add distance, threshold, penalty and error text.

    No reference costs nothing; a reference that does not fit its own features
    gives the worst value and says why.
    """
    error = ref.mismatch() if ref else None
    if ref is None or error:
        worst = OOD_MISMATCH_VALUE if error else 0.0
        return df.withColumns({
            "ood_distance": F.lit(worst), "ood_penalty": F.lit(worst),
            "ood_distance_threshold": F.lit(None).cast("double"), "ood_error": F.lit(error).cast("string"),
        })
    threshold = OOD_DEFAULT_THRESHOLD if ref.threshold is None else ref.threshold
    return (
        df.withColumn("ood_distance", mahalanobis(ref))
        .withColumn("ood_distance_threshold", F.lit(threshold))
        .withColumn("ood_penalty", excess_penalty("ood_distance", threshold, "upper", OOD_PENALTY_WEIGHT))
        .withColumn("ood_error", F.lit(None).cast("string"))
    )


def explain(df: DataFrame, ref: OodReference, out: str = "ood_top_contributors", top: int | None = 5) -> DataFrame:
    """Add what drives the distance: one struct per feature, largest effect first.

    ``raw_contribution`` sums to the squared distance and may be negative.
    """
    d = len(ref.features)
    names = [f"_raw{i}" for i in range(d)]
    diff = [f"_diff{i}" for i in range(d)]
    staged = df.withColumns(dict(zip(diff, _diff(ref)))).withColumns({
        names[i]: F.col(diff[i]) * total(F.col(diff[j]) * ref.cov_inv[i][j] for j in range(d)) for i in range(d)
    })
    staged = staged.withColumn("_amount", total(F.abs(F.col(n)) for n in names))
    rows = [
        F.struct(
            (-F.abs(F.col(names[i]))).alias("_order"), F.lit(i).alias("_i"), F.lit(f).alias("element"),
            F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("candidate_value"),
            F.lit(ref.mean[i]).alias("reference_mean"), F.col(diff[i]).alias("difference"),
            F.col(names[i]).alias("raw_contribution"),
            F.when(F.col("_amount") > 1e-12, F.abs(F.col(names[i])) / F.col("_amount"))
            .otherwise(F.lit(0.0)).alias("abs_share"),
        )
        for i, f in enumerate(ref.features)
    ]
    ordered = F.sort_array(F.array(*rows))
    kept = ordered if top is None else F.slice(ordered, 1, top)
    shown = F.transform(kept, lambda r: r.dropFields("_order", "_i"))
    return staged.withColumn(out, shown).drop(*names, *diff, "_amount")


def contributions_long(df: DataFrame, ref: OodReference, key: list[str], top: int | None = None) -> DataFrame:
    exploded = explain(df, ref, "_c", top).select(*key, F.posexplode("_c").alias("pos", "c"))
    return exploded.select(*key, (F.col("pos") + 1).alias("rank"), "c.*")
