"""Saving and loading distance references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_ELEMENTS, OOD_DEFAULT_THRESHOLD
from ruptura.operators.ood import OodReference
from ruptura.operators.ranks import load_rank_index, rank_index, save_rank_index
from ruptura.plans.ood import OodModel
from ruptura.sources.tables import path_exists

# --- fixed values: names under which a stored reference may hold its parts --
ALIASES = {
    "mean": ["ood_reference_mean", "reference_mean", "composition_mean", "mean"],
    "cov_inv": ["ood_reference_cov_inv", "reference_cov_inv", "composition_cov_inv", "cov_inv", "inverse_covariance"],
    "features": ["ood_reference_features", "reference_features", "composition_features", "features"],
    "threshold": ["ood_distance_threshold", "reference_threshold", "mahalanobis_threshold", "threshold"],
    "std": ["ood_reference_std", "reference_std", "composition_std", "std"],
}


def save_reference(
    ref: OodReference, path: str, spark: SparkSession,
    distances: DataFrame | None = None, rows: DataFrame | None = None,
) -> None:
    """The fitted numbers as small tables; training distances and reference rows as large ones."""
    stats = [
        (i, f, ref.mean[i], ref.std[i], list(ref.cov_inv[i])) for i, f in enumerate(ref.features)
    ]
    schema = "idx int, feature string, mean double, std double, cov_inv array<double>"
    spark.createDataFrame(stats, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    meta = [(ref.threshold, ref.quantile, ref.n_rows, ref.distance_mean, ref.distance_max)]
    schema = "threshold double, quantile double, n_rows long, distance_mean double, distance_max double"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if distances is not None:
        distances.write.mode("overwrite").parquet(f"{path}/train_distances")
        save_rank_index(distances, distances.columns[0], f"{path}/ranks", "overwrite")
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{path}/reference_rows")


def reference_from_payload(df: DataFrame) -> OodReference | None:
    """A one-row table that holds a reference under any of its known names."""
    def pick(part: str):
        present = [F.col(a) for a in ALIASES[part] if a in df.columns]
        return F.coalesce(*present).alias(part) if present else F.lit(None).alias(part)

    row = df.select(*[pick(p) for p in ALIASES]).first()
    if row is None or row["mean"] is None or row["cov_inv"] is None:
        return None
    features = tuple(row["features"] or DESIGN_ELEMENTS)
    threshold = OOD_DEFAULT_THRESHOLD if row["threshold"] is None else float(row["threshold"])
    cov_inv = tuple(tuple(float(v) for v in r) for r in row["cov_inv"])
    std = tuple(float(v) for v in row["std"]) if row["std"] else (1.0,) * len(features)
    return OodReference(features, tuple(float(v) for v in row["mean"]), cov_inv, std, threshold)


def load_reference(spark: SparkSession, paths: Sequence[str], required: bool = True) -> OodReference | None:
    """The first usable reference among folders and JSON payloads; none is an error when required."""
    problems = []
    for path in paths:
        if not path_exists(spark, path):
            problems.append(f"{path}: not found")
            continue
        if path.lower().endswith(".json"):
            ref = reference_from_payload(spark.read.option("multiLine", True).json(path))
            if ref is not None:
                return ref
            problems.append(f"{path}: no reference inside")
            continue
        stats = spark.read.parquet(f"{path}/stats").orderBy("idx").collect()
        meta = spark.read.parquet(f"{path}/meta").first()
        threshold = OOD_DEFAULT_THRESHOLD if meta["threshold"] is None else meta["threshold"]
        return OodReference(
            tuple(r["feature"] for r in stats), tuple(r["mean"] for r in stats),
            tuple(tuple(r["cov_inv"]) for r in stats), tuple(r["std"] for r in stats),
            threshold, meta["quantile"], meta["n_rows"], meta["distance_mean"], meta["distance_max"])
    if required:
        raise RuntimeError("no distance reference found: " + "; ".join(problems))
    return None


def rows_of_payload(df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Training distances and reference rows that a payload holds, as tables; none where it doesn't.

    Rows without ``row_index`` are numbered by their place in the payload.
    """
    distances = rows = None
    if "train_distances" in df.columns:
        distances = df.select(F.explode("train_distances").alias("ood_distance")).select(F.col("ood_distance").cast("double"))
    if "reference_rows" in df.columns:
        placed = df.select(F.posexplode("reference_rows").alias("place", "r"))
        fields = placed.select("r.*").columns
        given = F.col("r.row_index").cast("long") if "row_index" in fields else F.lit(None).cast("long")
        rows = placed.select(F.coalesce(given, F.col("place").cast("long")).alias("row_index"), *[F.col(f"r.`{c}`").alias(c) for c in fields if c != "row_index"])
    return distances, rows


def load_model(spark: SparkSession, path: str) -> OodModel:
    """A saved reference or a JSON payload whole: its numbers, its training distances as a rank index, and its rows."""
    reference = load_reference(spark, [path])
    if not path.lower().endswith(".json"):
        return OodModel(reference, load_rank_index(spark, f"{path}/ranks"), load_reference_rows(spark, path))
    distances, rows = rows_of_payload(spark.read.option("multiLine", True).json(path))
    if distances is None:
        distances = spark.createDataFrame([], "ood_distance double")
    if rows is None:
        fields = ", ".join(f"`{f}` double" for f in reference.features)
        rows = spark.createDataFrame([], f"row_index long, {fields}")
    return OodModel(reference, rank_index(distances, "ood_distance"), rows)


def load_train_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/train_distances")


def load_reference_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/reference_rows")
