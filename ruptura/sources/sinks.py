"""Result sinks. Large results stay distributed files; only top-n results get an envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ruptura.operators.order import dense_index

PREDICTION_COLUMNS = [
    "stress", "temp", "y_true_log", "y_pred_log", "y_true_hours", "y_pred_hours", "error_log",
]


def write_predictions(df: DataFrame, path: str) -> None:
    df.select(*PREDICTION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def _stamp():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at")


def _conditions(conditions: dict[str, float | None]):
    return F.struct(*[F.lit(v).cast("double").alias(k) for k, v in conditions.items()]).alias("conditions")


#: Most candidates that one document may hold.
DOCUMENT_ROWS = 10_000


def write_candidates(
    df: DataFrame, path: str, conditions: dict[str, float | None], most: int = DOCUMENT_ROWS
) -> None:
    """Ranked candidates: CSV, and JSON documents with time, conditions and count.

    All rows are written, in their order. A document holds at most ``most`` of them; further ones go
    to further documents, numbered by ``part`` (a single document has part 0). The CSV stays in
    as many files as the rows have partitions.
    """
    placed = dense_index(df, None, "_at")
    flat(placed.drop("_at")).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("_at", F.struct(*df.columns).alias("row"))),
                     lambda a, b: F.signum(a["_at"] - b["_at"]).cast("int")),
        lambda e: e["row"])
    part = F.floor(F.col("_at") / most).cast("long").alias("part")
    placed.groupBy(part).agg(rows.alias("candidates")).select(
        _stamp(), "part", _conditions(conditions), F.size("candidates").alias("count"), "candidates"
    ).write.mode("overwrite").json(f"{path}/json")


def write_best(df: DataFrame, path: str, conditions: dict[str, float | None]) -> None:
    """The best candidate: CSV, and JSON with time and conditions."""
    best = df.limit(1)
    flat(best).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    best.select(_stamp(), _conditions(conditions), F.struct(*df.columns).alias("best")).coalesce(1) \
        .write.mode("overwrite").json(f"{path}/json")


def write_fit_summary(df: DataFrame, path: str, split: str) -> None:
    df.withColumn("split", F.lit(split)).write.mode("overwrite").option("header", True).csv(path)
