"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruptura.runtime import checkpointed, ensure_checkpoint_dir

__all__ = ["table", "checkpointed", "stored", "small", "fit_sample", "fresh_name", "words_of"]

#: A table is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a large table: written as Parquet, a fraction of a checkpoint's size, in the shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has been counted to be small; otherwise the planner shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def fit_sample(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows (all, if there are fewer) for fitting a classifier.

    Rows are drawn by a hash of their key, so a recomputed task draws the same.
    Rows with equal keys are drawn together. The whole range of the hash is used, so
    that tables of any size give a sample.
    """
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.xxhash64(key) < F.lit(draw_limit(bound, total)))


def draw_limit(bound: int, total: int) -> int:
    """Signed 64-bit hashes below this are the share ``bound / total`` of all."""
    return (bound << 64) // total - (1 << 63)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
