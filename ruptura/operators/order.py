"""Running counts, ranks and dense indexes that never sort a whole table in one task.

Every operator here works on two levels: rows are spread over buckets that
respect the wanted order, and only the per-bucket totals (one short row per
bucket) are accumulated globally. Equal values are pre-aggregated, so a value
that fills a third of the table is one row before the first shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruptura.functions.numeric import finite
from ruptura.runtime import checkpointed, written

BUCKET_ROWS = 250_000
MAX_BUCKETS = 4096


def order_buckets(df: DataFrame, by: str, out: str, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add an order-preserving bucket number for a numeric column without NULL or NaN."""
    buckets = min(MAX_BUCKETS, math.ceil(max(rows, 1) / bucket_rows))
    if buckets <= 1:
        return df.withColumn(out, F.lit(0.0))
    cuts = df.stat.approxQuantile(by, [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets))
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=by, outputCol=out).transform(df)


def running_totals(
    df: DataFrame, by: str, weights: dict[str, str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Per distinct value of ``by``: the sum of each weight, and its sum up to that value.

    ``weights`` maps output names to SQL expressions, e.g. ``{"n": "1"}``; the
    result has ``by``, ``n`` and ``cum_n``. Values that are NULL or NaN are left out.
    """
    hist = (
        df.select(finite(F.col(by).cast("double")).alias(by),
                  *[F.expr(e).alias(n) for n, e in weights.items()])
        .filter(F.col(by).isNotNull())
        .groupBy(by).agg(*[F.sum(n).alias(n) for n in weights])
    )
    hist = checkpointed(hist)
    bucketed = order_buckets(hist, by, "_bucket", hist.count(), bucket_rows)
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # One row per bucket, at most MAX_BUCKETS of them.
    offsets = (
        bucketed.groupBy("_bucket").agg(*[F.sum(n).alias(f"_s_{n}") for n in weights])
        .select("_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights])
    )
    within = W.partitionBy("_bucket").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return (
        bucketed.withColumns({f"_c_{n}": F.sum(n).over(within) for n in weights})
        .join(F.broadcast(offsets), "_bucket")
        .select(by, *weights, *[(F.col(f"_c_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in weights])
    )


def average_ranks(df: DataFrame, by: str, out: str = "rank", weight: str = "1") -> DataFrame:
    """Average rank (ties share the mean) per distinct value, with its row count ``n``."""
    runs = running_totals(df, by, {"n": weight})
    return runs.select(by, "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(out))


def attach(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with a per-key table, safe against hot keys.

    ``n`` holds each key's row count. Keys above ``total / share`` number fewer
    than ``share``, so they are broadcast; only the others are shuffled.
    """
    hot = table.filter(F.col(n) > total / share)
    cold = table.filter(F.col(n) <= total / share)
    hot_keys = F.broadcast(hot.select(key))
    return (
        rows.join(F.broadcast(hot), key, "inner")
        .unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key, "left"))
    )


def dense_index(df: DataFrame, order: list[str] | None, out: str, plain: bool = False) -> DataFrame:
    """Dense 0-based row number in ``order``, or in reading order when it is None.

    Rows are range-partitioned, numbered inside their partition, checkpointed so
    that the numbers survive lost executors, and shifted by partition totals.
    A last sort key spreads identical rows over partitions. ``plain`` says that Parquet
    can hold the columns; then the rows are kept so, in a fraction of the space.
    """
    if order:
        df = df.withColumn("_copy", F.monotonically_increasing_id()).orderBy(*order, "_copy").drop("_copy")
    numbered = df.withColumn("_pos", F.monotonically_increasing_id())
    placed = written(numbered, "placed") if plain else checkpointed(numbered)
    part = F.shiftright("_pos", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition.
    offsets = (
        placed.groupBy(part.alias("_part")).count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_offset", "_pos")
    )


#: Types whose order is the same in Arrow as in Spark, NULL first.
SORTABLE = (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)


@dataclass(frozen=True)
class OrderedRows:
    """Rows whose 0-based index is their place in an order; equal ones follow in reading order.

    ``indexed`` numbers all of them, which sorts the table. ``places`` numbers a few by
    counting what lies before them, which only reads it.
    """

    rows: DataFrame
    order: tuple[str, ...]

    def indexed(self) -> DataFrame:
        return dense_index(self.rows, list(self.order), "row_index", True).drop(*self.order)

    def countable(self) -> bool:
        return all(isinstance(self.rows.schema[o].dataType, SORTABLE) for o in self.order)

    def keyed(self) -> tuple[DataFrame, list[str]]:
        """The rows with all columns of their order; a scan deals them alike each time."""
        return self.rows.withColumn("_copy", F.monotonically_increasing_id()), [*self.order, "_copy"]

    def places(self, some: pa.Table) -> np.ndarray:
        """Index of each of a few rows, given with the columns of ``keyed``."""
        rows, keys = self.keyed()
        some = some.select(keys).combine_chunks()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = np.zeros(some.num_rows, dtype=np.int64)
            for batch in batches:
                # The sort is stable: a row that is asked for comes before its equal in the table.
                both = pa.concat_tables([some, pa.Table.from_batches([batch]).cast(some.schema)])
                at = sorted_places(both, keys)
                asked = at < some.num_rows
                before[at[asked]] += np.cumsum(~asked)[asked]
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(some.num_rows)), "n": pa.array(before)})

        found = rows.select(*keys).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(some.num_rows, dtype=np.int64)
        for r in found:
            out[r["i"]] = r["n"]
        return out


def sorted_places(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows in ascending order of some columns, NULL first; equal rows stay in their order."""
    options = pc.SortOptions([(k, "ascending") for k in keys], null_placement="at_start")
    return pc.sort_indices(table, options=options).to_numpy()


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks; NULL when one side does not vary.

    Ranks are centred at (n+1)/2, their exact mean, so one aggregation finishes it.
    """
    pairs = (
        df.select(finite(F.col(a).cast("double")).alias("_a"), finite(F.col(b).cast("double")).alias("_b"))
        .na.drop().groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_w"))
    )
    pairs = checkpointed(pairs)
    n = pairs.agg(F.sum("_w")).first()[0] or 0
    ranks_a = average_ranks(pairs, "_a", "_ra", "_w").withColumnRenamed("n", "_na")
    ranks_b = average_ranks(pairs, "_b", "_rb", "_w").withColumnRenamed("n", "_nb")
    ranked = attach(pairs, ranks_a, "_a", "_na", n)
    ranked = attach(ranked, ranks_b, "_b", "_nb", n)
    mean = (n + 1) / 2.0
    da, db, w = F.col("_ra") - mean, F.col("_rb") - mean, F.col("_w")
    sums = ranked.agg(
        F.sum(w * da * db).alias("sab"), F.sum(w * da * da).alias("saa"), F.sum(w * db * db).alias("sbb")
    )
    floor = 1e-24 * max(n, 1)
    return sums.select(
        F.when((F.col("saa") >= floor) & (F.col("sbb") >= floor),
               F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb"))).alias(out)
    )
