"""Bounded fitting samples that no frequent class can crowd others out of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import fresh_name, small

#: A class with fewer rows is no class: too little to learn from.
LEAST_ROWS = 5


def sample_by(rows: DataFrame, by: str, key: Column, bound: int, least: int = LEAST_ROWS) -> DataFrame:
    """About ``bound`` rows of each class (all, if there are fewer); classes of fewer than ``least`` rows give none.

    Rows are drawn by a hash of their key, so a recomputed task draws the same. The share
    is counted for each class, so a rare class is drawn whole however large the table is.
    """
    n = fresh_name(rows, "n_of_class")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) >= least)
    place = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    return rows.join(small(counts), by).where(place * F.col(n) < bound).drop(n)
