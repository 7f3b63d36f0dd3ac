"""Group-wise train/test splits that never put one group on both sides.

Groups are ordered by ``md5(seed:key)``. The test side is then everything up to
one cut in that order, so finding the split means finding the cut, and applying
it is a row filter: no join with the chosen groups, whatever their number and
however large a single group is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruptura.functions.numeric import half_even

DIGITS = 3
#: Rows without a group form a group of their own.
NO_GROUP = "\x00"
GROUP_LIMIT = 200_000


def group_key(columns: list[str], digits: int | None = None) -> Column:
    """Composition columns as one text key, optionally rounded first; a missing value reads ``nan``."""
    parts = [F.col(c) if digits is None else half_even(F.col(c), digits) for c in columns]
    return F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def group_text(key: str | Column) -> Column:
    """A group's name as text, never NULL."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(key.cast("string"), F.lit(NO_GROUP))


def order_hash(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), group_text(key)))


@dataclass(frozen=True)
class GroupCut:
    """Last group of the test side in hash order."""

    key: str
    seed: int
    cut_hash: str
    cut_key: str

    def is_test(self) -> Column:
        h = order_hash(self.key, self.seed)
        k = group_text(self.key)
        return (h < self.cut_hash) | ((h == self.cut_hash) & (k <= self.cut_key))

    def is_train(self) -> Column:
        """The opposite, said so that most rows are decided by one hash."""
        h = order_hash(self.key, self.seed)
        k = group_text(self.key)
        return (h > self.cut_hash) | ((h == self.cut_hash) & (k > self.cut_key))

    def test(self, df: DataFrame) -> DataFrame:
        return df.filter(self.is_test())

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(self.is_train())


def _find_cut(df: DataFrame, key: str, seed: int, target: float, measure: str, limit: int) -> GroupCut:
    """Walk down the hash digits to the group where the running measure meets the target.

    ``measure`` is "rows" or "groups". Each level reads 16**DIGITS short totals;
    the last level sorts only the groups that share one hash prefix.
    """
    h = order_hash(key, seed)
    base = df.select(h.alias("h"), group_text(key).alias("k"))
    prefix, before = "", 0
    while True:
        inside = base.filter(F.col("h").startswith(prefix)) if prefix else base
        groups = inside.groupBy("h", "k").agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("groups"))
        if len(prefix) + DIGITS > 32:
            break
        digit = F.substring("h", len(prefix) + 1, DIGITS).alias("digit")
        if measure == "rows":
            level = inside.groupBy(digit).agg(
                F.count(F.lit(1)).alias("m"), F.approx_count_distinct("h").alias("g"))
        else:
            level = groups.groupBy(digit).agg(F.sum("groups").alias("m"), F.count(F.lit(1)).alias("g"))
        totals = sorted(level.collect(), key=lambda r: r["digit"])  # at most 16**DIGITS rows
        if sum(r["g"] for r in totals) <= limit:
            break
        for r in totals:
            if before + r["m"] >= target:
                prefix += r["digit"]
                break
            before += r["m"]
    upto = F.sum(measure).over(W.orderBy("h", "k").rowsBetween(W.unboundedPreceding, 0))
    picked = (
        groups.withColumn("upto", upto + F.lit(before))
        .filter(F.col("upto") - F.col(measure) < target)
        .agg(F.max(F.struct("h", "k")).alias("last")).first()["last"]
    )
    return GroupCut(key, seed, picked["h"], picked["k"])


def group_holdout(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, limit: int = GROUP_LIMIT
) -> GroupCut:
    """Whole groups in hash order until the test side has its share of the rows."""
    target = max(1, round(df.count() * test_size))
    return _find_cut(df, key, seed, target, "rows", limit)


def group_share(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, limit: int = GROUP_LIMIT
) -> GroupCut:
    """A share of the groups, not of the rows, for the test side."""
    n_groups = df.select(key).distinct().count()
    return _find_cut(df, key, seed, math.ceil(n_groups * test_size), "groups", limit)


@dataclass(frozen=True)
class NestedSplit:
    """Outer test side, then a validation side inside the outer train side."""

    outer: GroupCut
    inner: GroupCut

    def side(self) -> Column:
        return (
            F.when(self.outer.is_test(), F.lit("test"))
            .when(self.inner.is_test(), F.lit("validation"))
            .otherwise(F.lit("train"))
        )


def nested_split(
    df: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.15, seed: int = 42
) -> NestedSplit:
    outer = group_holdout(df, key, test_size, seed)
    return NestedSplit(outer, group_holdout(outer.train(df), key, val_size, seed + 17))
