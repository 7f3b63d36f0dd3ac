"""Exact, linearly interpolated quantiles that stay exact at any size.

A sketch brackets each wanted order statistic, plain scans narrow the bracket
while it is too wide, and one last scan counts what lies below it and the few
values inside. No task ever holds more than a bracket.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruptura.functions.numeric import finite

BRACKET_ROWS = 200_000
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], limit: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles per column; NULL, NaN and infinite values are left out."""
    values = df.select(*[finite(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    margin = 2.0 / ACCURACY
    shares = [x for p in probabilities for x in (max(0.0, p - margin), min(1.0, p + margin))]
    first = values.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))],
        *[F.percentile_approx(f"v{i}", shares, ACCURACY).alias(f"q{i}") for i in range(len(columns))],
    ).first()
    wanted = {}
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for j, p in enumerate(probabilities if n else []):
            lo, hi = first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]
            wanted[i, j] = _Bracket(f"v{i}", n, p * (n - 1), lo, hi, 4.0 * margin * n)
    for b in wanted.values():
        # The sketch returns data values near both ends; the ends themselves are safe.
        if b.position <= margin * b.n:
            b.lo = -math.inf
        if b.position >= (1.0 - margin) * (b.n - 1):
            b.hi = math.inf
    _narrow(values, [b for b in wanted.values()], limit)
    todo = list(wanted.values())
    while todo:
        todo = _read(values, todo)
    return {
        c: [wanted[i, j].value if (i, j) in wanted else None for j in range(len(probabilities))]
        for i, c in enumerate(columns)
    }


def quantile(df: DataFrame, column: str, probability: float, limit: int = BRACKET_ROWS) -> float | None:
    return exact_quantiles(df, [column], [probability], limit)[column][0]


class _Bracket:
    """Value range known (or believed) to hold the order statistics around a position."""

    def __init__(self, column: str, n: int, position: float, lo: float, hi: float, rows: float):
        self.column, self.n, self.position, self.lo, self.hi, self.rows = column, n, position, lo, hi, rows
        self.value: float | None = None

    @property
    def inside(self):
        c = F.col(self.column)
        return (c >= self.lo) & (c <= self.hi)


def _narrow(values: DataFrame, brackets: list[_Bracket], limit: int) -> None:
    """Shrink wide brackets with a sketch of what is inside them, all in one scan per round."""
    wide = [b for b in brackets if b.rows > limit and b.lo < b.hi]
    while wide:
        counts = values.agg(
            *[F.count_if(F.col(b.column) < b.lo).alias(f"b{k}") for k, b in enumerate(wide)],
            *[F.count_if(b.inside).alias(f"n{k}") for k, b in enumerate(wide)],
        ).first()
        cuts = []
        for k, b in enumerate(wide):
            inside = max(1, counts[f"n{k}"])
            share = (b.position - counts[f"b{k}"]) / inside
            margin = 2.0 / ACCURACY + 2.0 / inside
            cuts.append((max(0.0, share - margin), min(1.0, share + margin), inside, margin))
        sketch = values.agg(*[
            F.percentile_approx(F.when(b.inside, F.col(b.column)), list(cuts[k][:2]), ACCURACY).alias(f"q{k}")
            for k, b in enumerate(wide)
        ]).first()
        again = []
        for k, b in enumerate(wide):
            low, high, inside, margin = cuts[k]
            lo = sketch[f"q{k}"][0] if low > 0.0 else b.lo
            hi = sketch[f"q{k}"][1] if high < 1.0 else b.hi
            shrunk = (lo, hi) != (b.lo, b.hi)
            b.lo, b.hi, b.rows = lo, hi, 4.0 * margin * inside
            if shrunk and b.rows > limit and lo < hi:
                again.append(b)
        wide = again


def _read(values: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Fill in the values of all brackets; returns those that turned out to miss."""
    below = values.agg(*[F.count_if(F.col(b.column) < b.lo).alias(f"b{k}") for k, b in enumerate(brackets)]).first()
    entries = F.array(*[
        F.when(b.inside, F.struct(F.lit(k).alias("k"), F.col(b.column).alias("v"))) for k, b in enumerate(brackets)
    ])
    # Only values inside a bracket become rows.
    hist = (
        values.select(F.explode(F.array_compact(entries)).alias("e"))
        .groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    )
    rank = reduce(
        lambda e, kb: e.when(F.col("k") == kb[0], F.lit(math.floor(kb[1].position) - below[f"b{kb[0]}"])),
        enumerate(brackets), F.when(F.lit(False), F.lit(0)),
    )
    upto = hist.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("v")))
    found = {
        r["k"]: r
        for r in upto.groupBy("k").agg(
            F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b"),
        ).collect()
    }
    missed = []
    for k, b in enumerate(brackets):
        low = math.floor(b.position)
        a, c = (found[k]["a"], found[k]["b"]) if k in found else (None, None)
        if low + 1 >= b.n:
            c = a
        over = below[f"b{k}"] > low
        if a is None or c is None or over:
            # Sketch bounds missed the position: open the side that failed.
            if over:
                b.lo = -math.inf
            else:
                b.hi = math.inf
            missed.append(b)
        else:
            b.value = a + (c - a) * (b.position - low)
    return missed
