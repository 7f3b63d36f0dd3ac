"""Compositions: full vectors, totals, cost, mole fractions, shares, repair, random rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ruptura.constants import (
    ATOMIC_WEIGHTS, DESIGN_BOUNDS, DESIGN_ELEMENTS, ELEMENT_COST, FIXED_ELEMENTS, FULL_ELEMENTS,
    HEAT_COLS, KELVIN_OFFSET, MAX_NON_IRON_MOLES, MAX_TOTAL_ALLOY, MOLE_ELEMENTS, RULE_SEEDS,
    STAGE_LABELS,
)
from ruptura.functions.numeric import clip, half_even, number_or, to_double_or, total


def element(df: DataFrame, name: str) -> Column:
    """Element amount of a row; absent, missing or unreadable is 0."""
    if name not in df.columns:
        return F.lit(0.0)
    if df.schema[name].dataType == DoubleType():
        return F.coalesce(F.col(name), F.lit(0.0))
    return to_double_or(F.col(name))


def full_composition(df: DataFrame) -> DataFrame:
    """All elements in fixed order: absent ones are 0, fixed ones overwrite the input."""
    kept = [c for c in df.columns if c not in FULL_ELEMENTS]
    cells = [
        (F.lit(FIXED_ELEMENTS[e]) if e in FIXED_ELEMENTS else element(df, e)).alias(e) for e in FULL_ELEMENTS
    ]
    return df.select(*kept, *cells)


def from_map(df: DataFrame, column: str = "composition") -> DataFrame:
    """Composition map to one column per design element; missing or bad values are 0."""
    cells = {e: to_double_or(F.col(column)[e]) for e in DESIGN_ELEMENTS}
    return df.withColumns(cells).drop(column)


def total_alloy(columns: list[str] = tuple(FULL_ELEMENTS)) -> Column:
    return total(columns)


def fe_balance() -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - total_alloy())


def within_total_limit(limit: float = MAX_TOTAL_ALLOY) -> Column:
    return total_alloy() <= limit


def material_cost() -> Column:
    """Raw-material cost index, iron balance included."""
    parts = [F.col(e) * ELEMENT_COST[e] for e in FULL_ELEMENTS]
    return reduce(add, parts, fe_balance() * ELEMENT_COST["Fe"]) / 100.0


def mole_fractions(df: DataFrame) -> DataFrame:
    """wt% to mole fractions ``x_<element>`` with iron as balance.

    Elements that are not positive have no fraction (NULL). ``mole_error`` says
    why a row has no valid result: nothing to convert, or too little iron.
    """
    moles = {e: F.when(F.col(e) > 0, F.col(e) / ATOMIC_WEIGHTS[e]) for e in MOLE_ELEMENTS}
    iron = fe_balance() / ATOMIC_WEIGHTS["Fe"]
    amount = reduce(add, [F.coalesce(m, F.lit(0.0)) for m in moles.values()], iron)
    safe = F.when(amount > 0, amount)
    others = reduce(add, [F.coalesce(m, F.lit(0.0)) for m in moles.values()]) / safe
    error = (
        F.when(amount <= 0, F.lit("total mole amount is zero"))
        .when(others >= MAX_NON_IRON_MOLES, F.format_string("non-Fe sum too high = %.6f", others))
    )
    return df.withColumns(
        {"x_Fe": iron / safe} | {f"x_{e}": m / safe for e, m in moles.items()} | {"mole_error": error}
    )


def composition_shares(df: DataFrame, key: list[str], elements: list[str] = tuple(FULL_ELEMENTS)) -> DataFrame:
    """Long list of the elements present (4 decimals) plus the iron balance (3 decimals)."""
    names = {e: f"_r_{e}" for e in elements}
    df = df.withColumns({n: half_even(F.when(number_or(e) > 0, number_or(e)), 4) for e, n in names.items()})
    rest = reduce(add, [F.coalesce(F.col(n), F.lit(0.0)) for n in names.values()])
    df = df.withColumn("_rest", F.greatest(F.lit(0.0), F.lit(100.0) - rest))
    df = df.withColumn("_iron", half_even("_rest", 3))
    entries = F.array(
        F.struct(F.lit("Fe (bal.)").alias("element"), F.when(F.col("_iron") > 0, F.col("_iron")).alias("wt")),
        *[F.struct(F.lit(e).alias("element"), F.col(n).alias("wt")) for e, n in names.items()],
    )
    return (
        df.select(*key, F.explode(entries).alias("s")).filter(F.col("s.wt").isNotNull())
        .select(*key, "s.element", "s.wt")
    )


def compare_composition(a: DataFrame, b: DataFrame, elements: list[str] = tuple(DESIGN_ELEMENTS)) -> DataFrame:
    """Two candidates side by side per element; an absent element counts as 0.

    Both inputs hold one candidate each.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[number_or(e).alias(e) for e in elements]).unpivot([], list(elements), "element", name)

    both = long(a, "best_wt").join(long(b, "selected_wt"), "element", "full")
    return both.na.fill(0.0, ["best_wt", "selected_wt"])


def heat_stages(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per heat-treatment stage that takes place: kelvin, Celsius and hours."""
    entries = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(p).alias("prefix"),
            number_or(f"{p}temp").alias("temp_k"),
            half_even(number_or(f"{p}temp") - KELVIN_OFFSET, 1).alias("temp_c"),
            half_even(number_or(f"{p}time"), 2).alias("time_h"),
        )
        for p, label in STAGE_LABELS.items()
    ])
    return (
        df.select(*key, F.explode(entries).alias("s")).filter(F.col("s.temp_k") > 0)
        .select(*key, "s.label", "s.prefix", "s.temp_k", "s.temp_c", "s.time_h")
    )


def heat_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.lit(defaults[c]) for c in HEAT_COLS if c not in df.columns})


# --- repair -----------------------------------------------------------------

def design_budget(fixed: dict[str, float] = FIXED_ELEMENTS, limit: float = MAX_TOTAL_ALLOY) -> float:
    return limit - sum(fixed.values())


def repair(
    df: DataFrame, bounds: dict[str, tuple[float, float]] = DESIGN_BOUNDS, budget: float | None = None
) -> DataFrame:
    """Bring rows into the design space: clip to bounds, then shrink to the budget.

    The excess is taken from each element in proportion to its headroom above
    its lower bound; a second pass removes what rounding leaves over.
    """
    budget = design_budget() if budget is None else budget
    if budget < sum(low for low, _ in bounds.values()):
        raise ValueError("the design space is empty: the lower bounds exceed the total allowed")
    df = df.withColumns({e: clip(e, F.lit(low), F.lit(high)) for e, (low, high) in bounds.items()})
    for final in (False, True):
        df = _shrink(df, bounds, budget, collapse=not final)
    return df


def _shrink(df: DataFrame, bounds: dict, budget: float, collapse: bool) -> DataFrame:
    room = total(F.col(e) - F.lit(low) for e, (low, _) in bounds.items())
    df = df.withColumns({"_excess": total(list(bounds)) - F.lit(budget), "_room": room})
    over, some = F.col("_excess") > 0, F.col("_room") > 1e-12
    cells = {}
    for e, (low, high) in bounds.items():
        cut = F.col(e) - F.col("_excess") * (F.col(e) - low) / F.col("_room")
        shrunk = F.when(over & some, clip(cut, F.lit(low), F.lit(high)))
        cells[e] = shrunk.when(over, F.lit(low)).otherwise(F.col(e)) if collapse else shrunk.otherwise(F.col(e))
    return df.withColumns(cells).drop("_excess", "_room")


def random_candidates(spark: SparkSession, n: int, seed: int = 42, bounds: dict = DESIGN_BOUNDS) -> DataFrame:
    """Uniform rows inside the bounds, repaired to the total limit.

    The value depends on the row number and the seed only, so a lost task
    recomputes the same rows however the range is partitioned.
    """
    rows = spark.range(n).withColumnRenamed("id", "candidate_id")
    return repair(draw_uniform(rows, ["candidate_id"], seed, bounds), bounds)


def draw_uniform(df: DataFrame, key: list[str], seed: int, bounds: dict = DESIGN_BOUNDS) -> DataFrame:
    cells = {e: low + unit_hash(key, f"{seed}:{e}") * (high - low) for e, (low, high) in bounds.items()}
    return df.withColumns(cells)


def unit_hash(key: list[str], salt: str) -> Column:
    """Repeatable uniform number in [0, 1) from a row key (13 hex digits = 52 bits)."""
    text = F.md5(F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in key]))
    # By way of a long: the digits fit one, and reading them as a double is slow.
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16 ** 13))


def seed_candidates(df: DataFrame) -> DataFrame:
    """Seed rows to repaired design vectors; missing elements start at 0."""
    return repair(df.withColumns({e: element(df, e) for e in DESIGN_ELEMENTS}))


def rule_based_seeds(spark: SparkSession) -> DataFrame:
    """The built-in seed compositions."""
    schema = "seed_id int, " + ", ".join(f"{e} double" for e in DESIGN_ELEMENTS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULE_SEEDS, 1)], schema)
