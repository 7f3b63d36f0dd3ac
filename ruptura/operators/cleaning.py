"""Column naming, missing values, validity filters and the multi-source union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ruptura.constants import (
    COOLING_COLS, DESIGN_ELEMENTS, FAMILY_BOUNDS, FAMILY_BOUNDS_RAW, FULL_ELEMENTS,
    KELVIN_OFFSET, LIFETIME_LIKE, LOG_TARGET, TARGET, DEFAULT_PRODUCT_PREFIX,
)
from ruptura.functions.numeric import finite, is_finite, number_or, to_double, total
from ruptura.operators.order import dense_index


def normalize_columns(df: DataFrame) -> DataFrame:
    """Element columns to their canonical spelling; ``rh`` is read as rhenium."""
    canonical = {e.lower(): e for e in FULL_ELEMENTS} | {"rh": "Re"}
    wanted = [canonical.get(c.strip().lower(), c) for c in df.columns]
    return df.toDF(*wanted)


def normalize_products(df: DataFrame, prefix: str = DEFAULT_PRODUCT_PREFIX) -> DataFrame:
    """Product table for scoring: trimmed names, no life columns, a ``name``, doubles.

    Values that are no numbers become 0. Rows without a name column are named
    by their position. An empty table is an error.
    """
    df = df.toDF(*[c.strip() for c in df.columns])
    df = df.withColumnsRenamed({c: "Re" for c in df.columns if c in ("Rh", "rh")})
    df = df.drop(*[c for c in df.columns if c.lower() in LIFETIME_LIKE])
    named = next((c for c in df.columns if c.lower() == "name"), None)
    if df.isEmpty():
        raise ValueError("the product table has no rows")
    if named is None:
        df = dense_index(df, None, "_number").withColumn(
            "name", F.concat(F.lit(prefix), (F.col("_number") + 1).cast("string"))
        ).drop("_number")
    else:
        df = df.withColumnRenamed(named, "name")
    others = [c for c in df.columns if c != "name"]
    return df.select("name", *[number_or(F.col(f"`{c}`")).alias(c) for c in others])


def handle_missing(
    df: DataFrame, composition: list[str], required: list[str] = (TARGET, "stress", "temp")
) -> DataFrame:
    """Missing composition means "not added" (0); rows without the essentials go."""
    return df.na.fill(0.0, list(composition)).na.drop(subset=list(required))


def drop_invalid(
    df: DataFrame,
    positive: list[str] = (TARGET, "stress", "temp"),
    non_negative: list[str] = ("Ntemp", "Ttemp", "Atemp"),
    observation: Observation | None = None,
) -> DataFrame:
    """Keep physically possible rows; an observation counts the rows dropped."""
    tests = [F.col(c) > 0 for c in positive] + [F.col(c) >= 0 for c in non_negative]
    # Spark ranks NaN above every number, so NaN has to fail explicitly.
    tests += [~F.isnan(c) for c in (*positive, *non_negative)]
    valid = reduce(lambda a, b: a & b, tests)
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.coalesce(valid, F.lit(False))).alias("removed"),
        )
    return df.filter(valid)


def log_target(df: DataFrame, target: str = TARGET, out: str = LOG_TARGET) -> DataFrame:
    return df.withColumn(out, F.log10(target))


def feature_columns(columns: list[str], extra: list[str] = ()) -> list[str]:
    """All columns but the target, its logarithm and the raw cooling codes."""
    exclude = {TARGET, LOG_TARGET, *COOLING_COLS, *extra}
    return [c for c in columns if c not in exclude]


def valid_lmp_rows(df: DataFrame, temp="temp", stress="stress", log_life=LOG_TARGET) -> DataFrame:
    """Rows a Larson-Miller fit can use."""
    return df.filter(
        is_finite(temp) & is_finite(stress) & is_finite(log_life)
        & (F.col(stress) > 0) & (F.col(temp) > 0)
    )


def alloy_balance(df: DataFrame, elements: list[str] = tuple(FULL_ELEMENTS)) -> DataFrame:
    """Add ``total_alloy`` and ``fe_balance``; a given Fe value wins."""
    present = [e for e in elements if e in df.columns and e.upper() != "FE"]
    amount = total(F.coalesce(F.col(e), F.lit(0.0)) for e in present)
    rest = F.lit(100.0) - amount
    given = next((c for c in ("Fe", "FE") if c in df.columns), None)
    balance = number_or_else(given, rest) if given else rest
    return df.withColumn("total_alloy", amount).withColumn("fe_balance", balance)


def number_or_else(name: str, other: Column) -> Column:
    value = to_double(F.col(name))
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), other)


def family_filter(df: DataFrame, bounds: dict = FAMILY_BOUNDS) -> DataFrame:
    """Fe-rich 9-12Cr rows; rows with unreadable Cr or Ni do not pass."""
    missing = [c for c in ("Cr", "Ni") if c not in df.columns]
    if missing:
        raise KeyError(f"family filter needs columns {missing}")
    cr, ni = number_or("Cr", -9999.0), number_or("Ni", 9999.0)
    kept = df.columns
    return (
        alloy_balance(df)
        .filter(
            cr.between(*bounds["cr"]) & ni.between(*bounds["ni"])
            & (F.col("fe_balance") >= bounds["fe_min"])
            & (F.col("total_alloy") <= bounds["total_max"])
        )
        .select(*kept)
    )


def family_filter_raw(
    df: DataFrame, bounds: dict = FAMILY_BOUNDS_RAW, elements: list[str] = tuple(DESIGN_ELEMENTS)
) -> DataFrame:
    """Family filter for raw tables: each test applies only if its column exists."""
    tests = []
    if "Cr" in df.columns:
        tests.append(number_or("Cr", -9999.0).between(*bounds["cr"]))
    if "Ni" in df.columns:
        tests.append(number_or("Ni", 0.0) <= bounds["ni_max"])
    present = [e for e in elements if e in df.columns]
    if present:
        tests.append(total(number_or(e, 0.0) for e in present) <= bounds["total_max"])
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def complete_cases(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows where every feature is a number."""
    return df.withColumns({f: finite(to_double(F.col(f))) for f in features}).na.drop(subset=features)


def active_features(df: DataFrame, features: list[str], floor: float = 1e-12) -> list[str]:
    """Features that vary at all; fewer than two is an error."""
    row = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    active = [f for f in features if row[f] is not None and row[f] > floor]
    if len(active) < 2:
        raise ValueError("fewer than two features vary")
    return active


def union_sources(frames: dict[str, DataFrame], celsius: dict[str, list[str]] | None = None) -> DataFrame:
    """Union of test tables under one schema, tagged with their source.

    ``celsius`` names, per source, the temperature columns to turn into kelvin;
    a stage temperature of 0 means "no such stage" and stays 0.
    """
    parts = []
    for name, df in frames.items():
        df = normalize_columns(df)
        shift = {
            c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c) + KELVIN_OFFSET)
            for c in (celsius or {}).get(name, [])
        }
        parts.append(df.withColumns(shift).withColumn("source", F.lit(name)) if shift
                     else df.withColumn("source", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
