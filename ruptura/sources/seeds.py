"""Seed compositions: JSON files, free text, and the validated-seed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruptura.constants import (
    CONTROL_PATTERN, DESIGN_ELEMENTS, FIXED_ELEMENTS, FULL_ELEMENTS, MAX_TOTAL_ALLOY, SEED_BLOCK_PATTERN,
    SEED_VERSION,
)
from ruptura.operators.composition import from_map, rule_based_seeds
from ruptura.operators.order import dense_index
from ruptura.sources.tables import path_exists

SEED_TYPE = "array<struct<composition: map<string,double>>>"
ENVELOPE = f"composition map<string,double>, seeds {SEED_TYPE}"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a JSON file or a folder of them, lists or ``{"seeds": [...]}``; a missing file has none.

    Seeds are numbered from 1 by file and by position in it.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "seed_id long, composition map<string,double>")
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    wrapped = F.when(F.col("seeds").isNotNull(), F.col("seeds")).otherwise(F.array(F.struct("composition")))
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"),
        F.posexplode(wrapped).alias("pos", "seed"),
    ).filter("seed.composition is not null")
    return dense_index(placed, ["file", "row", "pos"], "index").select(
        (F.col("index") + 1).alias("seed_id"), F.col("seed.composition").alias("composition")
    )


def extract_seed_json(df: DataFrame, text: str, out: str = "composition", key: list[str] = ()) -> DataFrame:
    """Compositions found in free text: the block from the first ``[{`` to the last ``}]``.

    Control characters are removed before parsing. A text without a readable
    block gives one row with NULL, so no text is lost.
    """
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    block = F.regexp_extract(body, SEED_BLOCK_PATTERN, 0)
    block = F.regexp_replace(F.when(block == "", body).otherwise(block), CONTROL_PATTERN, "")
    listed = F.from_json(block, SEED_TYPE)
    wrapped = F.from_json(block, f"seeds {SEED_TYPE}")["seeds"]
    is_list = F.substring(block, 1, 1) == "["
    seeds = F.when(is_list, listed).otherwise(wrapped)
    kept = list(key) or df.columns
    return df.select(*kept, F.explode_outer(seeds).alias("_seed")).select(*kept, F.col("_seed.composition").alias(out))


def seed_columns(df: DataFrame) -> DataFrame:
    return from_map(df, "composition")


def load_seeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Accepted seeds of the first file that has any, else the built-in ones."""
    from ruptura.operators.penalties import validate_seeds

    for path in paths:
        accepted, _ = validate_seeds(seed_columns(read_seeds(spark, path)), ["seed_id"])
        if not accepted.isEmpty():
            return accepted
    return validate_seeds(rule_based_seeds(spark), ["seed_id"])[0]


def write_seeds(df: DataFrame, path: str, generated_by: str = "unknown") -> None:
    """Validated seeds as JSON lines next to a one-row table with their settings."""
    composition = F.create_map(*[x for e in FULL_ELEMENTS for x in (F.lit(e), F.col(e))])
    df.select(composition.alias("composition")).write.mode("overwrite").json(f"{path}/seeds")
    header = [(SEED_VERSION, generated_by, df.count(), DESIGN_ELEMENTS, FIXED_ELEMENTS, MAX_TOTAL_ALLOY)]
    schema = (
        "config_version string, generated_by string, seed_count long, design_variables array<string>, "
        "fixed_elements map<string,double>, max_total_alloy_wt double"
    )
    df.sparkSession.createDataFrame(header, schema).coalesce(1).write.mode("overwrite").json(f"{path}/config")

