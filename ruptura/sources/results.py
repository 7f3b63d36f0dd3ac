"""Stored results: value cleaning, envelopes and metric logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ruptura.constants import EMPTY_TEXT, METRIC_PATTERNS
from ruptura.functions.numeric import to_double

# --- fixed values: Python literals as found in stored tables, and their JSON form
LITERALS = {"None": "null", "nan": "null", "True": "true", "False": "false"}


def blank_to_null(name: str) -> Column:
    text = F.trim(F.col(f"`{name}`"))
    return F.when(F.lower(text).isin(EMPTY_TEXT), None).otherwise(text)


def literal_to_json(value: Column) -> Column:
    """Python-style literals inside lists and maps to their JSON form."""
    for literal, replacement in LITERALS.items():
        value = F.regexp_replace(value, rf"(?<=[\[\{{:,]\s{{0,4}}){literal}(?=\s*[,\]\}}])", replacement)
    return value


def clean_results(df: DataFrame, nested: dict[str, str] | None = None) -> DataFrame:
    """Result table as read from text: blanks to NULL, numbers to double, lists and maps parsed.

    ``nested`` gives the type of the columns that hold lists or maps. A text
    column becomes numeric when all its values are numbers. Columns without a
    name (which a reader without header calls ``_c0``, ``_c1`` and so on) and index
    columns are dropped.
    """
    nested = nested or {}
    names = [c for c in df.columns if c.strip() and not c.strip().startswith("Unnamed:") and not re.fullmatch(r"_c\d+", c)]
    texts = [f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, StringType)]
    plain = [c for c in texts if c.strip() not in nested]
    bad = {}
    if plain:
        row = df.agg(*[
            F.count_if(blank_to_null(c).isNotNull() & to_double(blank_to_null(c)).isNull()).alias(str(i))
            for i, c in enumerate(plain)
        ]).first()
        bad = {c: row[str(i)] for i, c in enumerate(plain)}
    cells = []
    for c in names:
        clean = c.strip()
        if c not in texts:
            cells.append(F.col(f"`{c}`").alias(clean))
        elif clean in nested:
            cells.append(F.from_json(literal_to_json(blank_to_null(c)), nested[clean]).alias(clean))
        elif bad[c] == 0:
            cells.append(to_double(blank_to_null(c)).alias(clean))
        else:
            cells.append(blank_to_null(c).alias(clean))
    return df.select(*cells)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def unwrap_payload(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows and meta columns of a stored result, whatever its envelope.

    Known forms: bare rows, ``{"best": row, ...}`` and ``{"candidates" | "rows": [...], ...}``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(types.get("best"), StructType):
        rest = [c for c in df.columns if c != "best"]
        return df.filter("best is not null").select("best.*"), df.select(*rest) if rest else None
    lists = [c for c in ("candidates", "rows") if isinstance(types.get(c), ArrayType)]
    if lists:
        picked = F.col(lists[-1])
        if len(lists) == 2 and types["candidates"] == types["rows"]:
            picked = F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(F.col("rows"))
        elif len(lists) == 2:
            picked = F.col("candidates")
        rest = [c for c in df.columns if c not in ("candidates", "rows")]
        count = F.coalesce(F.size(picked), F.lit(0))
        meta = df.select(*rest) if "count" in rest else df.select(*rest, count.alias("count"))
        return df.select(F.explode(picked).alias("r")).select("r.*"), meta
    return df, None


def parse_metrics(df: DataFrame, text: str, key: list[str] = ()) -> DataFrame:
    """The named metrics found in log texts, long form; absent ones are left out."""
    found = {m: F.regexp_extract(F.col(text), p, 1).try_cast("double") for m, p in METRIC_PATTERNS.items()}
    wide = df.select(*key, *[v.alias(m) for m, v in found.items()])
    return wide.unpivot(list(key), list(found), "metric", "value").filter(F.col("value").isNotNull())


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    logs = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return parse_metrics(logs, "value", ["file"])
