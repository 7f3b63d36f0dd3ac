"""Reading tables by file type and falling back along a list of sources."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ruptura.constants import COOLING_COLS

# --- fixed values: column order of the raw test tables ---------------------
CREEP_TEST_COLUMNS = [
    "lifetime", "stress", "temp",
    "C", "Si", "Mn", "P", "S", "Cr", "Mo", "W", "Ni", "Cu", "V", "Nb", "N", "Al", "B", "Co", "Ta", "O",
    "Ntemp", "Ntime", "Cooling1", "Ttemp", "Ttime", "Cooling2", "Atemp", "Atime", "Cooling3", "Rh",
]
SUPERALLOY_COLUMNS = [
    "grade", "Ni", "Cr", "Co", "Fe", "Al", "Ti", "Nb", "Mo", "W", "C", "B", "Zr", "temp", "stress",
    "solution_temp", "solution_time", "dissolution_temp", "stable_aging_temp", "stable_aging_time",
    "aging_temp", "aging_time", "lifetime", "evaluation", "note",
]
SUPERALLOY_CELSIUS = ["temp", "solution_temp", "dissolution_temp", "stable_aging_temp", "aging_temp"]


def creep_test_schema() -> StructType:
    return StructType([
        StructField(c, IntegerType() if c in COOLING_COLS else DoubleType()) for c in CREEP_TEST_COLUMNS
    ])


def superalloy_schema() -> StructType:
    """The header of this table holds odd spaces, so its columns are named by position."""
    text = {"grade", "note"}
    return StructType([StructField(c, StringType() if c in text else DoubleType()) for c in SUPERALLOY_COLUMNS])


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by suffix; anything else is an error.

    A schema is wanted for large CSV input, because guessing types reads it twice.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("enforceSchema", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported file type: {path}")


def read_superalloys(spark: SparkSession, path: str) -> DataFrame:
    """Superalloy tests; the stray last column is dropped, temperatures stay in Celsius."""
    return read_table(spark, path, superalloy_schema()).drop("note")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


#: Spark's error conditions for files that are not of the expected format.
UNPARSABLE = ("FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER", "MALFORMED", "UNABLE_TO_INFER_SCHEMA")


def first_available(
    spark: SparkSession, paths: Sequence[str], read: Callable[[SparkSession, str], DataFrame] = read_table,
    tag: str | None = "source_file",
) -> DataFrame | None:
    """The first source that exists, can be parsed and has rows, tagged with its file name.

    A source that is empty or no table at all gives way to the next one, with a
    warning. Other failures, such as a refused access, are raised.
    """
    for path in paths:
        if not path_exists(spark, path):
            continue
        try:
            df = read(spark, path)
            if df.isEmpty():
                warnings.warn(f"{path}: no rows", stacklevel=2)
                continue
        except (PySparkException, Py4JJavaError) as error:
            told = [c for c in UNPARSABLE if f"[{c}" in str(error)]
            if not told:
                raise
            warnings.warn(f"{path}: {told[0]}", stacklevel=2)
            continue
        return df.withColumn(tag, F.lit(path.rstrip("/").split("/")[-1])) if tag else df
    return None
