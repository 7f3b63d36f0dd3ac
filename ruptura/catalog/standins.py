"""Materials tables derived from the test tables, in one wording for Spark and SQL.

The test data has no alloys, so each role (test record, composition, candidate,
product, phase amounts) is an arithmetic view of a given table. The expressions
are plain SQL that both engines read, so a query and its check start from the
same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_ELEMENTS, FIXED_ELEMENTS, FULL_ELEMENTS, METALLURGY_LIMITS
from ruptura.runtime import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views of lineitem -------------------------------------------------------
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)
TEMP = "773.15e0 + 4e0 * l_quantity"
STRESS = "40e0 + l_extendedprice / 501.3e0"
LOG_LIFE = (
    f"1000e0 * (31e0 - 5e0 * log10({STRESS}) + 10e0 * (l_discount - 0.05e0)) / ({TEMP}) - 20e0"
)
CONDITIONS = {"temp": TEMP, "stress": STRESS, "log_lifetime": LOG_LIFE}
DESIGN = {
    "C": "0.07e0 + l_discount",
    "Si": "0.05e0 + 0.005e0 * l_quantity",
    "Mn": "0.3e0 + 4e0 * l_tax",
    "Cr": "8e0 + l_extendedprice / 25013e0",
    "Mo": "0.2e0 + 0.15e0 * l_linenumber",
    "W": "1e0 + 0.03e0 * l_quantity",
    "Ni": "5e0 * l_discount",
    "V": "0.18e0 + l_tax",
    "Nb": "0.04e0 + 0.005e0 * l_linenumber",
    "N": "0.03e0 + 0.3e0 * l_discount",
    "B": "0.001e0 + 0.0002e0 * l_quantity",
}
HEAT = {
    "Ntemp": "1273.15e0 + l_quantity",
    "Ntime": "0.5e0 * l_linenumber",
    "Ttemp": "973.15e0 + 2e0 * l_quantity",
    "Ttime": "20e0 * l_tax",
    "Atemp": "CASE WHEN l_linestatus = 'O' THEN 0e0 ELSE 923.15e0 END",
    "Atime": "10e0 * l_discount",
}


def exprs(*groups: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for g in groups for n, e in g.items()]


def lines(spark: SparkSession, sf_dir: str, *groups: dict[str, str], extra: list[str] = ()) -> DataFrame:
    """Lineitem rows with their key and the derived columns."""
    return table(spark, sf_dir, "lineitem").selectExpr(*KEY, *extra, *exprs(*groups))


def lines_sql(*groups: dict[str, str], extra: list[str] = ()) -> str:
    return f"SELECT {', '.join([*KEY, *extra, *exprs(*groups)])} FROM lineitem"


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, CONDITIONS)


TESTS_SQL = lines_sql(CONDITIONS)

# A composition as the operators complete it: design elements plus fixed ones.
FIXED = {e: f"{v}e0" for e, v in FIXED_ELEMENTS.items()}


def alloys(spark: SparkSession, sf_dir: str, *groups: dict[str, str], extra: list[str] = ()) -> DataFrame:
    return lines(spark, sf_dir, DESIGN, *groups, extra=extra)


def alloys_sql(*groups: dict[str, str], extra: list[str] = ()) -> str:
    return lines_sql(DESIGN, FIXED, *groups, extra=extra)


TOTAL_SQL = "(" + " + ".join(f'"{e}"' for e in FULL_ELEMENTS) + ")"
BALANCE_SQL = f"greatest(0e0, 100e0 - {TOTAL_SQL})"
INDEX_SQL = {
    "kn": '("Cr" + 6e0*"Si" + 4e0*"Mo" + 2e0*"Al" + 4e0*"Nb" + 1.5e0*"V" + 1.5e0*"W")'
          ' - (40e0*"C" + 30e0*"N" + 2e0*"Mn" + 4e0*"Ni" + 2e0*"Cu" + "Co")',
    "ms_temp": '561e0 - 474e0*"C" - 33e0*"Mn" - 17e0*"Cr" - 17e0*"Ni" - 21e0*"Mo"',
    "laves_risk": '"Mo" + 0.5e0*"W"',
    "z_phase_risk": '("V" + "Nb") / ("N" + 1e-6)',
    "ceq": '"C" + "Mn"/6e0 + ("Cr" + "Mo" + "V")/5e0 + ("Ni" + "Cu")/15e0',
    "mx_balance": '("V" + "Nb") / ("C" + "N" + 1e-6)',
    "total_alloy": TOTAL_SQL,
    "fe_balance": BALANCE_SQL,
}
PENALTY_OF = {
    "kn": "kn_penalty", "ms_temp": "ms_penalty", "laves_risk": "laves_penalty",
    "z_phase_risk": "z_phase_penalty", "ceq": "ceq_penalty", "mx_balance": "mx_penalty",
    "total_alloy": "total_alloy_penalty",
}


def excess_sql(value: str, limit: float, scale: float, norm: float, lower: bool = False) -> str:
    gap = f"{limit}e0 - {value}" if lower else f"{value} - {limit}e0"
    return f"{scale}e0 * pow(greatest(0e0, {gap}) / {norm}e0, 2)"


def metallurgy_ctes(source: str) -> str:
    """CTEs idx, pen and met over a select that yields full compositions."""
    idx = ", ".join(f"{e} AS {n}" for n, e in INDEX_SQL.items())
    pen = ", ".join(
        f"{excess_sql(k, limit, scale, norm, k == 'ms_temp')} AS {PENALTY_OF[k]}"
        for k, (limit, scale, norm) in METALLURGY_LIMITS.items()
    )
    total = " + ".join(PENALTY_OF.values())
    return (
        f"alloys AS ({source}), idx AS (SELECT *, {idx} FROM alloys), "
        f"pen AS (SELECT *, {pen} FROM idx), met AS (SELECT *, {total} AS metallurgy_penalty FROM pen)"
    )


COST_SQL_PRICES = {
    "C": 0.2, "Si": 2.0, "Mn": 2.5, "P": 0.2, "S": 0.2, "Cr": 4.0, "Mo": 35.0, "W": 45.0, "Ni": 25.0,
    "Cu": 10.0, "V": 40.0, "Nb": 60.0, "N": 1.0, "Al": 3.0, "B": 15.0, "Co": 60.0, "Ta": 200.0, "O": 0.0,
    "Re": 2500.0,
}
COST_SQL = f"({BALANCE_SQL} * 0.6e0 + " + " + ".join(f'"{e}" * {p}e0' for e, p in COST_SQL_PRICES.items()) + ") / 100e0"


def rnd(value, digits: int):
    """Rounding for comparison; plain double arithmetic, far cheaper than decimal rounding."""
    c = F.col(value) if isinstance(value, str) else value
    p = float(10 ** digits)
    return F.floor(c * p + 0.5) / p


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in columns})


def round_sql(columns: list[str], digits: int) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


DESIGN_LIST = list(DESIGN_ELEMENTS)
