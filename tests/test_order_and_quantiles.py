import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ruptura.operators import order, ranks
from ruptura.operators.quantiles import exact_quantiles, quantile


def skewed(spark, n=5000):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    v = np.where(np.arange(n) % 3 == 0, 7.0, np.round(rng.normal(0, 10, n), 2))
    return pd.DataFrame({"id": np.arange(n), "v": v, "w": rng.normal(0, 1, n) + v})


def test_quantiles_match_numpy_also_when_brackets_are_tiny(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf)
    probabilities = [0.0, 0.05, 0.3, 0.5, 0.95, 1.0]
    for limit in (200_000, 5):
        got = exact_quantiles(df, ["v", "w"], probabilities, limit)
        for c in ("v", "w"):
            assert np.allclose(got[c], np.quantile(pdf[c], probabilities), rtol=1e-13)


def test_quantiles_of_few_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert quantile(df, "x", 0.25) == 1.75
    assert quantile(df.filter("x is null"), "x", 0.5) is None


def test_running_totals_over_many_buckets(spark):
    pdf = skewed(spark)
    got = order.running_totals(spark.createDataFrame(pdf), "v", {"n": "1"}, bucket_rows=50).toPandas()
    want = pdf.groupby("v").size().sort_index().cumsum()
    got = got.set_index("v").sort_index()
    assert (got["cum_n"] == want).all()


def test_average_rank_and_spearman_match_pandas(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf)
    ranks = order.average_ranks(df, "v").toPandas().set_index("v")["rank"]
    assert np.allclose(pdf["v"].map(ranks), pdf["v"].rank(method="average"))
    want = np.corrcoef(pdf["v"].rank(), pdf["w"].rank())[0, 1]
    assert abs(order.spearman(df, "v", "w").first()[0] - want) < 1e-12
    assert order.spearman(df.withColumn("c", F.lit(1.0)), "v", "c").first()[0] is None


def test_dense_index_is_dense_and_ordered_with_copies(spark):
    rows = [(i % 5,) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int").repartition(7)
    got = order.dense_index(df, ["k"], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1000))
    assert [r["k"] for r in got] == sorted(r[0] for r in rows)


def test_distance_percentile(spark):
    train = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 4.0)], "d double")
    cand = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 2.0), (4, 9.0)], "id int, d double")
    got = {r["id"]: r["p"] for r in ranks.distance_percentile(cand, train, "d", "p").collect()}
    assert got == {1: 0.0, 2: 75.0, 3: 75.0, 4: 100.0}
    none = ranks.distance_percentile(cand, train.filter("d < 0"), "d", "p")
    assert none.filter("p is not null").count() == 0


def test_quantile_brackets_that_miss(spark):
    from ruptura.operators.quantiles import _Bracket, _read

    values = spark.range(100).select(F.col("id").cast("double").alias("v0"))
    missed = _read(values, [_Bracket("v0", 100, 10.5, 50.0, 60.0, 10), _Bracket("v0", 100, 80.5, 50.0, 60.0, 10)])
    assert [(b.lo, b.hi) for b in missed] == [(-math.inf, 60.0), (50.0, math.inf)]
    assert not _read(values, missed) and [b.value for b in missed] == [10.5, 80.5]
