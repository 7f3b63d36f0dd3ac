import hashlib

from pyspark.sql import functions as F

from ruptura.operators import split


def brute_cut(counts, seed, size):
    total = sum(counts.values())
    target, picked, seen = max(1, round(total * size)), set(), 0
    for key in sorted(counts, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), str(k))):
        if seen >= target:
            break
        picked.add(key)
        seen += counts[key]
    return picked


def test_group_holdout_matches_a_plain_loop_and_leaks_nothing(spark):
    counts = {k: (k % 7) + 1 for k in range(400)} | {999: 800}  # one hot group
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "g int")
    for seed in (1, 42, 59):
        want = brute_cut(counts, seed, 0.2)
        for limit in (200_000, 20):
            cut = split.group_holdout(df, "g", 0.2, seed, limit)
            test = {r[0] for r in cut.test(df).distinct().collect()}
            train = {r[0] for r in cut.train(df).distinct().collect()}
            assert test == want and not test & train and len(test | train) == len(counts)


def test_group_share_counts_groups(spark):
    df = spark.createDataFrame([(k,) for k in range(50) for _ in range(k + 1)], "g int")
    cut = split.group_share(df, "g", 0.2, 42)
    assert cut.test(df).distinct().count() == 10


def test_nested_split_sides_are_disjoint(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("g"))
    nested = split.nested_split(df, "g")
    sides = df.withColumn("side", nested.side()).distinct()
    assert sides.count() == 300
    assert {r[0] for r in sides.select("side").distinct().collect()} == {"train", "validation", "test"}


def test_group_key_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 2.0), (2.5, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(split.group_key(["a", "b"], 0)).collect()] == ["0.0-2.0", "2.0-2.0"]
