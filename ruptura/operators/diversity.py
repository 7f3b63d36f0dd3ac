"""Greedy diversity filter: keep rows in order while they are far from all kept ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruptura.constants import DESIGN_ELEMENTS, MAX_ATTEMPT_FACTOR, MIN_DISTANCE, POPULATION_SIZE
from ruptura.operators.composition import random_candidates
from ruptura.runtime import checkpointed

BLOCK = 4096
CHUNK = 2048


def _near(points: np.ndarray, kept: np.ndarray, min_distance: float) -> np.ndarray:
    out = np.zeros(len(points), dtype=bool)
    for start in range(0, len(points), CHUNK):
        part = points[start:start + CHUNK]
        gaps = np.sqrt(((part[:, None, :] - kept[None, :, :]) ** 2).sum(axis=2))
        out[start:start + CHUNK] = (gaps < min_distance).any(axis=1)
    return out


def diverse(
    df: DataFrame, order: Sequence[str], features: Sequence[str] = tuple(DESIGN_ELEMENTS),
    min_distance: float = MIN_DISTANCE, limit: int = POPULATION_SIZE, block: int = BLOCK,
) -> DataFrame:
    """First ``limit`` rows, in ``order``, that stay ``min_distance`` apart (Euclidean).

    Exactly the result of scanning the rows one by one. The next ``block``
    undecided rows are settled together, then every task drops the rows near
    the newly kept ones, so crowded regions vanish in parallel. ``order`` must
    be unique. Rows that are copies in all features cannot both be kept, so
    only the first takes part.
    """
    features, order = list(features), list(order)
    axes = [f"_x{i}" for i in range(len(features))]
    points = df.select(*order, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(a) for f, a in zip(features, axes)])
    first = W.partitionBy(*axes).orderBy(*order)
    rest = points.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")
    rest = checkpointed(rest)
    schema, kept_rows, n_kept = rest.schema, [], 0
    while n_kept < limit:
        head = rest.orderBy(*order).limit(block).collect()
        if not head:
            break
        vectors = np.array([[r[a] for a in axes] for r in head])
        fresh: list[int] = []
        for i in range(len(head)):
            if n_kept + len(fresh) >= limit:
                break
            if not fresh or not _near(vectors[i:i + 1], vectors[fresh], min_distance)[0]:
                fresh.append(i)
        kept_rows += [tuple(head[i][c] for c in order) for i in fresh]
        n_kept += len(fresh)
        if len(head) < block:
            break
        kept = vectors[fresh]
        last = F.struct(*[F.lit(head[-1][c]).cast(schema[c].dataType).alias(c) for c in order])

        def drop_near(batches: Iterator[pd.DataFrame], kept: np.ndarray = kept) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[~_near(pdf[axes].to_numpy(dtype=float), kept, min_distance)]

        rest = checkpointed(rest.filter(F.struct(*order) > last).mapInPandas(drop_near, schema))
    keys = df.sparkSession.createDataFrame(kept_rows, df.select(*order).schema)
    # At most `limit` keys, the size of the population asked for.
    return df.join(F.broadcast(keys), order, "left_semi")


def initial_population(
    seeds: DataFrame, size: int = POPULATION_SIZE, min_distance: float = MIN_DISTANCE,
    seed: int = 42, attempts: int = MAX_ATTEMPT_FACTOR,
) -> DataFrame:
    """Seeds first, then random rows, all ``min_distance`` apart.

    ``seeds`` has ``candidate_id`` and repaired design vectors. At most
    ``attempts * size`` random rows are tried; too few survivors are an error.
    """
    spark = seeds.sparkSession
    columns = ["_source", "candidate_id", *DESIGN_ELEMENTS]
    drawn = random_candidates(spark, attempts * size, seed).withColumn("_source", F.lit(1))
    both = seeds.withColumn("_source", F.lit(0)).select(*columns).unionByName(drawn.select(*columns))
    population = diverse(both, ["_source", "candidate_id"], min_distance=min_distance, limit=size)
    found = population.count()
    if found < size:
        raise RuntimeError(f"only {found} of {size} candidates are far enough apart")
    return population.withColumn("is_seed", F.col("_source") == 0).drop("_source")
