"""Exact top-k inner products over buckets of similar length."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import stored
from ruptura.llm.vector_blocks import (
    CHUNK, NOTHING, QUERY_ROWS, Block, Tops, candidate_blocks, first_blocks, integer_vectors, kth_scores, paired,
    products, query_blocks, searched, top_rows,
)

#: Buckets whose median local cosine threshold is at least this prune by coordinates, others by length.
COORDINATE_COSINE = 0.75
#: Coordinates looked at for each query: its largest ones.
FOCUS = 3
#: Slack of bounds in floating point, far over their rounding error.
SLACK = 1e-7


def _by_length(queries: Block, bucket: Block, tops: Tops, active: np.ndarray) -> None:
    """The bucket from its longest vector on; a query stops where no vector is long enough."""
    order = np.argsort(-bucket.lengths, kind="stable")
    for at in range(0, len(order), CHUNK):
        chunk = order[at:at + CHUNK]
        most = queries.lengths[active] * bucket.lengths[chunk[0]] * (1 + SLACK)
        active = active[most >= tops.needs[active]]
        if not len(active):
            return
        scores = products(queries, active, bucket, chunk)
        hit = (scores >= tops.needs[active][:, None]) & (bucket.ids[chunk][None, :] != queries.ids[active][:, None])
        row, column = np.nonzero(hit)
        tops.add(active[row], chunk[column], scores[row, column])


def _by_coordinates(queries: Block, bucket: Block, tops: Tops, active: np.ndarray, cosine: np.ndarray) -> None:
    """Directions whose largest query coordinates lie in the range that the local cosine allows."""
    width = max(queries.ints.shape[1], bucket.ints.shape[1])
    asked, held = queries.units(width)[active], bucket.units(width)
    focus = np.argsort(-np.abs(asked), axis=1, kind="stable")[:, :FOCUS]
    spread = np.arccos(np.clip(cosine - SLACK, -1.0, 1.0))
    for at in range(0, len(held), CHUNK):
        chunk = np.arange(at, min(at + CHUNK, len(held)))
        fits = bucket.ids[chunk][None, :] != queries.ids[active][:, None]
        for f in range(focus.shape[1]):
            angle = np.arccos(np.clip(asked[np.arange(len(active)), focus[:, f]], -1.0, 1.0))
            low = np.cos(np.minimum(np.pi, angle + spread)) - SLACK
            high = np.cos(np.maximum(0.0, angle - spread)) + SLACK
            values = held[chunk][:, focus[:, f]].T
            fits &= (values >= low[:, None]) & (values <= high[:, None])
        some, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
        if not len(some):
            continue
        rows, chunk = active[some], chunk[columns]
        scores = products(queries, rows, bucket, chunk)
        row, column = np.nonzero((scores >= tops.needs[rows][:, None]) & fits[np.ix_(some, columns)])
        tops.add(rows[row], chunk[column], scores[row, column])


def _search(k: int):
    def search(queries: Block, bucket: Block) -> tuple[np.ndarray, ...]:
        tops = Tops(queries.needs[:, 0], k, bucket.ids)
        longest = bucket.lengths.max()
        reach = queries.lengths * longest
        active = np.flatnonzero(reach * (1 + SLACK) >= tops.needs)
        if not len(active):
            return tops.found()
        # What the cosine must be, if the candidate is as long as the longest; anything will do for a need of 0 or less.
        cosine = np.where((reach > 0) & (tops.needs > 0), tops.needs / np.where(reach > 0, reach, 1.0), -1.0)[active]
        if np.median(cosine) >= COORDINATE_COSINE:
            _by_coordinates(queries, bucket, tops, active, cosine)
        else:
            _by_length(queries, bucket, tops, active)
        return tops.found()

    return search


def top_products(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k largest integer inner products of every query row with all other rows.

    Rows ``query_id, rank, vec_id, score``; fewer than k where there are fewer rows;
    ties go to the smaller id. ``is_query`` is a condition on ``vec_id``. Which rows
    take part, repeated rows and repeated ids: ``integer_vectors``. Vectors of unequal
    width are filled with zeros. Zero vectors score 0. Without queries or other rows
    the result is empty. Other columns are ignored.

    Candidates lie in buckets of similar length. The longest buckets are searched first;
    the k-th score found there is what the rest must reach. A bucket that is too short
    for a query block never meets it, and a bucket's local cosine thresholds choose how
    it is pruned; what is left is verified by its product.
    """
    vectors = integer_vectors(rows, scale, vector, id_col)
    queries = vectors.where(is_query)
    asked = queries.count()
    blocks = max(1, math.ceil(asked / QUERY_ROWS))
    queries = queries.withColumns({"key": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "cluster": F.lit(0)})
    candidates = candidate_blocks(vectors)
    first = first_blocks(candidates)

    nothing = F.array(F.lit(NOTHING).cast("long"))
    opening = query_blocks(queries, blocks, nothing, F.lit(float("-inf")))
    found = searched(paired(candidates.where(first), opening, blocks), _search(k))
    found = stored(top_rows(found, k, ["query_id"]).drop("rank"), "first-products")
    kth = kth_scores(found, k, ["query_id"]).withColumnRenamed("query_id", "vec_id")
    known = queries.join(kth, "vec_id", "left")
    need = F.coalesce("kth", F.lit(NOTHING).cast("long"))
    reach = F.when(F.col("length") > 0, F.col("kth") / F.col("length"))
    closing = query_blocks(known, blocks, F.array(need), F.coalesce(reach, F.lit(float("-inf"))))
    rest = searched(paired(candidates.where(~first), closing, blocks), _search(k))
    return top_rows(found.unionByName(rest), k, ["query_id"]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same rows in SQL.
TOP_PRODUCTS_SQL = """
WITH held AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM held q JOIN held c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
