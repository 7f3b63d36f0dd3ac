"""Hard negatives from candidate lists that the members of an anchor cluster share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import fit_sample, stored
from ruptura.llm.vector_blocks import (
    CHUNK, FIRST_SHARE, NOTHING, QUERY_ROWS, Block, Tops, candidate_blocks, integer_vectors, kth_scores, paired, products,
    query_blocks, searched, top_rows, widened,
)

#: Anchors that the cluster centres are fitted on, anchors aimed at for a cluster, most clusters, rounds of fitting.
FIT_ANCHORS, CLUSTER_ROWS, MOST_CLUSTERS, ROUNDS = 4096, 64, 256, 8
#: Slack of angles and bounds in floating point, far over their rounding error.
SLACK = 1e-6


def fit_centres(anchors: DataFrame, count: int) -> np.ndarray:
    """Directions of the cluster centres, by spherical k-means on a bounded sample of the anchors.

    The centres only shape the lists; results don't depend on them.
    """
    wanted = max(1, min(MOST_CLUSTERS, count // CLUSTER_ROWS))
    sample = fit_sample(anchors, F.col("vec_id"), FIT_ANCHORS).orderBy("vec_id").limit(2 * FIT_ANCHORS).select("ints").collect()
    width = max((len(r["ints"]) for r in sample), default=0) or 1
    x = np.zeros((max(1, len(sample)), width))
    for row, r in zip(x, sample):
        row[:len(r["ints"])] = r["ints"]
    x /= np.maximum(np.sqrt((x ** 2).sum(axis=1)), 1e-300)[:, None]
    centres = x[np.unique(np.linspace(0, len(x) - 1, wanted).astype(int))]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums ** 2).sum(axis=1))
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1.0)[:, None], centres)
    return centres


def _clustered(anchors: DataFrame, centres: np.ndarray) -> tuple[DataFrame, int]:
    """Anchors with their cluster and block ``key``, and the number of blocks; a large cluster has several."""
    @F.pandas_udf("int")
    def nearest(ints: pd.Series) -> pd.Series:
        return ints.map(lambda v: int((centres[:, :len(v)] @ v[:centres.shape[1]].astype(float)).argmax()))

    placed = anchors.withColumn("cluster", nearest("ints"))
    placed = stored(placed, "anchors")
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # one row for each centre
    offset, blocks = [], 0
    for c in range(len(centres)):
        parts = math.ceil(sizes.get(c, 0) / QUERY_ROWS)
        offset.append((blocks, max(1, parts)))
        blocks += parts
    at = lambda k: F.element_at(F.array(*[F.lit(o[k]) for o in offset]), F.col("cluster") + 1)
    return placed.withColumn("key", (at(0) + F.pmod(F.xxhash64("vec_id"), at(1))).cast("int")), max(1, blocks)


class _Walk:
    """One block's candidates, sorted once for a cluster by the highest score that a member of length 1 can get."""

    def __init__(self, members: Block, candidates: Block, centres: np.ndarray):
        width = max(members.ints.shape[1], candidates.ints.shape[1], centres.shape[1])
        centre = widened(centres[members.cluster][None, :], width)[0]
        angle = lambda units: np.arccos(np.clip(units @ centre, -1.0, 1.0))
        # A zero vector has no direction; its scores are 0, and so is its bound.
        spread = angle(members.units(width)[members.lengths > 0]).max(initial=0.0)
        bounds = candidates.lengths * np.cos(np.maximum(0.0, angle(candidates.units(width)) - spread - SLACK))
        self.order = np.argsort(-bounds, kind="stable")
        self.bounds = bounds[self.order]
        self.members, self.candidates = members, candidates

    def chunks(self, tops_needs):
        """Members that may still find something, and the next candidates; ends when none may."""
        active = np.arange(len(self.members.ids))
        for at in range(0, len(self.order), CHUNK):
            # No candidate from here on can score more; a member whose needs are higher has finished.
            most = self.members.lengths[active] * self.bounds[at]
            active = active[most + SLACK * (1 + np.abs(most)) >= tops_needs()[active]]
            if not len(active):
                return
            yield active, self.order[at:at + CHUNK]


def _search_positives(k: int, centres: np.ndarray):
    def search(members: Block, candidates: Block) -> tuple[np.ndarray, ...]:
        tops = Tops(members.needs[:, 0], k, candidates.ids)
        for rows, chunk in _Walk(members, candidates, centres).chunks(lambda: tops.needs):
            scores = products(members, rows, candidates, chunk)
            hit = (scores >= tops.needs[rows][:, None]) & (candidates.labels[chunk][None, :] == members.labels[rows][:, None])
            hit &= candidates.ids[chunk][None, :] != members.ids[rows][:, None]
            row, column = np.nonzero(hit)
            tops.add(rows[row], chunk[column], scores[row, column])
        return tops.found()

    return search


def _search_negatives(k: int, slots: int, centres: np.ndarray):
    """``needs`` of a member: the highest scores allowed, then the lowest, one for each positive."""

    def search(members: Block, candidates: Block) -> tuple[np.ndarray, ...]:
        most, least = members.needs[:, :slots], members.needs[:, slots:]
        tops = Tops(least.reshape(-1), k, candidates.ids)
        empty = most < least
        lowest = lambda: np.where(empty, np.iinfo(np.int64).max, tops.needs.reshape(-1, slots)).min(axis=1)
        for rows, chunk in _Walk(members, candidates, centres).chunks(lowest):
            scores = products(members, rows, candidates, chunk)
            other = candidates.labels[chunk][None, :] != members.labels[rows][:, None]
            for j in range(slots):
                low = tops.needs.reshape(-1, slots)[rows, j]
                row, column = np.nonzero(other & (scores <= most[rows, j][:, None]) & (scores >= low[:, None]))
                tops.add(rows[row] * slots + j, chunk[column], scores[row, column])
        return tops.found()

    return search


def _first_blocks() -> Column:
    return F.pmod(F.xxhash64("ids"), F.lit(FIRST_SHARE)) == 0


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, scale: int = 256,
    vector: str = "embedding", id_col: str = "vec_id",
) -> DataFrame:
    """For each anchor and positive, the best other-label rows within four fifths of the positive's score.

    Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    An anchor's positives are the ``positives`` best other rows of its label; a negative
    has another label and ``80 * positive_score <= 100 * negative_score <= 100 *
    positive_score``. Scores are integer inner products, ties go to the smaller id. A
    pair without such rows, so any with a positive score below 0, gives none. Which rows
    take part, repeated rows and repeated ids: ``integer_vectors``; ``label`` is an
    integer expression over the table's columns. Vectors of unequal width are filled with
    zeros. Without anchors the result is empty. Other columns are ignored.

    Anchors are clustered by direction. For each cluster a block of candidates is sorted
    once, by length times the cosine of what is left of its angle to the centre after the
    cluster's own spread. Every member walks that list until the bound falls below what
    it still needs. A share of the blocks is searched first, so that the others start
    with high needs. The same walk finds the positives and then the negatives.
    """
    vectors = stored(integer_vectors(rows, scale, vector, id_col, label), "vectors")
    anchors = vectors.where(is_anchor)
    count = anchors.count()
    centres = fit_centres(anchors, count)
    anchors, blocks = _clustered(anchors, centres)
    candidates = candidate_blocks(vectors)
    minus = F.lit(float("-inf"))

    def two_rounds(opening: DataFrame, search, k: int, slots: int, closing) -> DataFrame:
        """The first blocks, then the rest with the needs that ``closing`` makes of the scores found."""
        found = searched(paired(candidates.where(_first_blocks()), opening, blocks), search, slots)
        found = stored(top_rows(found, k, ["query_id", "slot"]).drop("rank"), "first-found")
        rest = searched(paired(candidates.where(~_first_blocks()), closing(kth_scores(found, k, ["query_id", "slot"])), blocks), search, slots)
        return top_rows(found.unionByName(rest), k, ["query_id", "slot"])

    def closing_positives(kth: DataFrame) -> DataFrame:
        known = anchors.join(kth.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left")
        reach = F.when(F.col("length") > 0, F.col("kth") / F.col("length"))
        return query_blocks(known, blocks, F.array(F.coalesce("kth", F.lit(NOTHING).cast("long"))), F.coalesce(reach, minus))

    opening = query_blocks(anchors, blocks, F.array(F.lit(NOTHING).cast("long")), minus)
    found = two_rounds(opening, _search_positives(positives, centres), positives, 1, closing_positives)
    good = stored(found.select("query_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Allowed scores of each positive; a place without one, or with a score below 0, is an empty range.
    of_slot = lambda value, other: F.array(*[F.coalesce(F.max(F.when(F.col("slot") == j, value)), F.lit(other).cast("long")) for j in range(positives)])
    score = F.col("positive_score")
    least = F.when(score >= 0, score - F.expr("positive_score div 5"))
    ranges = good.groupBy(F.col("query_id").alias("vec_id")).agg(
        of_slot(F.when(score >= 0, score), -1).alias("most"), of_slot(least, 0).alias("least"),
    )
    asked = stored(anchors.join(ranges, "vec_id"), "ranges")

    def negative_blocks(df: DataFrame) -> DataFrame:
        """No candidate below the smallest of the lowest scores of open ranges matters."""
        open_ = F.transform(F.filter(F.arrays_zip("most", "least"), lambda r: r["least"] <= r["most"]), lambda r: r["least"])
        reach = F.when(F.size(open_) == 0, F.lit(float("inf"))).when(F.col("length") > 0, F.array_min(open_) / F.col("length"))
        return query_blocks(df, blocks, F.concat("most", "least"), F.coalesce(reach, minus))

    def closing_negatives(kth: DataFrame) -> DataFrame:
        raised = kth.groupBy(F.col("query_id").alias("vec_id")).agg(of_slot(F.col("kth"), NOTHING).alias("kths"))
        known = asked.join(raised, "vec_id", "left")
        higher = F.when(F.col("kths").isNull(), F.col("least")).otherwise(F.zip_with("least", "kths", lambda a, b: F.greatest(a, b)))
        return negative_blocks(known.withColumn("least", higher))

    bad = two_rounds(negative_blocks(asked), _search_negatives(negatives, positives, centres), negatives, positives, closing_negatives)
    return bad.join(good, ["query_id", "slot"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


#: The same rows in SQL.
HARD_NEGATIVES_SQL = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM held a JOIN held c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
