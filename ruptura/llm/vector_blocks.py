"""Integer vectors in bounded blocks, query blocks against candidate blocks, exact top lists.

A candidate block and a query block are one row each, so a task holds a bounded pair at
a time. Every query carries ``needs``: scores that a candidate must reach to matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruptura.llm.common import stored

#: Rows and bytes of a block; rows of a query block; candidates scored at a time.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
QUERY_ROWS = 1024
CHUNK = 512
#: A block ends where the length falls below this share of its longest, once it has so many rows.
LENGTH_STEP, LEAST_ROWS = 0.9, 256
#: Query blocks are broadcast up to this many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Share of the blocks searched first, for scores that the rest must reach.
FIRST_SHARE = 16
#: No score is smaller.
NOTHING = -(1 << 63)
#: The inner product of two vectors bounded by LARGEST / sqrt(width) fits a long.
LARGEST = 3.0e9


def integer_vectors(rows: DataFrame, scale: int, vector: str = "embedding", id_col: str = "vec_id", label: Column | None = None) -> DataFrame:
    """Rows ``vec_id, label, length, ints``: each component is ``floor(scale * x)``.

    Rows without id or vector, with a null or non-finite component, or (where a label is
    given) without label take no part. An empty vector is all zeros. Components beyond
    3e9 / sqrt(width) are held at that bound, so that scores fit a long. A row that
    comes twice counts once; of different rows under one id that with the smallest
    integers (then label) stands for the id.
    """
    x = F.col(vector).cast("array<double>")
    bound = F.lit(LARGEST) / F.sqrt(F.greatest(F.size(x), F.lit(1)))
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)))
    ints = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, bound), -bound)))
    named = F.lit(0).cast("long") if label is None else label.cast("long")
    out = rows.where(F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), named.alias("label"), ints.alias("ints"))
    out = _one_row_per_id(out.where("label is not null"))
    squares = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return out.select("vec_id", "label", F.sqrt(squares).alias("length"), "ints")


def _one_row_per_id(rows: DataFrame) -> DataFrame:
    again = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("ints", "label")).alias("row"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "row.label", "row.ints"))


SCHEMA = pa.schema([
    ("key", pa.int32()), ("cluster", pa.int32()), ("rows", pa.int32()), ("longest", pa.float64()), ("reach", pa.float64()),
    ("ids", pa.binary()), ("labels", pa.binary()), ("needs", pa.binary()), ("ints", pa.binary()),
])
DDL = "key int, cluster int, rows int, longest double, reach double, ids binary, labels binary, needs binary, ints binary"


class Block:
    """Arrays of a packed row: ids, labels, needs, ints (padded with zeros) and lengths."""

    def __init__(self, row: dict):
        n = row["rows"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.labels = np.frombuffer(row["labels"], dtype=np.int64)
        self.needs = np.frombuffer(row["needs"], dtype=np.int64).reshape(n, -1)
        self.ints = np.frombuffer(row["ints"], dtype=np.int64).reshape(n, -1).astype(np.float64)
        self.exact = np.frombuffer(row["ints"], dtype=np.int64).reshape(n, -1)
        self.lengths = np.sqrt((self.ints ** 2).sum(axis=1))
        self.cluster = row["cluster"]
        self.most = float(np.abs(self.ints).max(initial=0.0))

    def units(self, width: int) -> np.ndarray:
        """Directions, in ``width`` dimensions; zero vectors stay zero."""
        return widened(self.ints / np.where(self.lengths > 0, self.lengths, 1.0)[:, None], width)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1]))))


def products(a: Block, rows: np.ndarray, b: Block, columns: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; components that one side lacks count as zero."""
    width = min(a.ints.shape[1], b.ints.shape[1])
    if width * a.most * b.most < 2.0 ** 53:
        return (a.ints[rows, :width] @ b.ints[columns, :width].T).astype(np.int64)
    return a.exact[rows, :width] @ b.exact[columns, :width].T


def _pack(by_length: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Consecutive rows as blocks; a block has one key."""

    def block(rows: pa.RecordBatch, ints: np.ndarray, needs: np.ndarray) -> dict:
        lengths = rows.column("length").to_numpy()
        return {
            "key": rows.column("key")[0].as_py(), "cluster": rows.column("cluster")[0].as_py(), "rows": rows.num_rows,
            "longest": float(lengths.max()), "reach": float(rows.column("reach").to_numpy().min()),
            "ids": rows.column("vec_id").to_numpy().tobytes(), "labels": rows.column("label").to_numpy().tobytes(),
            "needs": needs.tobytes(), "ints": ints.tobytes(),
        }

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            widths = batch.column("ints").value_lengths().to_numpy()
            width = max(1, int(widths.max()))
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
            key, lengths = batch.column("key").to_numpy(), batch.column("length").to_numpy()
            at = 0
            while at < n:
                stop = min(n, at + most)
                stop = at + int(np.searchsorted(key[at:stop], key[at], side="right"))
                if by_length:  # longest first
                    stop = min(stop, max(at + LEAST_ROWS, at + int((lengths[at:stop] >= LENGTH_STEP * lengths[at]).sum())))
                part = batch.slice(at, stop - at)
                own = widths[at:stop]
                ints = np.zeros((len(own), max(1, int(own.max()))), dtype=np.int64)
                ints[np.arange(ints.shape[1]) < own[:, None]] = part.column("ints").flatten().to_numpy()
                needs = part.column("needs").flatten().to_numpy()
                yield pa.RecordBatch.from_pylist([block(part, ints, needs)], schema=SCHEMA)
                at = stop

    return apply


def candidate_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors of similar length, written once; the longest of a partition first.

    Ranges of length and id deal the rows evenly, also where most have one length.
    """
    rows = vectors.select(
        F.lit(0).alias("key"), F.lit(0).alias("cluster"), "vec_id", "label", "length", F.lit(0.0).alias("reach"),
        F.array(F.lit(0).cast("long")).alias("needs"), "ints",
    )
    order = [F.desc("length"), F.asc("vec_id")]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(True), DDL), "vector-blocks")


def query_blocks(queries: DataFrame, blocks: int, needs: Column, reach: Column) -> DataFrame:
    """Blocks of the queries by their ``key`` (0 to blocks - 1), written once.

    ``needs`` holds longs, the same number for each query; no candidate that is
    shorter than ``reach`` can satisfy one of them.
    """
    rows = queries.select("key", "cluster", "vec_id", "label", "length", reach.alias("reach"), needs.alias("needs"), "ints")
    dealt = rows.repartition(blocks, "key").sortWithinPartitions("key", "vec_id")
    return stored(dealt.mapInArrow(_pack(False), DDL), "query-blocks")


def paired(candidates: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Each query block with each candidate block that is long enough for it: columns ``c`` and ``q``.

    Query blocks are broadcast if their measured bytes are few. Otherwise the pairs are
    dealt by key and salt: each query block is copied for every salt.
    """
    of = lambda df, name: df.select(*[c for c in ("key", "salt", "longest", "reach") if c in df.columns], F.struct(*SCHEMA.names).alias(name))
    size = queries.agg(F.sum(F.octet_length("ints") + F.octet_length("needs"))).first()[0] or 0
    spread = of(candidates, "c").withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = of(queries, "q").drop("longest").withColumnRenamed("reach", "least")
    on = ["key"]
    if size <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    else:
        salts = math.ceil(2 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")) / blocks)
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("c.ids"), F.lit(salts)).cast("int"))
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("salt")
    return spread.join(asked, on).where(F.col("longest") * (1 + 1e-9) >= F.col("least")).select("c", "q")


#: Scores a pair of blocks: yields (slot, candidate position, score) arrays by the top list's rules.
Search = Callable[[Block, Block], tuple[np.ndarray, np.ndarray, np.ndarray]]


def searched(pairs: DataFrame, search: Search, slots: int = 1) -> DataFrame:
    """Rows ``query_id, slot, vec_id, score`` of what a search finds in each pair of blocks."""
    schema = pa.schema([("query_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, q in zip(batch.column("c"), batch.column("q")):
                candidates, queries = Block(c.as_py()), Block(q.as_py())
                slot, at, score = search(queries, candidates)
                if len(slot):
                    columns = [queries.ids[slot // slots], (slot % slots).astype(np.int32), candidates.ids[at], score]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return pairs.mapInArrow(apply, "query_id long, slot int, vec_id long, score long")


class Tops:
    """The k best (score, then smaller id) of each slot so far, and the score a newcomer must reach."""

    def __init__(self, needs: np.ndarray, k: int, ids: np.ndarray):
        self.needs, self.k, self.ids = needs.copy(), k, ids
        self.slot, self.at, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, at, score = (np.concatenate(x) for x in ((self.slot, slot), (self.at, at), (self.score, score)))
        order = np.lexsort((self.ids[at], -score, slot))
        slot, at, score = slot[order], at[order], score[order]
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        last = place == self.k - 1
        self.needs[slot[last]] = np.maximum(self.needs[slot[last]], score[last])
        keep = place < self.k
        self.slot, self.at, self.score = slot[keep], at[keep], score[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.slot, self.at, self.score


def first_blocks(candidates: DataFrame) -> Column:
    """Marks about one block in FIRST_SHARE, the longest first; any choice gives the same result."""
    cut = candidates.agg(F.percentile_approx("longest", 1 - 1 / FIRST_SHARE, 1000)).first()[0]
    drawn = F.pmod(F.xxhash64("ids"), F.lit(FIRST_SHARE)) == 0
    return (F.col("longest") > F.lit(cut)) | ((F.col("longest") == F.lit(cut)) & drawn)


def kth_scores(tops: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The last score of each top list that has k rows: ``by, kth``."""
    return tops.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")


def top_rows(found: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The k best rows, higher scores first, then smaller ids, with their ``rank``; lists are cut before they meet."""
    best = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
