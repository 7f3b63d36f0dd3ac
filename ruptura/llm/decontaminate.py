"""Benchmark items inside documents: size-partitioned MinHash containment search, exactly verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed

SIZE = 5
PERCENT = 80
#: A table is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 500_000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int, make) -> Column:
    """``make`` of each shingle's words; fewer words than ``size`` are one shingle, no words none."""
    heads = F.slice(words, 1, F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - size + 1, F.lit(1))))
    return F.transform(heads, lambda w, k: make(F.slice(words, k + 1, size)))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Marked for broadcast if it has been counted to be small; otherwise the planner shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
    size: int = SIZE, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs of a document and an item of which it holds ``percent`` of the distinct shingles or more.

    Returns ``doc_id, item_id, n_shared, n_shingles``, one row per pair. Texts are
    compared as lower-cased words of letters and digits.

    Items are parted by size: those with up to u distinct shingles (u a power of two)
    are sketched by their ``u * (1 - percent) + 1`` smallest shingle hashes. A document
    that holds ``percent`` of an item lacks fewer of its shingles than the sketch has,
    so it holds one of the sketch: the search misses nothing, however long the
    document, and looks up only about a fifth of an item's shingles. Candidates are
    then verified by exact shingle sets.

    A text shorter than ``size`` words is one shingle of all its words; texts without
    words hold and match nothing. Rows that share an id are one document or item;
    rows without id give nothing. Empty tables give no rows; other columns are ignored.
    """
    words = items.select(F.col(item_id).alias("item"), normal_words(F.col(text_col)).alias("words"))
    of_items = (
        words.where("item is not null").select("item", F.explode(_shingles(F.col("words"), size, _text)).alias("shingle"))
        .distinct()
    )
    partition = F.expr("cast(pow(2, ceil(log2(size(hashes)))) as int)")
    sketch_size = F.floor(partition * (100 - percent) / 100).cast("int") + 1
    sketches = checkpointed(
        of_items.groupBy("item").agg(F.sort_array(F.collect_list(F.xxhash64(F.split("shingle", " ")))).alias("hashes"))
        .select("item", F.explode(F.slice("hashes", 1, sketch_size)).alias("hash"))
    )
    of_docs = docs.select(F.col(doc_id).alias("doc"), normal_words(F.col(text_col)).alias("words")).where("doc is not null")
    hashes = of_docs.select("doc", F.explode(_shingles(F.col("words"), size, F.xxhash64)).alias("hash"))
    candidates = checkpointed(
        hashes.join(_small(sketches, broadcast_rows), "hash").select("doc", "item").distinct()
    )
    wanted = _small(candidates.select("doc").distinct(), broadcast_rows)
    totals = of_items.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    sought = checkpointed(of_items.join(totals, "item"))
    shared = (
        of_docs.join(wanted, "doc", "left_semi")
        .select("doc", F.explode(F.array_distinct(_shingles(F.col("words"), size, _text))).alias("shingle"))
        .join(_small(sought, broadcast_rows), "shingle")
        .select("doc", "item", "n_shingles", "shingle").distinct()
        .groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_shingles").alias("n_shingles"))
        .where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    )
    return shared.join(candidates, ["doc", "item"], "left_semi").select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shared", "n_shingles"
    )


CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) * 100 >= any_value(n_shingles) * 80
"""
