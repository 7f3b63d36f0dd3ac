"""SimHash near-duplicate groups with pigeonring candidate search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed, stored
from ruptura.llm.components import components

BITS = 64
#: Widths of the five ring segments, lowest bits first.
SEGMENTS = (13, 13, 13, 13, 12)
DISTANCE = 2
#: Buckets with more fingerprints than this are linked through shared neighbours instead of pairs.
PAIR_BUCKET = 64
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than ``size`` are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text over word shingles; 0 without words."""
    hashes = shingle_hashes(text, size)
    if len(hashes) <= 1:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, size: int = 3) -> Column:
    """Fingerprint of a text column as a signed long; null text gives 0."""

    @F.pandas_udf("long")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            values = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return apply(text)


def _mask(start: int, length: int) -> int:
    """Bits of ``length`` ring segments from segment ``start``, as a signed long."""
    value = 0
    for k in range(start, start + length):
        k %= len(SEGMENTS)
        value |= ((1 << SEGMENTS[k]) - 1) << sum(SEGMENTS[:k])
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _quota(length: int) -> int:
    """Differences a viable chain of ``length`` segments may hold in total."""
    return length * DISTANCE // len(SEGMENTS)


#: Segments at the head of a chain whose budget is zero: they must agree exactly.
EXACT = max(k for k in range(1, len(SEGMENTS)) if _quota(k) == 0)


def _chain(a: str, b: str) -> Column:
    """True if the rest of the chain that starts at segment ``s`` stays within its budgets."""
    diff = F.col(a).bitwiseXOR(F.col(b))
    viable = F.lit(True)
    for length in range(EXACT + 1, len(SEGMENTS)):
        mask = F.element_at(F.array(*[F.lit(_mask(s, length)) for s in range(len(SEGMENTS))]), F.col("s") + 1)
        viable = viable & (F.bit_count(diff.bitwiseAND(mask)) <= _quota(length))
    return viable & (F.bit_count(diff) <= DISTANCE)


def links(prints: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges ``a, b`` between nodes whose fingerprints differ in two bits or fewer.

    ``prints`` has distinct ``fp`` and their ``node``. If two fingerprints differ
    in d <= 2 of 64 bits cut into five ring segments, some chain of consecutive
    segments has at most ``length * 2 / 5`` differences at every length; so two
    neighbouring segments agree exactly (the bucket key), three and four hold one
    difference at most. Buckets up to ``pair_bucket`` are compared pairwise behind
    these budgets. In larger buckets all pairs would be quadratic: there, each
    fingerprint names the 65 values within one bit of it, and two fingerprints
    within two bits share such a value. A value has at most 65 members, so it
    links them through the smallest. Both ways find every link or a path of links.
    """
    heads = F.array(*[
        F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(s, EXACT))).alias("key"))
        for s in range(len(SEGMENTS))
    ])
    rows = prints.select("fp", "node", F.inline(heads))
    # Written first, so that adaptive execution can split a hot bucket in the join.
    sizes = stored(rows.groupBy("s", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = checkpointed(rows.join(sizes, ["s", "key"]))
    few = shared.where(F.col("size") <= pair_bucket)
    left = few.select("s", "key", F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    right = few.select("s", "key", F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    pairs = (
        left.join(right, ["s", "key"]).where(F.col("fp_a") < F.col("fp_b")).where(_chain("fp_a", "fp_b"))
        .select("a", "b")
    )
    near = [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << BITS) if i == BITS - 1 else 0))) for i in range(BITS)]
    stars = (
        shared.where(F.col("size") > pair_bucket).select("fp", "node").distinct()
        .select("node", F.explode(F.array(F.col("fp"), *near)).alias("value"))
        .groupBy("value").agg(F.collect_list("node").alias("nodes"))
        .where(F.size("nodes") > 1)
        .select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b"))
    )
    return pairs.union(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, pair_bucket: int = PAIR_BUCKET,
    similarity: int | None = None,
) -> DataFrame:
    """Fingerprint and group of every document.

    Returns one row per input row: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of two differing bits.
    Null, empty and blank texts have fingerprint zero and are linked like others.
    Rows that share an id count as one document in linking. A row without id keeps
    its fingerprint, has no component and links nothing. An empty table gives no
    rows; other columns are ignored. Equal fingerprints collapse before any pair
    is looked for, so groups of exact copies cost one row.

    With ``similarity`` (percent), texts are also linked whose shingle sets are at least
    that similar (``near_copies``): two bits of 64 find little more than exact copies.
    """
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), size).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null")
    rows_of_id = rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # An id with several fingerprints ties their nodes together.
    several = rows_of_id.where("lo <> hi").select("id")
    ties = (
        rows.join(several, "id").select("id", "fp").join(prints, "fp")
        .select(F.col("id").alias("a"), F.col("node").alias("b"))
    )
    edges = links(prints, pair_bucket).union(ties)
    if similarity is not None:
        # One row for each text and the least id under it: equal fingerprints needn't mean equal texts.
        texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
            F.col(id_col).alias("node"), F.col(text_col).alias("text"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
        first = texts.groupBy("digest").agg(F.min("node").alias("node"))
        texts = texts.join(first, ["node", "digest"], "left_semi").dropDuplicates(["node", "digest"]).select("node", "text")
        near = stored(near_copies(texts, size, similarity), "near")
        ends = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
        homes = rows.join(ends, "id", "left_semi").join(prints, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
        edges = edges.union(near).union(homes)
    grouped = components(edges)
    named = (
        prints.join(grouped, "node", "left")
        .select("fp", F.coalesce("component", "node").alias("component"))
    )
    return rows.join(named, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )


#: Bands of a MinHash sketch, and hashes that agree in a band: two texts with 80 % of their
#: shingles in common share a band with a chance of 1 - (1 - 0.8 ** 5) ** 24 = 0.99993.
BANDS, BAND_ROWS = 24, 5
#: Hashes sketched at a time, so that memory doesn't follow the length of a text.
SKETCHED = 1 << 12
#: Longs of a parity sketch, which bounds how much two shingle sets can have in common.
PARITY_LONGS = 32


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the mix of its least hashes under as many multiply-shift functions."""
    draw = np.random.default_rng(SEED)
    times, plus = draw.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), SKETCHED):
        part = hashes[at:at + SKETCHED, None].astype(np.uint64)
        np.minimum(least, (part * (times * np.uint64(2) + np.uint64(1)) + plus).min(axis=0), out=least)
    keys = np.full(BANDS, np.uint64(SEED))
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ (row >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_LONGS slots whether an odd number of the hashes fall into it.

    What two sets share cancels out: their sketches differ in no more slots than they have different shingles.
    """
    slots = 64 * PARITY_LONGS
    odd = np.bincount((hashes >> np.uint64(BITS - slots.bit_length() + 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def near_copies(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges ``a, b`` that join all nodes whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``texts`` has ``node`` and ``text``; a node with several texts stands for each. Candidates
    are the pairs that share a band of a MinHash sketch. Those that can't be alike by their numbers
    of shingles and parity sketches are left out, the others are verified by their whole shingle
    sets. First each text of a band meets the least node of it, which is the same for most bands
    of a large group; where this doesn't join them, it meets the least and the greatest by a hash
    that differs from band to band. Then, where the texts of a band aren't all joined, every pair
    of them that isn't meets too; only links between texts that are joined already are left out.
    Texts without words have no copies.
    """

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in batch["text"]]
            some = [k for k, hashes in enumerate(sets) if len(hashes)]
            yield pd.DataFrame({
                "node": np.repeat(batch["node"].to_numpy()[some], BANDS), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(some)),
                "key": np.concatenate([_band_keys(sets[k]) for k in some]) if some else np.zeros(0, dtype=np.int64),
                "size": np.repeat(np.array([len(sets[k]) for k in some], dtype=np.int64), BANDS),
                # The first band's row holds the text's parity sketch.
                "bits": [x for k in some for x in [_parities(sets[k]), *[None] * (BANDS - 1)]]})

    texts = texts.where("text is not null")
    rows = stored(texts.mapInPandas(bands, "node long, band int, key long, size long, bits array<long>"), "bands")
    sketches, rows = rows.where("band = 0").select("node", "size", "bits"), rows.drop("bits")
    mixed = F.xxhash64("node", "band")
    chosen = [F.min("node").alias("least"), F.min_by("node", mixed).alias("low"), F.max_by("node", mixed).alias("high")]
    buckets = stored(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), *chosen).where("n > 1"), "buckets")

    def meeting(*others: str) -> DataFrame:
        pairs = rows.join(buckets.select("band", "key", *others), ["band", "key"])
        pairs = pairs.select("node", F.explode(F.array_distinct(F.array(*others))).alias("other")).where("node <> other")
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    tried = stored(meeting("least"), "candidates")
    found = stored(_alike(_possible(tried, sketches, percent), texts, size, percent), "alike")
    joined = components(found)
    home = [joined.select(F.col("node").alias(n), F.col("component").alias(f"component_{n}")) for n in ("a", "b")]
    apart = meeting("low", "high").join(home[0], "a", "left").join(home[1], "b", "left").where(
        "component_a is null or component_b is null or component_a <> component_b").select("a", "b")
    more = stored(apart.join(tried, ["a", "b"], "left_anti"), "candidates")
    tried = tried.union(more)
    if not (more := _possible(more, sketches, percent)).isEmpty():
        found = stored(found.union(_alike(more, texts, size, percent)), "alike")
        joined = components(found)

    # Two of three texts of a band may not have met yet, of two they have.
    members = rows.join(buckets.where("n > 2").select("band", "key"), ["band", "key"]).join(joined, "node", "left")
    members = stored(members.withColumn("component", F.coalesce("component", "node")), "members")
    parts = stored(members.groupBy("band", "key", "component").agg(F.min("size").alias("low"), F.max("size").alias("high")), "parts")
    # Too unequal numbers of shingles can't be alike, be it of two texts or of all of two parts.
    one, two = (parts.select("band", "key", *[F.col(c).alias(f"{c}_{n}") for c in ("component", "low", "high")]) for n in ("a", "b"))
    meets = one.join(two, ["band", "key"]).where("component_a < component_b").where(
        (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent))
    left, right = (
        members.select("band", "key", F.col("component").alias(f"component_{n}"), F.col("node").alias(f"node_{n}"), F.col("size").alias(f"size_{n}"))
        for n in ("a", "b"))
    rest = meets.select("band", "key", "component_a", "component_b").join(left, ["band", "key", "component_a"]).join(
        right, ["band", "key", "component_b"]).where("node_a <> node_b").where(
        F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
    rest = rest.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    rest = _possible(rest.join(tried, ["a", "b"], "left_anti"), sketches, percent)
    return found if rest.isEmpty() else found.union(_alike(rest, texts, size, percent))


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may have a Jaccard similarity of ``percent`` or more, by their numbers of shingles and parity sketches."""
    one, two = (sketches.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("bits").alias(f"bits_{n}")) for n in ("a", "b"))
    differ = sum(F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY_LONGS))
    # Of x and y shingles d differ: (x + y - d) / 2 are shared, (x + y + d) / 2 are there in all.
    enough = (F.col("size_a") + F.col("size_b")) * (100 - percent) >= differ * (100 + percent)
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    return stored(pairs.join(one, "a").join(two, "b").where(near & enough).select("a", "b").distinct(), "possible")


def _alike(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a Jaccard similarity of ``percent`` or more."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "hashes": [np.unique(shingle_hashes(t, size)).tobytes() for t in batch["text"]]})

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = stored(texts.join(wanted, "node", "left_semi").mapInPandas(sets, "node long, hashes binary"), "shingle-sets")
    one, two = (held.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in ("a", "b"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            # Too unequal numbers of shingles can't be alike.
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                out.append(False)
                continue
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    return pairs.join(one, "a").join(two, "b").where(alike("a_hashes", "b_hashes")).select("a", "b")
