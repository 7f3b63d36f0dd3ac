"""Repeated byte strings across a corpus by depth-limited radix passes over sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import small, stored

#: Bytes of a string that counts as repeated, and of its first digit.
DEPTH = 100
DIGIT = 32
#: Window starts handled at a time; memory doesn't follow the length of a text. At most 2 ** _PLACE.
BLOCK = 1 << 18
_PLACE = 20
_ODD = 0x9E3779B97F4A7C15
#: Bits of each of the two offsets packed below an anchor's first window.
_SIDE = 8


@cache
def _byte_codes() -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(inverse: bool) -> np.ndarray:
    base = pow(_ODD, -1, 1 << 64) if inverse else _ODD
    factors = np.full(BLOCK + 2 * DEPTH, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all strings of one length in a block. They choose suffixes and deal them; equal bytes are found otherwise."""

    def __init__(self, data: np.ndarray):
        coded = _byte_codes()[data] * _powers(False)[:len(data)]
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(coded, dtype=np.uint64)))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * _powers(True)[:n])


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach:]) if width > reach else values


def _blocks(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(data) - depth + 1, BLOCK):
        yield at, data[at:at + BLOCK + depth - 1]


def anchors(data: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled suffixes of a text: place, first window, last window, hash of their first digit.

    Each window of ``depth`` bytes belongs to the suffix in it whose first ``digit``
    bytes hash lowest (the leftmost of equal ones), so equal windows belong to
    suffixes with equal digits at the same offset. A suffix serves a run of windows.
    """
    for at, block in _blocks(data, depth):
        digits = _Hashes(block).all(digit)
        order = (digits >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(digits), dtype=np.uint64)
        place = (_least_of(order, depth - digit + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        where = place[first]
        yield where + at, first + at, last + at, digits[where]


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, its run and the suffix's place behind it in one long, ordered like the first window."""
    return (first << 2 * _SIDE) | ((last - first) << _SIDE) | (place - first)


def _rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


CELLS = pa.schema([(n, pa.int64()) for n in ("id", "part", "own", "span", "digit", "cell", "cell2")])
CONTEXTS = pa.schema([
    ("lo", pa.int32()), ("hi", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary()),
    *((n, pa.int64()) for n in ("id", "part", "start")),
])
#: Parts that a row's windows go on in, from pass to pass.
WAYS = 4
#: Rows and bytes of an output batch.
ROWS, GATHER = 1 << 15, 1 << 21


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.binary(): 'binary', pa.int32(): 'int'}).get(f.type, 'long')}" for f in schema)


def _values(column: pa.Array) -> Iterator:
    """Python values one at a time, so that a batch isn't held twice."""
    return (x.as_py() for x in column)


def _gathered(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about GATHER bytes, counted in the column ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) + 64
        if size > GATHER:
            yield _rows(schema, list(zip(*held)))
            held, size = [], 0
    if held:
        yield _rows(schema, list(zip(*held)))


def _own_cells(text: pa.BinaryScalar, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Number of a text's sampled suffixes; span, digit and cell of each, the first of equal ones.

    The cell is the XXH3 (128 bits) of all bytes that the suffix serves, seeded by its place in them.
    """
    data = memoryview(text.as_buffer())
    found = []
    for place, first, last, digits in anchors(np.frombuffer(data, dtype=np.uint8), depth, digit):
        cells = b"".join(
            xxhash.xxh3_128_digest(data[a:b], seed=c) for a, b, c in zip(first.tolist(), (last + depth).tolist(), (place - first).tolist())
        )
        found.append((_pack(place, first, last), digits.view(np.int64), *np.frombuffer(cells, dtype=np.int64).reshape(-1, 2).T))
    span, digits, cell, cell2 = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((span, cell2, cell))
    new = np.concatenate(([True], (cell[order[1:]] != cell[order[:-1]]) | (cell2[order[1:]] != cell2[order[:-1]])))
    keep = order[new]
    return np.full(len(keep), len(span)), span[keep], digits[keep], cell[keep], cell2[keep]


def _cells(depth: int, digit: int):
    """Rows of the sampled suffixes, once for each cell of a text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for k, part, text in zip(_values(batch.column("id")), _values(batch.column("part")), batch.column("text")):
                own = _own_cells(text, depth, digit)
                parts.append((np.full(len(own[0]), k), np.full(len(own[0]), part), *own))
                size += len(own[0])
                if size > ROWS:
                    yield _rows(CELLS, [np.concatenate(c) for c in zip(*parts)])
                    parts, size = [], 0
            if parts:
                yield _rows(CELLS, [np.concatenate(c) for c in zip(*parts)])

    return apply


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: compressed one by one."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 10):
            part = batch.slice(at, 1 << 10)
            texts = [pack(t.as_buffer()) if t.is_valid else None for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("part"), pa.array(texts, type=pa.binary())], names=["id", "part", "packed"]
            )


def _unpacked(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _contexts(depth: int, digit: int):
    """The windows that an open suffix serves, as slices of its own text: the second pass's rows."""
    low = (1 << _SIDE) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for id_, own, packed, open_ in zip(*(_values(batch.column(c)) for c in ("id", "part", "packed", "open"))):
                text = _unpacked(packed)
                for span in open_:
                    first, more, lead = span >> 2 * _SIDE, span >> _SIDE & low, span & low
                    yield from _parts((0, depth - digit, lead, text[first:first + more + depth], id_, own, first), depth)

    return lambda batches: _gathered(rows(batches), CONTEXTS, 3)


def _parts(row: tuple, depth: int) -> Iterator[tuple]:
    """A row's windows by WAYS parts of the places that the suffix may have in them."""
    lo, hi, lead, data, id_, part, start = row
    least = lead - (len(data) - depth)  # of the window that begins last
    step = -(-(hi - lo + 1) // WAYS)
    for a in range(lo, hi + 1, step):
        b = min(hi, a + step - 1)
        most, fewest = min(lead, b), max(least, a)
        if fewest <= most:
            at = lead - most
            yield a, b, most, data[at:at + most - fewest + depth], id_, part, start + at


def _next_pass(depth: int):
    """The next pass of each row, as rows of fewer windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(_values(batch.column(f.name)) for f in CONTEXTS)):
                yield from _parts(row, depth)

    return lambda batches: _gathered(rows(batches), CONTEXTS, 3)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Rows ``id, part, text``, and whether some id has different texts.

    ``part`` tells the texts of an id apart: their XXH64, or 0 where no id has several.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    by_hash = texts.withColumn("part", F.xxhash64("text"))
    several = (
        by_hash.where("id is not null").groupBy("id").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
        .where("lo <> hi")
    )
    mixed = not several.isEmpty()
    return (by_hash if mixed else texts.withColumn("part", F.lit(0).cast("long"))).select("id", "part", "text"), mixed


def first_suffixes(texts: DataFrame, mixed: bool, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """The first of all sampled suffixes that serve equal windows: ``id, part, own, span, digit``.

    What is not listed repeats what is; ``own`` is the number of all suffixes of the text. Rows that share an id share their text unless the
    ids are ``mixed``, so the id alone orders them; a minimum of plain longs is combined by hash.
    """
    cells = (
        texts.where(f"id is not null and octet_length(text) >= {depth}").mapInArrow(_cells(depth, digit), _ddl(CELLS))
        .groupBy("digit", "cell", "cell2")
    )
    if mixed:
        heads = cells.agg(F.min(F.struct("id", "part", "span", "own")).alias("head")).select("head.*", "digit")
    else:
        heads = cells.agg(
            F.min("id").alias("id"), F.min("part").alias("part"), F.min_by("span", "id").alias("span"), F.min_by("own", "id").alias("own"))
    return stored(heads.select("id", "part", "own", "span", "digit"), "suffixes")


def open_suffixes(heads: DataFrame) -> DataFrame:
    """Those whose digit also heads other windows, so that some of theirs may still begin elsewhere: ``id, part, open``.

    The digits are written first: adaptive execution splits a hot key only where both
    sides of the join come straight from a shuffle.
    """
    mixed = stored(
        heads.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("digit"), "digits"
    )
    return heads.join(mixed, "digit").groupBy("id", "part").agg(F.collect_list("span").alias("open"))


def repeated_windows(contexts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Ranges ``id, part, start, stop`` of windows in contexts that also start earlier, by further radix passes.

    A row serves windows that hold the suffix's place between ``lo`` and ``hi`` bytes after
    their start, so all of them share ``depth - (hi - lo)`` bytes around it: the digits seen
    so far. A pass counts the seen digits (by a hash of 64 bits; only hashes travel) and
    lets go of rows that are alone with theirs. The others are grouped by their bytes; of
    equal ones the first stays and the others are repeated. Where rows of different bytes
    share the seen digits, they go to the next pass in WAYS parts of the places, with more
    digits to see. In the last every row is one window, and equal groups are equal bytes.
    A group is never gathered: it is a combined minimum and a join.
    """
    whole, found = ["lo", "hi", "lead", "bytes"], []
    seen = F.xxhash64("lo", "hi", F.expr(f"substring(bytes, lead - lo + 1, {depth} - (hi - lo))"))
    own = F.struct("id", "part", "start")
    while True:
        contexts = contexts.withColumn("seen", seen)
        shared = stored(contexts.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seen"), "digits")
        rows = contexts.join(small(shared), "seen")
        heads = stored(rows.groupBy("seen", *whole).agg(F.min(own).alias("head"), F.count(F.lit(1)).alias("n")), "heads")
        several = heads.where("n > 1").select(*whole, "head")
        later = rows.join(several, whole).where(own != F.col("head"))
        found.append(stored(later.select("id", "part", "start", (F.col("start") + F.octet_length("bytes")).alias("stop")), "ranges"))
        kinds = heads.where("hi > lo").groupBy("seen").agg(F.count(F.lit(1)).alias("kinds"))
        mixed = stored(kinds.where("kinds > 1").select("seen"), "digits")
        if mixed.isEmpty():
            return reduce(DataFrame.union, found)
        left = heads.where("hi > lo").join(small(mixed), "seen").select(*whole, "head.*")
        contexts = stored(left.mapInArrow(_next_pass(depth), _ddl(CONTEXTS)), "contexts")


def _merged(starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the ranges, within a text of this length."""
    inside = starts < length
    starts, stops = starts[inside], np.minimum(stops[inside], length)
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1])))
    return starts[first], stops[np.append(first[1:] - 1, len(stops) - 1)]


CUT = pa.schema([
    ("id", pa.int64()), ("text", pa.binary()), ("kept", pa.binary()),
    ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())),
])


def _cut(depth: int, digit: int):
    """Texts without the windows of suffixes that aren't listed as first, and without the given ranges.

    All suffixes of a ``whole`` text are first, so they needn't be found again.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for id_, packed, whole, heads, ranges in zip(*(batch.column(c) for c in ("id", "packed", "whole", "heads", "ranges"))):
                id_, text = id_.as_py(), _unpacked(packed.as_py())
                starts, stops = ([ranges.values.field(c).to_numpy()] if ranges.is_valid else [] for c in ("start", "stop"))
                if id_ is not None and len(text) >= depth and not whole.as_py():
                    own = heads.values.to_numpy(zero_copy_only=False) if heads.is_valid else np.zeros(0, dtype=np.int64)
                    for place, first, last, _ in anchors(np.frombuffer(text, dtype=np.uint8), depth, digit):
                        again = ~np.isin(_pack(place, first, last), own, kind="sort")
                        starts.append(first[again])
                        stops.append(last[again] + depth)
                runs = np.stack(_merged(np.concatenate(starts), np.concatenate(stops), len(text)), axis=1).tolist() if starts else []
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((id_, text if packed.is_valid else None, kept, [r[0] for r in runs], [r[1] for r in runs]))
                size += len(text)
                if size > GATHER:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), CUT)], schema=CUT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), CUT)], schema=CUT)

    return apply


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """Each text as UTF-8 bytes without those covered by a ``depth``-byte string that also starts earlier.

    One row per input row: the id, ``text`` (the bytes), ``kept`` (the bytes left) and
    the removed runs ``starts`` and ``stops``. Earlier is a smaller id, or the same id
    and an earlier start. Null, empty and shorter texts lose nothing, nor do rows
    without id, which repeat nothing either. Rows that repeat an id and its text are
    one document and are cut alike; different texts under one id are documents of their
    own, that with the smaller XXH64 (signed) earlier. Other columns are ignored; an
    empty table gives no rows. Ids are integers.

    Only sampled suffixes are sorted (``anchors``), most significant digit first:

    1. their first ``digit`` bytes, and a 128-bit hash of all the windows they serve; of
       equal ones the first is kept by a combined minimum, all others' windows are repeated;
    2. digits that still head several kinds of windows are open: the bytes of those windows
       go on through passes over more and more digits (``repeated_windows``), to their full
       depth, and are compared as bytes.

    Texts are shuffled once, compressed, and meet both the open suffixes and the result.
    """
    texts, mixed = _texts(docs, id_col, text_col)
    heads = first_suffixes(texts, mixed, depth, digit)
    key = ["id", "part"]
    travelling = texts.where("id is not null").mapInArrow(_compressed, "id long, part long, packed binary")
    contexts = stored(travelling.join(open_suffixes(heads), key).mapInArrow(_contexts(depth, digit), _ddl(CONTEXTS)), "contexts")
    ranges = repeated_windows(contexts, depth)
    counts = heads.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    counts = stored(counts.select(*key, (F.col("n") == F.col("own")).alias("whole")), "counts")
    # Only texts that lose a suffix need to know which of theirs are first.
    listed = heads.join(small(counts.where("not whole").select(*key)), key)
    none = {"span": "long", "range": "struct<start: bigint, stop: bigint>", "whole": "boolean"}
    only = lambda df, **given: df.select(*key, *[given.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()])
    of_doc = (
        only(listed, span=F.col("span")).union(only(ranges, range=F.struct("start", "stop"))).union(only(counts.where("whole"), whole=F.lit(True)))
        .groupBy(*key).agg(F.max("whole").alias("whole"), F.collect_list("span").alias("heads"), F.collect_set("range").alias("ranges"))
    )
    nothing = [F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("array<bigint>").alias("heads"),
               F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("ranges")]
    without = texts.where("id is null").mapInArrow(_compressed, "id long, part long, packed binary").select("id", "packed", *nothing)
    rows = travelling.join(of_doc, key, "left").select("id", "packed", "whole", "heads", "ranges").union(without)
    cut = rows.mapInArrow(_cut(depth, digit), "id long, text binary, kept binary, starts array<long>, stops array<long>")
    return cut.withColumnRenamed("id", id_col)


def digests(rows: DataFrame) -> DataFrame:
    """Sizes and digest of the rows of ``remove_repeats``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "kept", "starts", "stops")],
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
