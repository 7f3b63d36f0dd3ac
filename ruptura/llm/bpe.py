"""Byte-level BPE: pre-tokenisation by a blocked transition scan, cached merges, decoding."""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points pre-tokenised together: texts are gathered up to this size, longer texts run alone.
GATHER = 1 << 19
#: Steps of the blocked scan: a batch is cut into blocks of so many code points.
STEPS = 256
#: Distinct pre-tokens whose merges a worker remembers; beyond it, it starts afresh.
REMEMBERED = 1 << 19

# Symbols of the transducer. A letter, number or other mark; an apostrophe that could begin a contraction
# of two or three characters; white space inside a run, or the last before something else (space or not);
# the end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, SPACE, EDGE, END = range(9)
# States: what the token that holds the last character is. LEFT_n: a contraction with n letters to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, AFTER_SPACE, LEFT_1, LEFT_2 = range(8)
STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token begins at the character, for every state and symbol."""
    step = np.zeros((STATES, 9), dtype=np.uint8)
    begins = np.ones((STATES, 9), dtype=bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(STATES):
        for symbol, run in runs.items():
            step[state, symbol] = run
            begins[state, symbol] = state not in (run, AFTER_SPACE)
        for symbol, left in ((SHORT, LEFT_1), (LONG, LEFT_2)):
            joins = state in (IN_OTHERS, AFTER_SPACE)  # then it is an ordinary mark
            step[state, symbol] = IN_OTHERS if joins else left
            begins[state, symbol] = not joins
        step[state, INNER], begins[state, INNER] = IN_SPACES, state != IN_SPACES
        step[state, SPACE], step[state, EDGE], step[state, END] = AFTER_SPACE, FRESH, FRESH
    for state, after in ((LEFT_2, LEFT_1), (LEFT_1, FRESH)):
        step[state, LETTER], begins[state, LETTER] = after, False
    return step, begins


_STEP, _BEGINS = _machine()


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    #: The characters with Unicode's property White_Space.
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = INNER
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points in which a text ends before each index of ``ends``, one END after each text."""
    symbols = _classes()[points]
    symbols[ends] = END
    at, last = np.flatnonzero(points == ord("'")), len(points) - 1

    def is_at(offset: int, letters: str) -> np.ndarray:
        there = np.minimum(at + offset, last)
        return np.isin(points[there], [ord(c) for c in letters]) & (symbols[there] == LETTER)

    second, third = points[np.minimum(at + 1, last)], points[np.minimum(at + 2, last)]
    pairs = np.isin(second.astype(np.uint64) << np.uint64(32) | third, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    pairs &= is_at(1, "rvl") & is_at(2, "el")
    symbols[at[pairs]] = LONG
    symbols[at[is_at(1, "stmd")]] = SHORT
    spaces = np.flatnonzero(symbols == INNER)
    following = symbols[np.minimum(spaces + 1, last)]
    edge = spaces[(following != INNER) & (following != END)]
    symbols[edge] = np.where(points[edge] == 32, SPACE, EDGE)
    return symbols


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a token begins at each symbol.

    Transition functions compose associatively: each block's function is built for
    all states at once, block by block side by side; one short pass over the blocks
    gives the state each starts in; a second side-by-side pass reads the marks.
    """
    n = len(symbols)
    blocks = -(-n // STEPS)
    grid = np.full(blocks * STEPS, END, dtype=np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, STEPS).T)
    flat_step = _STEP.ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES)).copy()
    for row in grid:
        maps = flat_step[maps * np.uint8(9) + row[:, None]]
        if (maps == maps[:, :1]).all():
            break
    else:
        row = None
    begin = np.zeros(blocks, dtype=np.uint8)
    if row is not None:  # every block forgot where it started: its end state doesn't depend on it
        state = np.zeros(blocks, dtype=np.uint8)
        for row in grid:
            state = flat_step[state * np.uint8(9) + row]
        begin[1:] = state[:-1]
    else:
        now = FRESH
        for k, function in enumerate(maps.tolist()):
            begin[k], now = now, function[now]
    marks = np.empty((STEPS, blocks), dtype=bool)
    flat_begins, state = _BEGINS.ravel(), begin
    for k, row in enumerate(grid):
        index = state * np.uint8(9) + row
        marks[k] = flat_begins[index]
        state = flat_step[index]
    return marks.T.ravel()[:n]


def pretokenise(texts: list[str]) -> Iterator[list[bytes]]:
    """The pre-tokens of each text, as UTF-8 slices that join to the whole text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(points):
        return
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = np.flatnonzero(_scan(_symbols(points, ends)))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width  # where a code point's bytes begin
    cuts = at[begins]
    first = np.searchsorted(begins, np.concatenate(([0], ends[:-1] + 1)))
    last = np.searchsorted(begins, ends)
    for k, whole in enumerate(raw):
        own = (cuts[first[k]:last[k]] - (at[ends[k - 1]] + 1 if k else 0)).tolist()
        yield [whole[a:b] for a, b in zip(own, [*own[1:], len(whole)])]


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: join the neighbouring pair of lowest rank, leftmost first, while there is one."""
    if piece in ranks:
        return (ranks[piece],)
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap and linked parts, for pieces where rescanning would be quadratic."""
    import heapq

    n = len(piece)
    stop = list(range(1, n + 1))  # a part holds bytes start:stop; stop is also the next part's start
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or stop[i] >= n or stop[stop[i]] != end:
            continue
        gone = stop[i]
        alive[gone] = False
        stop[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:stop[end]])) is not None:
                heapq.heappush(heap, (r, i, stop[end]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i]:end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    return tuple(ranks[piece[i:stop[i]]] for i in range(n) if alive[i])


@cache
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of the token pairs that join, the joined ids, and the ids of the single bytes."""
    ranks = load_ranks(path)
    size = len(ranks)
    joined = {
        ranks[token[:i]] * size + ranks[token[i:]]: rank
        for token, rank in ranks.items() for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    }
    codes = np.array(sorted(joined), dtype=np.int64)
    return codes, np.array([joined[c] for c in codes.tolist()], dtype=np.int64), np.array([ranks[bytes([b])] for b in range(256)])


def merge_many(pieces: list[bytes], path: str) -> list[bytes]:
    """``merge`` for many short pre-tokens at a time, as the bytes of 32-bit ids: one row each, one merge per row and step."""
    codes, joined, single = _pairs(path)
    size = len(load_ranks(path))
    lengths = np.array([len(p) for p in pieces])
    width = int(lengths.max())

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = np.where((a < 0) | (b < 0), -1, a * size + b)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, joined[at], size)

    rows = np.repeat(np.arange(len(pieces)), lengths)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids = np.full((len(pieces), width + 1), -1, dtype=np.int64)
    ids[rows, columns] = single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    costs = rank(ids[:, :-1], ids[:, 1:])
    out = [b""] * len(pieces)
    own = np.arange(len(pieces))
    while len(own):
        low = costs.argmin(axis=1)
        best = costs[np.arange(len(own)), low]
        done = np.flatnonzero(best == size)
        found = ids[done]
        width_of = (found[:, :-1] >= 0).sum(axis=1)
        data = found.astype(np.int32)
        data = data[:, :-1][found[:, :-1] >= 0].tobytes()
        ends = 4 * np.cumsum(width_of)
        for k, a, b in zip(own[done].tolist(), (ends - 4 * width_of).tolist(), ends.tolist()):
            out[k] = data[a:b]
        open_ = np.flatnonzero(best < size)
        own, ids, costs, low, best = own[open_], ids[open_], costs[open_], low[open_], best[open_]
        if not len(own):
            break
        line, ahead = np.arange(len(own)), np.arange(width + 1)
        moved = np.minimum(ahead + (ahead > low[:, None]), width)
        ids[line, low] = best
        ids = np.take_along_axis(ids, moved, axis=1)
        ids[:, -1] = -1
        costs = np.take_along_axis(costs, np.minimum(moved[:, :-1], width - 1), axis=1)
        costs[:, -1] = size
        costs[line, low] = rank(ids[line, low], ids[line, low + 1])
        inner = np.flatnonzero(low)
        costs[inner, low[inner] - 1] = rank(ids[inner, low[inner] - 1], ids[inner, low[inner]])
    return out


class _Known(dict):
    """Remembered merges, as the bytes of 32-bit ids; long pre-tokens are only held for the texts at hand."""

    long: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        return self.long[piece]


class Encoder:
    """Encodes texts with one vocabulary, remembering the merges of pre-tokens."""

    #: Pre-tokens up to this many bytes are merged side by side and remembered.
    SHORT_PIECE = 32

    def __init__(self, path: str):
        self.path = path
        self.ranks = load_ranks(path)
        self.known = _Known()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        split = list(pretokenise(texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(split)).difference(self.known)
        short = [p for p in new if len(p) <= self.SHORT_PIECE]
        if short:
            self.known.update(zip(short, merge_many(short, self.path)))
        self.known.long = {
            p: np.array(merge(p, self.ranks), dtype=np.int32).tobytes() for p in new if len(p) > self.SHORT_PIECE
        }
        for pieces in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), dtype=np.int32)


@cache
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in id order, and where each begins and ends."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum([0, *map(len, by_id)])


def offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """Byte offset of each token's end in the decoded text."""
    edges = _tokens(path)[1]
    return np.cumsum(edges[ids + 1] - edges[ids])


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Bytes of a token sequence, gathered by the tokens' offsets."""
    if not len(ids):
        return b""
    data, edges = _tokens(path)
    width = edges[ids + 1] - edges[ids]
    stops = np.cumsum(width)
    return data[np.arange(stops[-1]) + np.repeat(edges[ids] - (stops - width), width)].tobytes()


def _gathered(texts: pd.Series) -> Iterator[list[str]]:
    """Consecutive texts, in lists of about GATHER characters."""
    group, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if group and size + len(text) > GATHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode(text: Column, path: str) -> Column:
    """Struct of token ``ids`` and the byte ``offsets`` where tokens end; empty for null and empty texts."""

    @F.pandas_udf("ids array<int>, offsets array<long>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for texts in parts:
            ids = [x for group in _gathered(texts) for x in encoder.encode(group)]
            yield pd.DataFrame({"ids": ids, "offsets": [offsets(x, path) for x in ids]})

    return apply(text)


def decode(ids: Column, path: str) -> Column:
    """Bytes of a column of token ids; empty for null."""

    @F.pandas_udf("binary")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([decode_ids(np.asarray(x if x is not None else [], dtype=np.int64), path) for x in rows], dtype=object)

    return apply(ids)


def _digests(text: Column, path: str) -> Column:
    """Struct of the number of tokens, and the digests of the ids and of the bytes they decode to."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        name = [str(k) for k in range(len(_tokens(path)[1]) - 1)].__getitem__
        for texts in parts:
            rows = [
                (len(ids), sha256(" ".join(map(name, ids.tolist())).encode()).hexdigest(), sha256(decode_ids(ids, path)).hexdigest())
                for group in _gathered(texts) for ids in encoder.encode(group)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return apply(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to.

    One row per input row: the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by
    one space) and ``decoded_sha256``. Null and empty texts have no tokens and the
    digests of empty strings. Nothing is shuffled, and the ids don't leave the worker;
    ``encode`` and ``decode`` return them. Repeated rows repeat, other columns are
    ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), _digests(F.col(text_col), path).alias("made"))
    return rows.select(F.col("id").alias(id_col), "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")
