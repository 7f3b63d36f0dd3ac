"""Token counts under a unigram vocabulary, with forward scores shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mark of a word's beginning in the vocabulary. Fixed value.
WORD_START = "▁"
#: Characters of pre-tokens put into one trie, and counts a worker remembers between tries.
GATHER = 1 << 20
REMEMBERED = 1 << 20
#: Pre-tokens longer than this have their own trie path and are not remembered.
LONG = 64


@cache
def load_scores(path: str) -> tuple[dict[str, float], int]:
    """Log-probabilities of a vocabulary file's pieces by Zipf's law over their rank, and the longest piece.

    The file lists pieces from the most to the least frequent; the r-th gets a
    probability proportional to 1 / r. Control, unknown and byte entries don't count.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(k) for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]
    total = math.log(sum(1 / (k + 1) for k in range(len(names))))
    return {name: -math.log(k + 1) - total for k, name in enumerate(names)}, max(map(len, names), default=0)


def unknown_cost(scores: dict[str, float]) -> float:
    """Score of one byte of a character that no piece covers: less than any piece."""
    return min(scores.values(), default=0.0) - 10.0


def terminal_counts(words: list[str], scores: dict[str, float], longest: int) -> dict[str, int]:
    """Number of pieces in the best segmentation of each distinct word.

    Sorted words are the depth-first order of their trie: the characters a word
    shares with the one before are nodes already reached, whose forward scores stay
    on the stack. Only the nodes below are scored, each once. Each node holds the
    best score of a segmentation that ends there and its number of pieces (the fewest
    among equal scores). A character that no piece covers is spelled in bytes.
    """
    counts: dict[str, int] = {}
    unknown = unknown_cost(scores)
    best, number = [0.0], [0]
    before = ""
    get = scores.get
    for word in sorted(words):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1:], number[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top, pieces = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or s == top and number[start] + 1 < pieces:
                        top, pieces = s, number[start] + 1
            if word[end - 1] not in scores:
                size = len(word[end - 1].encode("utf-8", "replace"))
                s = best[end - 1] + unknown * size
                if s > top:
                    top, pieces = s, number[end - 1] + size
            best.append(top)
            number.append(pieces)
        counts[word] = number[-1]
        before = word
    return counts


def pretokens(text: str | None) -> list[str]:
    """Words of a text, each with the mark of its beginning."""
    return [WORD_START + w for w in (text or "").split()]


class Counter:
    """Counts tokens of texts; remembers the terminal counts of pre-tokens."""

    def __init__(self, path: str):
        self.scores, self.longest = load_scores(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Number of pre-tokens and of tokens of each text."""
        split = [pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {w for words in split for w in words}.difference(self.known)
        self.known.update(terminal_counts([w for w in new if len(w) <= LONG], self.scores, self.longest))
        long = terminal_counts([w for w in new if len(w) > LONG], self.scores, self.longest)
        for words in split:
            yield len(words), sum(self.known[w] if len(w) <= LONG else long[w] for w in words)


def count_column(text: Column, path: str) -> Column:
    """Struct ``n_pretokens, n_tokens`` of a text column."""

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for texts in parts:
            out, group, size = [], [], 0
            for text in texts:
                group.append(text if isinstance(text, str) else "")
                size += len(group[-1])
                if size > GATHER:
                    out += counter.count(group)
                    group, size = [], 0
            out += counter.count(group)
            yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["n_pretokens", "n_tokens"])

    return apply(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pre-tokens and tokens of every whole text.

    One row per input row: the id, ``n_pretokens`` and ``n_tokens``. Null, empty and
    blank texts count 0; repeated rows repeat, other columns are ignored, an empty
    table gives no rows. Nothing is shuffled: each task builds tries of the distinct
    pre-tokens of about a million characters at a time.
    """
    counted = docs.select(F.col(id_col).alias("id"), count_column(F.col(text_col), path).alias("n"))
    return counted.select(F.col("id").alias(id_col), "n.n_pretokens", "n.n_tokens")
