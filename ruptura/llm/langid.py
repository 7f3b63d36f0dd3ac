"""Language identification with a bit-sliced Bloom filter over character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed, fresh_name
from ruptura.llm.samples import sample_by

UNKNOWN = "und"
#: Character n-gram lengths; a space marks both ends of a word.
ORDERS = (2, 3, 4)
#: Bloom positions (a power of two) and hash functions.
SLOTS = 1 << 20
HASHES = 2
#: Fitting bounds: about so many documents of a language, and so many of its commonest n-grams.
FIT_DOCS = 2000
FIT_GRAMS = 30_000
#: A language contains an n-gram that is at least this frequent there, against the language it is most frequent in.
SHARE = 0.2
LEAST = 3
#: Languages a word of a slot can tell apart; a slot has as many words as the languages need.
WORD_BITS = 64
#: Characters handled at a time, so that memory doesn't follow the length of a text.
BLOCK = 1 << 20

#: Bits of every byte, lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter (Unicode category L), else 0."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c
    return table


def letter_stream(text: str) -> np.ndarray:
    """Lower-cased letters with single zeros between words and at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[points]
    keep = letters != 0
    if not keep.any():
        return np.zeros(0, dtype=np.uint64)
    keep[:-1] |= keep[1:] != keep[:-1]  # the zero before a word
    stream = letters[keep]
    edge = np.zeros(1, dtype=stream.dtype)
    parts = [x for x in (edge if stream[0] else None, stream, edge if stream[-1] else None) if x is not None]
    stream = np.concatenate(parts)
    return stream[(stream != 0) | (np.concatenate(([1], stream[:-1])) != 0)].astype(np.uint64)


def _grams(stream: np.ndarray) -> np.ndarray:
    """Hash of each n-gram that starts in a word or at the space before it."""
    out = []
    for n in ORDERS:
        if len(stream) < n:
            continue
        code = np.full(len(stream) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = (code ^ stream[k:len(stream) - n + 1 + k]) * _MIX
        out.append(code ^ (code >> np.uint64(29)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """N-gram hashes of a whole text, block by block; a word across the edge of a block counts as two words."""
    text = text or ""
    for at in range(0, max(len(text), 1), BLOCK):
        stream = letter_stream(text[at:at + BLOCK])
        if len(stream):
            yield _grams(stream)


def _positions(codes: np.ndarray) -> Iterator[np.ndarray]:
    for salt in _SALTS[:HASHES]:
        mixed = codes * salt
        yield ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(8)) & np.uint64(SLOTS - 1)


@dataclass(frozen=True)
class LanguageFilter:
    """One Bloom filter per language, sliced by bit: a slot holds the languages that set it.

    ``slots`` has a row for every 64 languages.
    """

    languages: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, languages: list[str], members: list[tuple[int, ...]]) -> LanguageFilter:
        """From n-gram hashes, each followed by the words of its language bitmask (all as signed longs)."""
        words = max(1, -(-len(languages) // WORD_BITS))
        table = np.array(members, dtype=np.int64).reshape(len(members), words + 1).view(np.uint64)
        slots = np.zeros((words, SLOTS), dtype=np.uint64)
        for at in _positions(table[:, 0]):
            for w in range(words):
                np.bitwise_or.at(slots[w], at.astype(np.int64), table[:, w + 1])
        fill = np.array([np.mean((slots[k // WORD_BITS] >> np.uint64(k % WORD_BITS)) & np.uint64(1)) for k in range(len(languages))])
        return cls(tuple(languages), slots, fill ** HASHES)

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """Bitmask of all languages that contain each n-gram, by one AND over the slots it hashes to; a row for each word."""
        found = np.full((len(self.slots), len(codes)), ~np.uint64(0), dtype=np.uint64)
        for at in _positions(codes):
            found &= self.slots[:, at.astype(np.int64)]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        total, hits = 0, np.zeros(len(self.languages))
        for codes in grams(text):
            total += len(codes)
            found = self.languages_of(codes)
            # Bits are counted eight languages at a time.
            for k in range(0, len(self.languages), 8):
                byte = (found[k // WORD_BITS] >> np.uint64(k % WORD_BITS)).astype(np.uint8)
                some = min(8, len(self.languages) - k)
                hits[k:k + some] += np.bincount(byte, minlength=256) @ _BITS[:, :some]
        if not total or not self.languages:
            return UNKNOWN, 0.0
        corrected = (hits - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(np.argmax(corrected))
        return self.languages[best], float(min(1.0, max(0.0, corrected[best] / total)))


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            parts = [codes for t in texts for codes in grams(t)]
            if parts:
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": counts})


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = FIT_DOCS
) -> LanguageFilter:
    """Learn from about ``sample`` documents of each language that have a text.

    Of each language the ``FIT_GRAMS`` commonest n-grams count. Any number of languages is
    learned; a value with fewer than ``LEAST_ROWS`` documents is taken for no language.
    Without labelled rows nothing is learned, and every prediction is ``und``.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    counts = checkpointed(
        sample_by(labelled, "lang", F.coalesce(F.col("id").cast("string"), F.lit("")), sample)
        .select("lang", "text").mapInPandas(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    size = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(size)
    if not languages:
        return LanguageFilter.of([], [])
    of_language = docs.sparkSession.createDataFrame(
        [(name, k // WORD_BITS, k % WORD_BITS, size[name]) for k, name in enumerate(languages)], "lang string, word int, place int, total long"
    )
    commonest = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rates = (
        counts.where(F.col("n") >= LEAST).withColumn("rank", F.row_number().over(commonest)).where(F.col("rank") <= FIT_GRAMS)
        .join(F.broadcast(of_language), "lang").withColumn("rate", F.col("n") / F.col("total"))
    )
    shared = rates.groupBy("gram").agg(
        F.max("rate").alias("most"), F.collect_list(F.struct("rate", "word", F.expr("shiftleft(1L, place)").alias("bit"))).alias("in"),
    )
    words = range(-(-len(languages) // WORD_BITS))
    masks = [F.expr(f"aggregate(filter(in, x -> x.word = {w} and x.rate >= {SHARE} * most), 0L, (m, x) -> m | x.bit)") for w in words]
    members = shared.select("gram", *[m.alias(f"mask{w}") for w, m in zip(words, masks)]).toArrow()
    return LanguageFilter.of(languages, np.column_stack([members.column(c).to_numpy() for c in members.column_names]))


def predict(model: LanguageFilter, text: Column) -> Column:
    """Struct ``lang, score`` of a text; ``und`` and 0 for null texts and texts without letters."""

    @F.pandas_udf("lang string, score double")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return apply(text)


def identify(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by a filter fitted on ``training``.

    All columns of ``docs`` are kept (columns named like the two new ones are
    replaced). Null texts and texts without letters are ``und`` with score 0; ties go
    to the alphabetically first language; an empty table gives no rows. The score is
    the share of the text's n-grams that the language contains, less what its filter's
    false positives are expected to add.
    """
    model = fit(training, id_col, text_col, lang_col)
    guess = fresh_name(docs, "guess")
    return docs.withColumn(guess, predict(model, F.col(text_col))).withColumns(
        {"lang_pred": F.col(f"{guess}.lang"), "score": F.col(f"{guess}.score")}
    ).drop(guess)
