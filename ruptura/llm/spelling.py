"""Spelling variants one edit apart, found by pivotal bigrams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import stored

#: Fewest code points and occurrences of a word; one code point in so many runs is lost.
LEAST_LENGTH, LEAST_COUNT, LOSS = 7, 2, 31
#: A form has at least so many times the word's occurrences.
FORM_FACTOR = 10
#: Edits between near words, and code points of a gram.
EDITS, GRAM = 1, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``word, n`` of the words that count, from all runs of all texts.

    A run of letters is lower-cased (A-Z only); where LOSS divides the crc32 of
    ``<id>:<run>`` it loses the code point at that number modulo its length.
    """
    capitals = "".join(map(chr, range(65, 91)))
    lowered = F.translate(text_col, capitals, capitals.lower())
    runs = F.filter(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0)), lambda r: F.char_length(r) >= LEAST_LENGTH)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    name = F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")
    rows = rows.select("run", F.crc32(name).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("h") % LOSS == 0, lost).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def disjoint(grams: Sequence[tuple[int, int]], wanted: int) -> list[int]:
    """Places of the ``wanted`` cheapest grams that don't overlap, by dynamic programming.

    ``grams`` are (place, cost) in order of place. ``best[j]`` holds the cheapest choice
    of j grams among those seen; a gram joins the best choice that ends before it.
    """
    done: list[list[tuple[float, tuple[int, ...]]]] = []
    best: list[tuple[float, tuple[int, ...]]] = [(0, ())] + [(float("inf"), ())] * wanted
    free = 0
    for place, cost in grams:
        # The choices among grams that end before this one begins.
        while free < len(done) and grams[free][0] + GRAM <= place:
            free += 1
        before = done[free - 1] if free else [(0, ())] + [(float("inf"), ())] * wanted
        best = [best[0], *(min(best[j], (before[j - 1][0] + cost, (*before[j - 1][1], place))) for j in range(1, wanted + 1))]
        done.append(best)
    return list(best[wanted][1])


def signature(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """Last rank of the word's gram prefix, its prefix, and its pivots, as (rank, place).

    The prefix holds the GRAM * EDITS + 1 rarest grams and all others of the last one's
    rank, so two disjoint ones are always among them.
    """
    grams = sorted((ranks[word[k:k + GRAM]][0], k) for k in range(len(word) - GRAM + 1))
    last = grams[min(len(grams) - 1, GRAM * EDITS)][0]
    prefix = [g for g in grams if g[0] <= last]
    by_place = sorted((k, ranks[word[k:k + GRAM]][1]) for _, k in prefix)
    rank_at = {k: r for r, k in prefix}
    return last, prefix, [(rank_at[k], k) for k in disjoint(by_place, EDITS + 1)]


def letter_mask(word: str) -> int:
    """One bit for each letter of a word (some letters share a bit), as a signed long."""
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    return mask - (1 << 64) if mask >> 63 else mask


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank (rarest first) and count of each bigram: at most 90 * 90, as a word has 90 different letters."""
    places = F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1))
    grams = F.transform(places, lambda k: F.substring(F.col("word"), k, F.lit(GRAM)))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    ordered = sorted((r["count"], r["gram"]) for r in counts)
    return {gram: (rank, count) for rank, (count, gram) in enumerate(ordered)}


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a, a_n, b, b_n`` of words that differ by one inserted, deleted or replaced code point, once each.

    One edit spoils at most one of a word's two disjoint pivots. The other is found in the
    near word, at the same place or one off as the lengths say; and it lies in that
    word's prefix if the prefix ends no earlier in the order of grams. So pivots of the
    word whose prefix ends first meet the other's prefix.
    """
    ranks = gram_ranks(words)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [signature(w, ranks) for w in batch["word"]]
            entry = lambda grams: [{"gram": g, "place": k} for g, k in grams]
            yield batch.assign(
                length=batch["word"].map(len), letters=batch["word"].map(letter_mask), last=[r[0] for r in rows],
                prefix=[entry(r[1]) for r in rows], pivots=[entry(r[2]) for r in rows],
            )

    grams = "array<struct<gram: int, place: int>>"
    signed = stored(words.mapInPandas(sign, f"word string, n long, length int, letters long, last int, prefix {grams}, pivots {grams}"), "signatures")
    index = signed.select(F.explode("prefix").alias("g"), "word", "n", "length", "letters", "last").select(
        "g.gram", "g.place", "length", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.col("letters").alias("b_letters"))
    # (change of length, change of place) of a gram that one edit leaves whole
    moves = F.array(*[F.struct(F.lit(x).alias("length"), F.lit(y).alias("place")) for x, y in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    probes = (
        signed.select(F.explode("pivots").alias("g"), "word", "n", "length", "letters", "last").withColumn("m", F.explode(moves))
        .select("g.gram", (F.col("g.place") + F.col("m.place")).alias("place"), (F.col("length") + F.col("m.length")).alias("length"),
                F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.col("letters").alias("a_letters"))
    )
    first = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a") < F.col("b")))
    # One edit takes one letter away and brings one: a far cheaper test than the distance, which decides.
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2 * EDITS
    near = alike & (F.levenshtein("a", "b", EDITS) == EDITS)
    on = ["gram", "place", "length"]
    same = [probes[c] == index[c] for c in on]
    met = probes.join(index, same[0] & same[1] & same[2] & first & near)
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """Last word of the chain of forms from each word: ``word, root``.

    Each step reaches twice as far. A form has FORM_FACTOR times the occurrences, so a
    chain has fewer links than a count has digits.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of a corpus with their near words and the form that each is a variant of.

    Rows ``word, form, root, n, n_near, form_n``. The form is the near word of largest n
    (ties: the smallest in code-point order) if that is at least FORM_FACTOR times the
    word's n, else null, and so is ``form_n``; the root is the last word of the chain of
    forms, the word itself without one. Null and empty texts hold no words; a null id
    counts as empty; rows that repeat a document count again, as do texts under one id;
    other columns are ignored; an empty table gives no rows. A run of any length is a word.
    """
    words = stored(word_counts(docs, id_col, text_col), "words")
    pairs = stored(near_pairs(words), "near-words")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    met = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = stored(
        words.join(met, "word", "left").withColumn("counts", -F.col("best.minus") >= FORM_FACTOR * F.col("n"))
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(F.col("counts"), F.col("best.near")).alias("form"), F.when(F.col("counts"), -F.col("best.minus")).alias("form_n")),
        "forms",
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in SQL; crc32 byte by byte from its table.
SPELLING_SQL = """
WITH RECURSIVE steps AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY b) AS entries FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_transform(range(octet_length(encode(id || ':' || run))),
      lambda i: CAST(('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
    lambda c, b: xor(c >> 8, entries[1 + xor(c & 255, b)]), 4294967295)) AS h
  FROM runs, crc WHERE length(run) >= 7
), words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) t
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) t
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT DISTINCT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top,
    min(other) FILTER (WHERE other_n = most) AS first FROM (
      SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) t GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.top >= 10 * w.n THEN b.first END AS form, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS k FROM formed
  UNION ALL
  SELECT c.word, f.form, c.k + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""
