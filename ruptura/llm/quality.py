"""Quality rules: fixed base counts, and the divergence of a text from language references."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ruptura.llm.common import small, stored, words_of

# The base rules.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Common words of a language; decimals of the bins that a quantile is looked for in.
COMMON_WORDS = 12
DECIMALS = 4
#: Texts with fewer words are judged by the base rules alone: their histograms say little.
GUARD_WORDS = 50
#: Texts of similar length have limits of their own, as short texts lie farther from any reference.
LENGTHS = (50, 100, 200, 400, 800)
#: A limit is the greatest distance of the good texts of a language and length times MARGIN, from at least
#: LEAST_DOCS of them, and not below what says nothing. Without labels the middle half of all texts stands for the
#: good ones: the upper quartile plus FENCE times the quartile range, and not below the distances of rare but clean texts.
MARGIN, LEAST_DOCS, LEAST_LIMIT = 1.25, 25, (0.10, 0.20)
FENCE, UNLABELLED_LIMIT = 3.0, (0.30, 0.42)
#: Share given to a histogram's empty bins.
SMOOTH = 1e-4
#: First character that stands for a common word in a counted string: short ones are found fast.
_MARK = 0x01


def _length(text: Column) -> Column:
    return F.char_length(text)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _rest(text: Column) -> Column:
    """A text without its letters, which is short: they come in runs, and one match each takes out."""
    return F.regexp_replace(text, r"\p{L}+", "")


def _count(text: Column, characters: str) -> Column:
    return _length(text) - _length(_without(text, characters))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("int"), lambda a, x: a + x)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns q_words (array), q_rest (the text without letters), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A word is hashed once; hashes of two, four and eight words are mixed from two of half as many.
    Repeated windows are found inside each row: window hashes are sorted with their
    place, and a window counts if a neighbour in that order is equal. Only texts that
    have fewer distinct windows than windows are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.col("q_words")
    rows = docs.withColumns({"q_words": words_of(F.col(text_col)), "q_rest": _rest(text)})
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(WHITE)) != "")
    rows = rows.withColumns({"q_lines": lines, "q_windows": F.transform(words, lambda w: F.xxhash64(w))})
    windows, width = F.col("q_windows"), 1
    while width < WINDOW:
        # The last ones of a text lack their second half; none of the whole windows holds them.
        later = F.slice(windows, F.lit(width + 1), F.size(windows))
        rows = rows.withColumn("q_windows", F.zip_with(windows, later, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    rows = rows.withColumn("q_windows", F.slice(windows, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))))
    rows = rows.withColumn("q_sorted", F.when(
        F.size(windows) > F.size(F.array_distinct(windows)),
        F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k")))),
    ))
    ordered = F.col("q_sorted")
    rest = F.size(ordered) - 1
    equal = F.zip_with(
        F.slice(ordered, F.lit(1), rest), F.slice(ordered, F.lit(2), rest),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("q_starts", F.sort_array(F.array_distinct(F.flatten(equal))))
    starts = F.col("q_starts")
    rest = F.size(starts) - 1
    covered = _total(F.zip_with(
        F.slice(starts, F.lit(1), rest), F.slice(starts, F.lit(2), rest), lambda a, b: F.least(b - a, F.lit(WINDOW))
    )) + WINDOW
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": (_length(text) - _count(F.col("q_rest"), WHITE)).cast("long"),
        "n_symbols": _count(F.col("q_rest"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("q_lines", "q_windows", "q_sorted", "q_starts")
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT),
    )


def class_shares(text: Column, rest: Column) -> Column:
    """Shares of lower-case and other letters, capitals, digits, white space, symbols and other marks.

    ``rest`` is the text without letters: all but capitals are counted there.
    """
    total = F.greatest(_length(text), F.lit(1))
    capitals, letters = F.regexp_count(text, F.lit(r"\p{Lu}")), _length(text) - _length(rest)
    digits = F.regexp_count(rest, F.lit(r"\p{N}"))
    white, symbols = _count(rest, WHITE), _count(rest, SYMBOLS)
    parts = [letters - capitals, capitals, digits, white, symbols, _length(rest) - digits - white - symbols]
    return F.array(*[p / total for p in parts])


N_CLASSES = 6


@dataclass(frozen=True)
class Reference:
    """Histograms of one language: character classes, and its common words with all other words last.

    ``limits`` are the greatest distances of both that pass, for each class of lengths.
    """

    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]
    limits: tuple[tuple[float, float], ...] = ((1.0, 1.0),) * len(LENGTHS)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", good: DataFrame | None = None,
) -> list[Reference]:
    """Language references from all documents that have a text and a language.

    ``good`` has the ids of documents that are labelled as good; then only they
    count, and the limits lie beyond the farthest of them. Without it a class's share is
    its median over the language's documents, so that a minority of junk doesn't move it,
    and the limits are fences around the middle half of the distances. A language of which
    fewer than ``LEAST_DOCS`` texts pass the base rules and the guard has no reference.
    Without documents of a stated language there is none.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if good is not None:
        # Read by every pass below, so texts travel to their labels once at most.
        known = stored(known.join(small(good.select(F.col(id_col).alias("id")).distinct()), "id", "left_semi"), "good")
    enough = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    rows = known.join(small(enough.drop("n")), "lang", "left_semi")
    shares = class_shares(F.col("text"), F.col("rest"))
    classes = _quantiles(rows.withColumn("rest", _rest(F.col("text"))).select("lang", shares.alias("v")), ["lang"], [0.5])
    # Written once: the totals, the ranks and their sort all read it.
    counts = stored(
        rows.select("lang", F.explode_outer(words_of(F.lower("text"))).alias("word")).where("word is not null").groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n")), "words"
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = (
        counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).join(totals, "lang")
        .orderBy("lang", "rank").collect()
    )
    out = []
    for lang in sorted({lang for lang, _ in classes}):
        own = [r for r in common if r["lang"] == lang]
        if not own:
            continue
        parts = [max(classes[lang, k][0], SMOOTH) for k in range(N_CLASSES)]
        seen = [r["n"] / r["total"] for r in own]
        out.append(Reference(
            lang, tuple(p / sum(parts) for p in parts), tuple(r["word"] for r in own), (*seen, max(1 - sum(seen), SMOOTH)),
        ))
    return _with_limits(rows, out, good is not None)


def _quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> dict[tuple, list[float]]:
    """Exact interpolated quantiles of each place of the array ``v`` in each group, by group and place.

    Values are counted, and bins of them, of which a group has 10,001 at most between 0 and 1;
    only the bins that hold a wanted position are sorted.
    """
    # Outer, as the planner would work out v once more to drop empty ones.
    values = rows.select(*by, F.posexplode_outer("v").alias("place", "x")).groupBy(*by, "place", "x").agg(F.count(F.lit(1)).alias("n"))
    values = stored(values.withColumn("bin", F.round("x", DECIMALS)), "values")
    group = Window.partitionBy(*by, "place")
    bins = values.groupBy(*by, "place", "bin").agg(F.sum("n").alias("held"))
    bins = bins.withColumns({"upto": F.sum("held").over(group.orderBy("bin")), "total": F.sum("held").over(group)})
    wanted = F.array(*[f(F.lit(p) * (F.col("total") - 1)).cast("long") for p in shares for f in (F.floor, F.ceil)])
    ours = F.filter(wanted, lambda at: (at < F.col("upto")) & (at >= F.col("upto") - F.col("held")))
    bins = bins.withColumn("at", ours).where(F.size("at") > 0).select(*by, "place", "bin", "total", "at", (F.col("upto") - F.col("held")).alias("before"))
    inside = values.join(bins, [*by, "place", "bin"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "place", "bin").orderBy("x")))
    hit = F.array_distinct(F.filter("at", lambda at: (at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))))
    found: dict[tuple, dict[int, float]] = {}
    totals = {}
    for r in inside.select(*by, "place", "x", "total", F.explode(hit).alias("at")).collect():
        g = tuple(r[:len(by) + 1])
        found.setdefault(g, {})[r["at"]] = r["x"]
        totals[g] = r["total"]

    def between(g: tuple, p: float) -> float:
        at = p * (totals[g] - 1)
        low, high = math.floor(at), math.ceil(at)
        return found[g][low] if low == high else (high - at) * found[g][low] + (at - low) * found[g][high]

    return {g: [between(g, p) for p in shares] for g in found}


def _with_limits(rows: DataFrame, references: list[Reference], good: bool) -> list[Reference]:
    """References with the limits of their own texts; those with too few texts are left out."""
    if not references:
        return []
    # Written before it is filtered: a filter would be copied down through every derived column.
    judged = stored(_distances(base_counts(rows), references, "text").select("lang", "n_words", "base_failed", "q_all"), "judged")
    judged = judged.where(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    own = judged.select("lang", _by_length(list(range(len(LENGTHS)))).alias("size"), F.explode("q_all").alias("d")).where(F.col("d.lang") == F.col("lang"))
    found = own.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.max("d.c").alias("c"), F.max("d.w").alias("w")).collect()
    farthest = {(f["lang"], f["size"]): (f["c"] * MARGIN, f["w"] * MARGIN) for f in found}
    if not good:
        quarters = _quantiles(own.select("lang", "size", F.array("d.c", "d.w").alias("v")), ["lang", "size"], [0.25, 0.75])
        farthest = {g: tuple(high * (1 + FENCE) - low * FENCE for low, high in (quarters[*g, 0], quarters[*g, 1])) for g in farthest}
    least = LEAST_LIMIT if good else UNLABELLED_LIMIT
    out = []
    for r in references:
        mine = {f["size"]: tuple(map(max, farthest[r.lang, f["size"]], least)) for f in found if f["lang"] == r.lang and f["n"] >= LEAST_DOCS}
        if not mine:
            continue
        # A class of lengths with too few texts takes the limits of the next shorter one that has enough, which are wider, else the next longer.
        nearest = [max([k for k in mine if k <= size], default=min(mine)) for size in range(len(LENGTHS))]
        out.append(replace(r, limits=tuple(mine[k] for k in nearest)))
    return out


def _by_length(values: list) -> Column:
    """The value of the class of lengths that ``n_words`` falls into; texts below the first class have its value."""
    out = F.lit(values[0])
    for least, value in zip(LENGTHS[1:], values[1:]):
        out = F.when(F.col("n_words") >= least, F.lit(value)).otherwise(out)
    return out


def _distance(found: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(found, F.array(*[F.lit(float(x)) for x in reference]), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _distances(docs: DataFrame, references: list[Reference], text_col: str) -> DataFrame:
    """Adds ``q_all`` to rows of ``base_counts``: for each reference c and w, the distances of both histograms, their limits, and lang.

    Common words are counted by writing one private-use character for each and removing it again.
    """
    vocabulary = sorted({w for r in references for w in r.words})
    mark = {w: chr(_MARK + k) for k, w in enumerate(vocabulary)}
    known = F.array(*[F.lit(w) for w in vocabulary])
    signs = F.array(*[F.lit(mark[w]) for w in vocabulary])
    # Most words are sorted out by a set; the place of the others is looked for.
    common = F.filter("q_words", lambda w: F.lower(w).isin(vocabulary))
    marked = F.array_join(F.transform(common, lambda w: F.element_at(signs, F.array_position(known, F.lower(w)).cast("int"))), "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"q_marked": marked, "q_classes": class_shares(text, F.col("q_rest"))})
    total = F.greatest(F.col("n_words"), F.lit(1))
    counted = F.char_length("q_marked")
    rows = rows.withColumn("q_counts", F.array(*[
        (counted - F.char_length(F.replace(F.col("q_marked"), F.lit(mark[w]), F.lit("")))) / total for w in vocabulary
    ]))
    candidates = []
    for r in references:
        own = [F.col("q_counts")[vocabulary.index(w)] for w in r.words]
        spare = F.greatest(F.lit(1.0) - sum(own[1:], own[0]), F.lit(0.0))
        by_class, by_word = _distance(F.col("q_classes"), r.classes), _distance(F.array(*own, spare), r.shares)
        limits = [_by_length([limit[k] for limit in r.limits]) for k in (0, 1)]
        candidates.append(F.struct(
            by_class.alias("c"), by_word.alias("w"), F.lit(r.lang).alias("lang"), limits[0].alias("c_limit"), limits[1].alias("w_limit")))
    return rows.withColumn("q_all", F.array(*candidates)).drop("q_words", "q_rest", "q_marked", "q_classes", "q_counts")


def divergence(docs: DataFrame, references: list[Reference], text_col: str = "text") -> DataFrame:
    """Adds ``nearest`` (a reference's language), ``class_distance``, ``word_distance`` and ``q_far`` to rows of ``base_counts``.

    The nearest reference has the least greater one of both distances, each measured
    against its limit for texts of this length (of equal ones the alphabetically first
    language); ``q_far`` says that one is over its limit even there. All are null if
    there is no reference.
    """
    if not references:
        return docs.withColumns({
            "nearest": F.lit(None).cast("string"), "class_distance": F.lit(None).cast("double"),
            "word_distance": F.lit(None).cast("double"), "q_far": F.lit(None).cast("boolean"),
        }).drop("q_words", "q_rest")
    rows = _distances(docs, references, text_col)
    worst = F.transform("q_all", lambda x: F.struct(
        F.greatest(x["c"] / x["c_limit"], x["w"] / x["w_limit"]).alias("worst"), x["lang"].alias("lang"), x["c"].alias("c"), x["w"].alias("w"),
    ))
    rows = rows.withColumn("q_best", F.array_min(worst))
    return rows.withColumns({
        "nearest": F.col("q_best.lang"), "class_distance": F.col("q_best.c"), "word_distance": F.col("q_best.w"),
        "q_far": F.col("q_best.worst") > 1,
    }).drop("q_all", "q_best")


def judge(
    docs: DataFrame, references: list[Reference], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Base counts and verdict of every whole text.

    One row per input row: the id, the base columns, ``base_failed``, ``kept``, and
    the nearest reference with both distances. ``kept`` is false for base failures,
    and for texts of ``GUARD_WORDS`` words or more that lie beyond a limit from every
    reference. A text labelled with a language that has no reference is judged by the
    base rules alone. Null and empty texts have no words and fail the base; repeated rows
    repeat, other columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text"), lang.alias("q_lang"))
    rows = divergence(base_counts(rows, "q_text"), references, "q_text")
    known = F.col("q_lang").isNull() | F.col("q_lang").isin([r.lang for r in references])
    far = F.coalesce(F.col("q_far"), F.lit(False)) & known & (F.col("n_words") >= GUARD_WORDS)
    return rows.select(
        F.col("q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "nearest", "class_distance", "word_distance",
    )
