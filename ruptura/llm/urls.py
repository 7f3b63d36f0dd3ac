"""URL filter: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed, small

# The rules as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Longest context of the models, in characters, and the padding before a URL.
ORDER = 5
_PAD, _END = "\x02", "\x03"
#: One in FOLDS of the distinct URLs that a rule decides calibrates, all others are counted.
FOLDS = 5
#: Probability of a character of which nothing is known.
UNIFORM = 1 / 256
#: An order's counts are broadcast only if a count has shown that they have no more rows than this.
BROADCAST_ROWS = 20_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, else nulls."""
    out = F.lit(None)
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(url: Column) -> Column:
    """Every character of a URL and its end, each after the ORDER characters before it."""
    text = F.concat(F.lit(_PAD * ORDER), F.lower(F.coalesce(url, F.lit(""))), F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - ORDER), lambda k: F.substring(text, k, F.lit(ORDER + 1)))


@dataclass(frozen=True)
class Model:
    """Counts of ``gram`` (context and character) and of ``context`` per class, and the calibrated threshold."""

    grams: DataFrame
    contexts: DataFrame
    threshold: float = 0.0


def _count(windows: DataFrame) -> Model:
    """Counts of all orders from rows ``window, accepted``."""
    per_class = [F.count_if("accepted").alias("in_a"), F.count_if(~F.col("accepted")).alias("in_r")]
    widest = windows.groupBy("window").agg(*per_class)
    orders = F.array(*[F.expr(f"right(window, {k + 1})") for k in range(ORDER + 1)])
    grams = checkpointed(
        widest.select(F.explode(orders).alias("gram"), "in_a", "in_r").groupBy("gram")
        .agg(F.sum("in_a").alias("in_a"), F.sum("in_r").alias("in_r"))
    )
    contexts = checkpointed(
        grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
            F.sum("in_a").alias("n_a"), F.count_if(F.col("in_a") > 0).alias("t_a"),
            F.sum("in_r").alias("n_r"), F.count_if(F.col("in_r") > 0).alias("t_r"),
        )
    )
    return Model(grams, contexts)


def _ratios(windows: DataFrame, model: Model) -> DataFrame:
    """``window, ratio``: log-probability of each distinct window's last character, accepted less rejected.

    Witten-Bell interpolation: a context seen n times with t different followers gives
    its own counts weight n and the next shorter context weight t; one never seen
    leaves it all to the shorter one. So each window is judged by the longest context
    its class knows. Each order is joined by itself: the low ones, whose few keys would
    be hot, are small enough to broadcast; high ones may grow with the corpus and shuffle.
    """
    rows = windows.withColumns({"p_a": F.lit(UNIFORM), "p_r": F.lit(UNIFORM)})
    for k in range(ORDER + 1):
        grams = small(model.grams.where(F.char_length("gram") == k + 1), BROADCAST_ROWS)
        contexts = small(model.contexts.where(F.char_length("context") == k), BROADCAST_ROWS)
        rows = (
            rows.withColumns({"gram": F.expr(f"right(window, {k + 1})"), "context": F.expr(f"left(right(window, {k + 1}), {k})")})
            .join(grams, "gram", "left").join(contexts, "context", "left")
        )
        new = {}
        for c in "ar":
            n, t = F.col(f"n_{c}"), F.col(f"t_{c}")
            mixed = (F.coalesce(f"in_{c}", F.lit(0)) + t * F.col(f"p_{c}")) / (n + t)
            new[f"p_{c}"] = F.when(n > 0, mixed).otherwise(F.col(f"p_{c}"))
        rows = rows.withColumns(new).select("window", "p_a", "p_r")
    return rows.select("window", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def scores(urls: DataFrame, model: Model) -> DataFrame:
    """``url, score`` of distinct URLs: the mean log ratio over their characters."""
    rows = checkpointed(urls.select("url", F.explode(_windows(F.col("url"))).alias("window")))
    ratios = checkpointed(_ratios(rows.select("window").distinct(), model))
    return rows.join(small(ratios, BROADCAST_ROWS), "window").groupBy("url").agg(F.avg("ratio").alias("score"))


def fit(labelled: DataFrame) -> Model:
    """Learn from all of the distinct ``url, accepted`` rows.

    The counts grow with the corpus: equal windows are added up before the shuffle. The
    threshold lies halfway between the mean scores of accepted and rejected URLs
    in a fold that the counts leave out; it is 0 if either class is missing there.
    """
    rows = checkpointed(labelled)
    apart = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)) == 0
    model = _count(rows.where(~apart).select("accepted", F.explode(_windows(F.col("url"))).alias("window")))
    held = rows.where(apart)
    means = scores(held.select("url"), model).join(held, "url").agg(
        F.avg(F.when(F.col("accepted"), F.col("score"))).alias("a"), F.avg(F.when(~F.col("accepted"), F.col("score"))).alias("r"),
    ).first()
    threshold = 0.0 if None in (means["a"], means["r"]) else (means["a"] + means["r"]) / 2
    return Model(model.grams, model.contexts, threshold)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Host, path, rule and verdict of every URL.

    One row per input row: the id, ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` and ``score`` (null where a rule decides). The models learn from the
    URLs that a rule allows or blocks and judge the distinct others: allowed from the
    threshold on. A null URL is judged like an empty one. Without URLs that a rule
    decides every score is 0 and the URL allowed. Repeated rows repeat, other columns
    are ignored, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    labelled = (
        rows.where("ruled is not null").select("url", (F.col("ruled.verdict") == "allow").alias("accepted")).distinct()
    )
    model = fit(labelled)
    others = rows.where("ruled is null")
    # Written first, so that adaptive execution can split a URL that many rows share.
    judged = checkpointed(scores(others.select("url").distinct(), model))
    decided = rows.where("ruled is not null").withColumn("score", F.lit(None).cast("double"))
    learned = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return decided.unionByName(others.join(judged, "url", "left")).select(
        F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", learned).alias("verdict"), "score",
    )
