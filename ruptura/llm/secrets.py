"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed, fit_sample

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HEX8 = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "crf")

#: Fitting bounds: about so many documents; so many windows with a secret, as many with a token that is long or
#: holds a digit, and as many others; tokens of a window.
FIT_DOCS = 4000
FIT_WINDOWS = 500
FIT_TOKENS = 40
EPOCHS = 6
RATE, PENALTY = 0.5, 1e-4

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|\S")
#: Tokens of all lines at once, with the ends of lines between them.
_TOKEN_OR_END = re.compile(_TOKEN.pattern + r"|\n")
_ODD = re.compile(r"[0-9]|.{20}")
#: Tokens that a worker remembers; those that show the same share one row of scores.
REMEMBERED = 1 << 18
#: More than the short sums over a token's few features can be off.
ROUNDING = 1e-2
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_matches(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Start, end, kind and value start of the base matches, by start and kind."""
    found = []
    lower = text.lower()
    if any(cue in lower for cue in ("passw", "secret", "token", "api")):
        found += [
            (m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS
        ]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    for start, kind, end, value in sorted(found):
        yield start, end, kind, value


#: Letters by their case, other characters as they are; runs of one kind once.
_KINDS = [(re.compile(r"[^\W\d_]+"), lambda m: "a" if m.group().islower() else "A" if m.group().isupper() else "aA" if m.group()[0].islower() else "Aa"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1")]
_VOWELS = re.compile("[aeiouAEIOU]")


def _shape(token: str) -> str:
    """Kinds of characters in order, as aA0 or Aa0=A: runs of letters by their case, digits as 0, others as they are."""
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "aA" if token[0].islower() else "Aa"
    kinds = token[:64]
    for pattern, kind in _KINDS:
        kinds = pattern.sub(kind, kinds)
    return kinds[:8]


def token_traits(token: str) -> tuple:
    """What a token shows by itself, as a few small values."""
    size = len(token)
    letters, digits = (size, 0) if token.isalpha() else (sum(map(str.isalpha, token)), sum(map(str.isdigit, token)))
    setting = token[:4].lower() if "=" in token[1:-1] else ""
    vowels = len(_VOWELS.findall(token))
    return (
        _shape(token), int(2 * math.log2(min(size, 64))), 4 * letters // size, 4 * digits // size, 4 * len(set(token)) // min(size, 32),
        size >= 8 and HEX8.fullmatch(token) is not None, setting, 4 * vowels // size, min(size, 32) // 8,
    )


def trait_features(traits: tuple) -> list[str]:
    shape, length, letters, digits, variety, hex_, setting, vowels, size = traits
    return [
        "always", f"shape:{shape}", f"length:{length}", f"letters:{letters}", f"digits:{digits}", f"variety:{variety}", f"hex:{hex_}",
        f"set:{setting}", f"vowels:{vowels}:{size}",
    ]


def token_features(token: str) -> list[str]:
    return trait_features(token_traits(token))


def neighbour_features(token: str, place: str) -> list[str]:
    """What a token shows about the one that it stands before or behind; an empty one is the end of the line."""
    low = token[:12].lower()
    return [f"{place}:{low}", f"{place}-start:{low[:4]}", f"{place}-kind:{_shape(token[:12])[:3]}"]


#: Neighbours that count, by their distance from the token.
PLACES = {-3: "before3", -2: "before2", -1: "before1", 1: "after1"}


def file_features(text: str) -> list[str]:
    marks = sum(text.count(c) for c in "={};")
    return [f"file-length:{int(math.log2(len(text) + 1))}", f"file-marks:{int(math.log2(1 + 1000 * marks / (len(text) + 1)))}"]


def window_features(tokens: list[str], shared: list[str]) -> list[list[str]]:
    """Features of every token of a line or a part of one."""
    at = lambda k: tokens[k] if 0 <= k < len(tokens) else ""
    return [
        [*token_features(t), *shared, *(f for d, place in PLACES.items() for f in neighbour_features(at(k + d), place))]
        for k, t in enumerate(tokens)
    ]


@dataclass
class Crf:
    """Weights per feature and label, and per pair of labels; a chain begins and ends outside."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(3)
        return np.array([sum((self.weights.get(f, zero) for f in names), zero) for names in features]).reshape(-1, 3)

    def _moves(self) -> np.ndarray:
        allowed = self.moves.copy()
        allowed[OUTSIDE, INSIDE] = -np.inf  # inside only follows begin or inside
        return allowed

    def viterbi(self, features: list[list[str]]) -> list[int]:
        """The best labels of one line."""
        return self.best_path(self.emissions(features))

    def best_path(self, scores: np.ndarray) -> list[int]:
        moves = self._moves()
        best, back = moves[OUTSIDE] + scores[0], []
        for row in scores[1:]:
            ways = best[:, None] + moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        labels = [int((best + moves[:, OUTSIDE]).argmax())]
        for row in reversed(back):
            labels.append(int(row[labels[-1]]))
        return labels[::-1]

    def _expected(self, features: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        return self.expected(self.emissions(features))

    def expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities at each token, and expected label pairs, by forward and backward sums."""
        moves, n = self._moves(), len(scores)

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, behind = np.empty((n, 3)), np.empty((n, 3))
        ahead[0] = moves[OUTSIDE] + scores[0]
        for k in range(1, n):
            ahead[k] = total(ahead[k - 1][:, None] + moves, 0) + scores[k]
        behind[-1] = moves[:, OUTSIDE]
        for k in range(n - 2, -1, -1):
            behind[k] = total(moves + (scores[k + 1] + behind[k + 1])[None, :], 1)
        whole = total(ahead[-1] + behind[-1], 0)
        single = np.exp(ahead + behind - whole)
        pairs = np.zeros((3, 3))
        pairs[OUTSIDE] += single[0]
        pairs[:, OUTSIDE] += single[-1]
        for k in range(1, n):
            pairs += np.exp(ahead[k - 1][:, None] + moves + (scores[k] + behind[k])[None, :] - whole)
        return single, pairs

    @classmethod
    def fit(cls, examples: list[tuple[list[list[str]], list[int]]]) -> Crf:
        """Maximum likelihood with a quadratic penalty, by adaptive gradient steps of a window each in a fixed order."""
        model = cls()
        names: dict[str, int] = {}
        # Every token of a window has as many features as the others.
        rows = [(np.array([[names.setdefault(f, len(names)) for f in fs] for fs in features]), labels) for features, labels in examples]
        weights, seen = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-6)
        moved = np.full((3, 3), 1e-6)
        for _ in range(EPOCHS):
            for places, labels in rows:
                single, pairs = model.expected(weights[places].sum(axis=1))
                slope = -single
                slope[np.arange(len(labels)), labels] += 1
                mine, back = np.unique(places, return_inverse=True)
                step = np.zeros((len(mine), 3))
                np.add.at(step, back.reshape(places.shape), slope[:, None, :])
                step -= PENALTY * weights[mine]
                seen[mine] += step * step
                weights[mine] += RATE * step / np.sqrt(seen[mine])
                path = [OUTSIDE, *labels, OUTSIDE]
                step = -pairs - PENALTY * model.moves
                np.add.at(step, (path[:-1], path[1:]), 1)
                moved += step * step
                model.moves += RATE * step / np.sqrt(moved)
        model.weights = {f: weights[k] for f, k in names.items()}
        return model


class Scorer:
    """Label scores of all tokens of a text; what a token adds to its own and its neighbours' is worked out once."""

    def __init__(self, model: Crf):
        self.model = model
        moves = model._moves()
        into = moves - moves[OUTSIDE, OUTSIDE]
        out = max(0.0, into[BEGIN, OUTSIDE], into[INSIDE, OUTSIDE])
        # The most that tagging a token can gain by the moves around it.
        self.gain = np.array([into[:, BEGIN].max() + out, into[:, INSIDE].max() + out])
        # What is left of a token's neighbour features, by word, start and kind: one array for all places.
        self.by_word: dict[str, np.ndarray] = {}
        for row, place in enumerate(PLACES.values()):
            for name, weight in model.weights.items():
                if name.startswith(place + ":"):
                    self.by_word.setdefault(name[len(place) + 1:], np.zeros((len(PLACES), 3)))[row] = weight
        # Starts that some place knows; all others add nothing.
        starts = tuple(f"{place}-start:" for place in PLACES.values())
        self.starts = {name.split(":", 1)[1] for name in model.weights if name.startswith(starts)}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((1 + len(PLACES), 1024, 3))
        # What begin and inside have ahead of outside in every row, for a quick look.
        self.leads = np.zeros((1024, 2 * (1 + len(PLACES))), dtype=np.float32)
        self.row_of("")

    def row_of(self, token: str) -> int:
        """Row of a token in the table, 0 for the end of a line; tokens that show the same have one row."""
        k = self.ids.get(token)
        if k is not None:
            return k
        low = token[:12].lower()
        traits = token_traits(token) if token else ()
        kind = traits[0][:3] if token and len(token) <= 12 else _shape(token[:12])[:3]
        shown = (traits, low[:4] if low[:4] in self.starts else None, kind, low if low in self.by_word else None)
        k = self.rows.get(shown)
        if k is None:
            k = self.rows[shown] = len(self.rows)
            if k == len(self.leads):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
                self.leads = np.concatenate((self.leads, np.zeros_like(self.leads)))
            if token:
                self.table[0, k] = self.model.emissions([trait_features(traits)])[0]
            self.table[1:, k] = self.model.emissions([neighbour_features(token, p)[1:] for p in PLACES.values()])
            if low in self.by_word:
                self.table[1:, k] += self.by_word[low]
            self.leads[k] = (self.table[:, k, 1:] - self.table[:, k, :1]).ravel()
        self.ids[token] = k
        if not token:
            self.ids["\n"] = k
        return k

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Rows of tokens; a line feed or an empty token is the end of a line."""
        if len(self.rows) > REMEMBERED:
            self.reset()
        elif len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.row_of("")
        found = list(map(self.ids.get, tokens))
        if None in found:
            found = [self.row_of(t) if k is None else k for k, t in zip(found, tokens)]
        return np.array(found, dtype=np.int64)

    def scores(self, lines: list[list[str]], shared: list[str]) -> np.ndarray:
        """Scores of the tokens of some lines, one after the other."""
        ids = self.numbers([t for line in lines for t in line])
        counts = np.array([len(line) for line in lines])
        line = np.repeat(np.arange(len(lines)), counts)
        out = self.table[0, ids] + self.model.emissions([shared])[0]
        for row, d in enumerate(PLACES, 1):
            other = np.zeros(len(ids), dtype=np.int64)
            here, there = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            other[here] = np.where(line[here] == line[there], ids[there], 0)
            out += self.table[row, other]
        return out

    def hopeless(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that no path can gain by tagging; where all of a line are, the best path is outside throughout."""
        return (scores[:, 1:] - scores[:, :1] + self.gain).max(axis=1) <= 0

    def promising(self, ids: np.ndarray, shared: list[str]) -> np.ndarray:
        """Places of the tokens that a path may gain by tagging; where a line has none, its best path is outside throughout.

        The sums are rounded to the side of looking again.
        """
        # So many empty tokens behind every line that no neighbour is looked for in another one.
        apart = max(map(abs, PLACES))
        wide = np.concatenate((np.zeros(apart, dtype=np.int64), np.repeat(ids, np.where(ids == 0, apart, 1)), np.zeros(apart, dtype=np.int64)))
        rows = self.leads.take(wide, axis=0)
        out = rows[apart:-apart, :2].copy()
        for row, d in enumerate(PLACES, 1):
            out += rows[apart + d:len(wide) - apart + d, 2 * row:2 * row + 2]
        own = self.model.emissions([shared])[0]
        most = (out + (own[1:] - own[0] + self.gain + ROUNDING).astype(np.float32)).max(axis=1)
        inner = wide[apart:-apart]
        places = np.flatnonzero((most > 0) & (inner != 0))
        # Back from the places among the wider ends of lines.
        return places - (apart - 1) * np.cumsum(inner == 0)[places] // apart if len(places) else places


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model: Crf) -> Scorer:
    """A worker's scorer of a model, kept from task to task; a new model takes the place of the last."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def _line_labels(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens of each line that has any, labelled by the values of the base matches."""
    values = [(value, end) for _, end, _, value in base_matches(text)]
    at = 0
    for line in text.split("\n"):
        tokens, labels = [], []
        for m in _TOKEN.finditer(line):
            start, end = at + m.start(), at + m.end()
            hit = any(a < end and start < b for a, b in values)
            labels.append(OUTSIDE if not hit else INSIDE if labels and labels[-1] != OUTSIDE else BEGIN)
            tokens.append(m.group())
        if tokens:
            yield tokens, labels
        at += len(line) + 1


def _windows(text: str) -> Iterator[tuple[list[str], list[int], list[str], int]]:
    """Tokens and labels of a text's lines in parts of FIT_TOKENS tokens, the file's features, and the kind of the part.

    Kind 0 holds a secret, 1 another token that is long or holds a digit, 2 neither.
    """
    shared = file_features(text)
    for tokens, labels in _line_labels(text):
        for at in range(0, len(tokens), FIT_TOKENS):
            part, tags = tokens[at:at + FIT_TOKENS], labels[at:at + FIT_TOKENS]
            if tags[0] == INSIDE:
                tags = [BEGIN, *tags[1:]]
            yield part, tags, shared, 0 if max(tags) else 1 if any(map(_ODD.search, part)) else 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = FIT_DOCS) -> Crf:
    """Learn from the base matches in about ``sample`` documents and what stands around them.

    Lines are cut into windows; at most ``FIT_WINDOWS`` with a secret, as many without one
    but with a token that is long or holds a digit, and as many others are used, chosen by
    hash. Without any secret the field tags nothing.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([w for text in batch["text"] for w in _windows(text)], columns=["tokens", "labels", "shared", "kind"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = checkpointed(
        fit_sample(rows, F.coalesce(F.col("id").cast("string"), F.lit("")), sample).select("text")
        .mapInPandas(label, "tokens array<string>, labels array<int>, shared array<string>, kind int")
        .withColumn("draw", F.xxhash64("tokens", "labels", "shared"))
        .withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("draw"))).where(F.col("place") <= FIT_WINDOWS)
    )
    examples = found.collect()
    if not any(r["kind"] == 0 for r in examples):
        return Crf()
    examples.sort(key=lambda r: (r["draw"], str(r["tokens"])))
    return Crf.fit([(window_features(r["tokens"], r["shared"]), r["labels"]) for r in examples])


def field_spans(text: str, scorer: Scorer) -> Iterator[tuple[int, int]]:
    """Spans that the field tags, line by line."""
    ids, shared = scorer.numbers(_TOKEN_OR_END.findall(text)), file_features(text)
    possible = scorer.promising(ids, shared)
    if not len(possible):
        return
    lines = text.split("\n")
    begins = np.cumsum([0, *(len(line) + 1 for line in lines)])
    for k in np.unique(np.searchsorted(np.flatnonzero(ids == 0), possible)).tolist():
        scores = scorer.scores([_TOKEN.findall(lines[k])], shared)
        if scorer.hopeless(scores).all():
            continue
        labels = scorer.model.best_path(scores)
        places = [m.span() for m in _TOKEN.finditer(lines[k])]
        at = 0
        while at < len(labels):
            if labels[at] != BEGIN:
                at += 1
                continue
            last = at
            while last + 1 < len(labels) and labels[last + 1] == INSIDE:
                last += 1
            yield int(begins[k]) + places[at][0], int(begins[k]) + places[last][1]
            at = last + 1


def find(text: str | None, scorer: Scorer | Crf) -> list[tuple[int, int, str]]:
    """All spans of a text as start, end and kind: base matches, and what the field adds beside them.

    Of a field span that base matches cover in part, the rest stays, less white space at its ends.
    """
    if isinstance(scorer, Crf):
        scorer = scorer_of(scorer)
    text = text or ""
    base = [(start, end, kind) for start, end, kind, _ in base_matches(text)]
    free = []
    # Covered places by start; of nested ones the farthest end so far counts.
    covered = sorted((a, b) for a, b, _ in base)
    for start, end in field_spans(text, scorer) if scorer.model.weights else ():
        at = start
        for a, b in covered:
            if b <= at:
                continue
            if a >= end:
                break
            free.append((at, a))
            at = max(at, b)
        free.append((at, end))
    added = []
    for start, end in free:
        piece = text[start:end]
        if piece.strip():
            added.append((start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip()), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(base + added, key=lambda s: (s[0], s[2]))]


def find_spans(text: Column, model: Crf) -> Column:
    """Spans of a text column as strings ``kind:start:end``, by start and kind."""

    @F.pandas_udf("array<string>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(model)
        for texts in parts:
            yield pd.Series([[f"{k}:{a}:{b}" for a, b, k in find(t, scorer)] for t in texts], dtype=object)

    return apply(text)


def redact(text: Column, model: Crf, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""

    def clean(t: str | None, scorer: Scorer) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for start, end, _ in find(t, scorer):
            if start >= at:
                out += [t[at:start], mark]
            at = max(at, end)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(model)
        for texts in parts:
            yield pd.Series([clean(t, scorer) for t in texts], dtype=object)

    return apply(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text.

    One row per input row: the id and ``spans``, an array of ``kind:start:end`` in
    code points. Null and empty texts have none; repeated rows repeat, other columns
    are ignored, an empty table gives no rows. The field's own spans are of kind
    ``crf`` and never overlap a base match.
    """
    model = fit(docs, id_col, text_col)
    return docs.select(F.col(id_col), find_spans(F.col(text_col), model).alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans joined."""
    base = F.filter("spans", lambda s: ~s.startswith("crf:"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.startswith(kind + ":"))).cast("long")

    return spans.select(
        *[c for c in spans.columns if c != "spans"],
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
