"""Top products, hard negatives and spelling groups against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruptura.llm import hard_negatives, spelling, top_products, vector_blocks
from ruptura.llm.vector_blocks import Block, integer_vectors


# --- vectors ------------------------------------------------------------------
def whole(rows, scale):
    """Integer vectors of (id, vector, label) rows by the stated rules; one row for each id."""
    held = {}
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        bound = 3.0e9 / math.sqrt(max(1, len(vector)))
        new = ([math.floor(max(-bound, min(bound, x * scale))) for x in vector], label)
        held[i] = min(held.get(i, new), new)
    return held


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, is_query, k=10, scale=1024):
    held = whole([(i, v, 0) for i, v, _ in rows], scale)
    out = set()
    for q in filter(is_query, held):
        best = sorted((-product(held[q][0], held[c][0]), c) for c in held if c != q)[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


def plain_negatives(rows, is_anchor, positives=5, negatives=5, scale=256):
    held = whole(rows, scale)
    out = set()
    for a in filter(is_anchor, held):
        scored = sorted((-product(held[a][0], held[c][0]), c) for c in held if c != a)
        for s, p in [(-s, c) for s, c in scored if held[c][1] == held[a][1]][:positives]:
            fit = [(-t, c) for t, c in scored if held[c][1] != held[a][1] and 80 * s <= -100 * t <= 100 * s][:negatives]
            out |= {(a, p, n + 1, c, s, t) for n, (t, c) in enumerate(fit)}
    return out


def drawn(kind, n=900, seed=5):
    """Rows (id, vector, label): even, of very different lengths, close to few directions, mostly copies, tiny integers."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 12)) * 0.2
    if kind == "lengths":
        x *= np.exp(draw.normal(size=(n, 1)) * 2)
    elif kind == "directions":
        x = draw.normal(size=(4, 12))[draw.integers(0, 4, n)] + x * 0.1
        x *= np.exp(draw.normal(size=(n, 1)) * 0.3)
    elif kind == "copies":
        x[: n // 2] = x[0]
    elif kind == "ties":
        x = np.round(x * 3) / 64
    return [(int(i) - 50, [float(v) for v in r], int(l)) for i, r, l in zip(range(n), x, draw.integers(0, 4, n))]


SCHEMA = "vec_id long, embedding array<double>, label int"
KINDS = ["even", "lengths", "directions", "copies", "ties"]


@pytest.fixture
def small_blocks(monkeypatch):
    """Several query blocks and clusters."""
    monkeypatch.setattr(top_products, "QUERY_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CLUSTER_ROWS", 20)


@pytest.mark.parametrize("kind", KINDS)
def test_top_products(spark, small_blocks, kind):
    rows = drawn(kind)
    got = top_products.top_products(spark.createDataFrame(rows, SCHEMA).repartition(6), F.col("vec_id") % 9 == 0)
    assert {tuple(r) for r in got.collect()} == plain_top(rows, lambda i: i % 9 == 0)


@pytest.mark.parametrize("kind", KINDS)
def test_hard_negatives(spark, small_blocks, kind):
    rows = drawn(kind)
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 9 == 0, F.col("label"))
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, lambda i: i % 9 == 0)


def test_shuffled_query_blocks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BROADCAST_BYTES", 0)
    rows = drawn("even", 400)
    table = spark.createDataFrame(rows, SCHEMA)
    got = top_products.top_products(table, F.col("vec_id") % 4 == 0, k=3)
    assert {tuple(r) for r in got.collect()} == plain_top(rows, lambda i: i % 4 == 0, 3)


def test_both_ways_to_prune_give_the_same():
    """Every bucket by length and by coordinates, at thresholds from loose to tight."""
    rows = whole(drawn("directions", 500), 1024)
    ids = np.array(sorted(rows))
    ints = np.array([rows[i][0] for i in ids])

    def block(at, needs):
        return Block({"rows": len(at), "ids": ids[at].tobytes(), "labels": (ids[at] * 0).tobytes(), "needs": needs.tobytes(), "ints": ints[at].astype(np.int64).tobytes(), "cluster": 0})

    asked, held = np.arange(0, 500, 7), np.arange(500)
    scores = ints[asked] @ ints.T
    for share in (0.5, 0.9, 0.99):
        needs = np.quantile(scores, share, axis=1).astype(np.int64)
        q, bucket = block(asked, needs[:, None]), block(held, held * 0)
        want = set()
        for row, s in enumerate(scores):
            best = sorted((-v, i) for v, i in zip(s, ids) if i != ids[asked[row]] and v >= needs[row])[:5]
            want |= {(row, i, -v) for v, i in best}
        active = np.arange(len(asked))
        reach = q.lengths * bucket.lengths.max()
        for prune in (
            lambda t: top_products._by_length(q, bucket, t, active),
            lambda t: top_products._by_coordinates(q, bucket, t, active, np.where(needs > 0, needs / reach, -1.0)),
        ):
            tops = vector_blocks.Tops(needs, 5, bucket.ids)
            prune(tops)
            assert {(r, int(ids[c]), int(s)) for r, c, s in zip(*tops.found())} == want


def awkward_vectors():
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25], 1), (1, None, 1), (2, [0.5, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (None, [1.0, 1.0], 1),
        (5, [1.0], 1), (6, [1.0, 2.0, 3.0], None), (7, [], 2), (8, [0.0, 0.0], 2), (9, [1e300, -1e300], 2), (10, [-1e300, 1e300], 1),
        (100, [0.5, -0.25], 1), (100, [0.5, -0.25], 1), (200, [0.5, -0.25], 1), (200, [0.25, -0.25], 1), (11, [0.5, -0.25], 2), (300, [0.0, 0.0], 1),
        (-100, [-0.5, 0.25], 1), (12, [0.5, -0.25], 2), (13, [0.45, -0.25], 2),
    ]
    return rows


def test_awkward_vectors(spark):
    rows = awkward_vectors()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("length", "ints", "key", "cluster", "score", "slot", "rank")})
    got = top_products.top_products(table, F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.collect()} == plain_top(rows, lambda i: i % 100 == 0)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, F.col("label"))
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows, lambda i: i % 100 == 0)
    for empty in (table.limit(0), table.where("vec_id = 5"), table.where("vec_id = 100")):
        assert top_products.top_products(empty, F.col("vec_id") % 100 == 0).count() == 0
        assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_components_are_held_where_a_score_fits_a_long(spark):
    rows = spark.createDataFrame([(1, [1e300] * 64, 0), (2, [-1e300] * 64, 0)], SCHEMA)
    held = {r["vec_id"]: r["ints"] for r in integer_vectors(rows, 1024).collect()}
    assert -(1 << 63) < product(held[1], held[2]) < product(held[1], held[1]) < 1 << 63


# --- spelling -------------------------------------------------------------------
def plain_groups(docs):
    counts = Counter()
    for i, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1:] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[k, w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for (k, rest), group in cut.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda o: (-words[o], o))
            if words[best] >= 10 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def test_spelling_groups(spark, documents):
    got = {tuple(r) for r in spelling.spelling_groups(documents).collect()}
    assert got == plain_groups([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert any(form for _, form, *_ in got)


def test_chains_ties_and_repeated_letters(spark):
    words = {"abcdefgh": 3000, "abcdefgx": 250, "abcdefyx": 20, "abcdezyx": 2, "aaaaaaa": 40, "aaaaaaaa": 4, "aaaaaaaaa": 4, "bananana": 3,
             "banananan": 30, "ananana": 30, "ßßñéàüö": 25, "ßßñéàü": 50, "ßßñéàüöÿ": 2, "qqqqqqq": 2, "qqqqqqp": 20, "qqqqqqo": 20}
    texts = [(1, "\n".join(" ".join([w] * n) for w, n in words.items())), (None, "ABCDEFGH abcdefgh À×÷" + "z" * 3000 + " " + "z" * 3000), (2, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "gram", "a", "b", "root")})
    assert {tuple(r) for r in spelling.spelling_groups(docs).collect()} == plain_groups(texts)
    assert spelling.spelling_groups(docs.limit(0)).count() == 0
    assert spelling.spelling_groups(docs.where("text is null or text = ''")).count() == 0


def test_spelling_of_awkward_rows(spark, awkward):
    got = {tuple(r) for r in spelling.spelling_groups(awkward).collect()}
    assert got == plain_groups([tuple(r) for r in awkward.select("doc_id", "text").collect()])


def test_cheapest_disjoint_grams():
    from itertools import combinations

    draw = np.random.default_rng(2)
    for _ in range(200):
        places = sorted(draw.choice(12, size=int(draw.integers(3, 8)), replace=False).tolist())
        grams = [(p, int(draw.integers(1, 9))) for p in places]
        for wanted in (1, 2, 3):
            fits = [sum(c for _, c in x) for x in combinations(grams, wanted) if all(b[0] - a[0] >= 2 for a, b in zip(x, x[1:]))]
            chosen = spelling.disjoint(grams, wanted)
            if fits:
                assert sum(dict(grams)[p] for p in chosen) == min(fits) and all(b - a >= 2 for a, b in zip(chosen, chosen[1:]))
