"""SimHash groups and components against brute force."""

import random
import re

import numpy as np
import xxhash

from ruptura.llm import simhash
from ruptura.llm.components import components


def plain_fingerprint(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, for ``{id: fingerprint}``."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_groups(spark, documents):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents.collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(prints)


def test_links_by_pairs_and_by_shared_neighbours(spark):
    draw = random.Random(3)
    prints = {}
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(25):
            value = centre
            for b in draw.sample(range(64), draw.randint(0, 4)):
                value ^= 1 << b
            prints.setdefault(value, len(prints))
    rows = [(v - (1 << 64) if v >> 63 else v, n) for v, n in prints.items()]
    table = spark.createDataFrame(rows, "fp long, node long")
    want = plain_components({n: v for v, n in prints.items()})
    for bucket in (1, 5, 1000):
        found = {r["node"]: r["component"] for r in components(simhash.links(table, bucket)).collect()}
        assert {n: found.get(n, n) for n in want} == want


def test_components_of_a_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (101, None)], "a long, b long")
    assert {(r[0], r[1]) for r in components(edges).collect()} == {(k, 0) for k in range(41)}
    assert components(edges.limit(0)).count() == 0


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[2, zero] == by[3, zero] == by[4, zero] == 2
    assert [c for (i, _), c in by.items() if i is None] == [None]
    assert {c for (i, _), c in by.items() if i == 6} == {1}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_near_copies_verify_few_pairs(spark, monkeypatch):
    stem = [f"w{k}" for k in range(400)]

    def varied(k, n):
        # n words of their own, far enough from each other that each changes five shingles.
        return " ".join(f"x{k}y{i}" if i % 10 == 5 and i < 10 * n else w for i, w in enumerate(stem))

    verified, whole = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: (verified.append(pairs.count()), whole(pairs, *rest))[1])
    # Similarities of 0.95 and 0.98 within a group of copies: a few meetings join them all.
    copies = spark.createDataFrame([(k, varied(k, 1 + k % 2)) for k in range(150)], "node long, text string")
    groups = components(simhash.near_copies(copies, 5, 80)).collect()
    assert {tuple(r) for r in groups} == {(k, 0) for k in range(150)}
    assert sum(verified) <= 3 * 150
    # Any two share 0.7 of their shingles and most share bands, but none is like another: nothing is left to verify.
    verified.clear()
    apart = spark.createDataFrame([(k, varied(k, 14)) for k in range(80)], "node long, text string")
    assert simhash.near_copies(apart, 5, 80).isEmpty()
    assert sum(verified) <= 10


def test_parity_sketches_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 4, 5, 40, 50, 900, 6000)]
    sets += [np.concatenate([x[:len(x) - d], rng.integers(0, 1 << 64, d + e, dtype=np.uint64)]) for x in sets for d in (0, len(x) // 10, len(x) // 9, len(x) // 5) for e in (0, len(x) // 10)]
    sets = [np.unique(x) for x in sets]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    sketches = spark.createDataFrame([(k, len(x), simhash._parities(x).tolist()) for k, x in enumerate(sets)], "node long, size long, bits array<long>")
    kept = {tuple(r) for r in simhash._possible(spark.createDataFrame(pairs, "a long, b long"), sketches, 80).collect()}
    alike = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(alike) > 20 and alike <= kept and len(kept) < len(pairs) / 4
