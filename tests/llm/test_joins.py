"""Containment, repeats, URLs and the pipeline against brute force."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ruptura.llm import bpe, decontaminate, langid, secrets, simhash, substrings, urls
from ruptura.llm.common import draw_limit, fit_sample
from test_groups import plain_components, plain_fingerprint


# --- benchmark containment ---------------------------------------------------
def shingles(text, size=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_contained(docs, items):
    sought = {i: shingles(t) for i, t in items if i is not None}
    held = {}
    for i, t in docs:
        held.setdefault(i, set()).update(shingles(t))
    return {
        (d, i, len(s & x), len(s)) for d, x in held.items() if d is not None for i, s in sought.items()
        if s and len(s & x) * 100 >= 80 * len(s)
    }


def test_contained_items(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_contained([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    for rows in (0, 10_000):
        assert {tuple(r) for r in decontaminate.contained_items(documents, items, broadcast_rows=rows).collect()} == want


def test_partial_and_awkward_items(spark, awkward):
    words = [f"w{k}" for k in range(60)]
    texts = [(k, "intro words here " + " ".join(words[:60 - k]) + " and an end") for k in range(0, 40, 2)] + [(None, "a b")]
    texts += [(200, "The CAT, sat"), (201, ""), (202, None)]
    items = [(1, " ".join(words)), (2, ""), (3, None), (4, "the cat sat"), (None, "a b"), (5, " ".join(words[:9] * 7))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"shingle": F.lit(1), "hash": F.lit(2), "item_id": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {tuple(r) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == plain_contained(texts, items) and (200, 4, 1, 1) in got
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0
    assert decontaminate.contained_items(awkward, bench.limit(0)).count() == 0


# --- repeated byte strings ---------------------------------------------------
def plain_repeats(rows, depth=100):
    """Digest columns for ``(id, bytes)`` rows with distinct ids."""
    first, out = {}, {}
    for i, data in sorted(rows):
        covered = bytearray(len(data))
        for s in range(len(data) - depth + 1):
            if first.setdefault(data[s:s + depth], (i, s)) != (i, s):
                covered[s:s + depth] = b"\1" * depth
        kept = bytes(x for x, c in zip(data, covered) if not c)
        out[i] = (len(data), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def test_removed_bytes(spark, documents):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()]
    got = {r[0]: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(documents)).collect()}
    assert got == plain_repeats(rows)


def test_hot_passages(spark):
    passage = "a passage that very many documents share, é and so on, " * 3
    texts = [(k, f"own start {k * 7919} {passage}{'x' * (k % 5)} own end {k * 104729}") for k in range(60)]
    texts += [(100, "ab" * 400), (101, "z" * 99), (102, "z" * 100), (103, "z" * 300), (104, None), (105, passage)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"id": F.lit(1), "digit": F.lit(2)})
    want = plain_repeats([(i, (t or "").encode()) for i, t in texts])
    assert {r[0]: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(docs)).collect()} == want


def test_one_digit_in_very_many_contexts(spark):
    """Rows that share 32 bytes, and from none to all of the bytes around them."""
    draw = __import__("random").Random(4)
    core = "0123456789abcdefghijklmnopqrstuv"
    pieces = ["".join(draw.choice("xy") for _ in range(80)) for _ in range(12)]
    texts = [(k, draw.choice(pieces)[draw.randrange(60):] + draw.choice(pieces) + core + draw.choice(pieces) + str(k)) for k in range(700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(docs)).collect()}
    assert got == plain_repeats([(i, t.encode()) for i, t in texts]) and sum(r[1] for r in got.values())


def test_other_depths(spark):
    draw = __import__("random").Random(9)
    texts = [(k, "".join(draw.choice("ab") for _ in range(draw.randrange(90)))) for k in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for depth, digit in ((10, 9), (12, 4), (7, 7)):
        got = {r[0]: tuple(r)[1:] for r in substrings.digests(substrings.remove_repeats(docs, depth=depth, digit=digit)).collect()}
        assert got == plain_repeats([(i, t.encode()) for i, t in texts], depth)


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    substrings._powers.cache_clear()
    import numpy as np

    text = " ".join(str(k * k) for k in range(3000))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    spans = [(a, b) for _, first, last, _ in substrings.anchors(data) for a, b in zip(first, last)]
    assert [x for a, b in spans for x in range(a, b + 1)] == list(range(len(data) - 99))
    substrings._powers.cache_clear()


def test_repeats_in_awkward_rows(awkward):
    rows = substrings.digests(substrings.remove_repeats(awkward)).collect()
    assert len(rows) == awkward.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (None, 2, 3, 4, 8))
    assert substrings.remove_repeats(awkward.limit(0)).count() == 0


def test_repeated_rows_and_texts_that_share_an_id(spark):
    passage = "a passage that several documents share, é and so on, " * 4
    own = [" ".join(str(k * n) for k in range(400)) for n in (7919, 104729, 1299709)]
    texts = [(1, f"{own[0]} {passage} {own[1]}")] * 3 + [(2, f"start {passage} end")] * 2
    texts += [(3, own[1] + passage), (3, passage + own[2] * 2), (3, "short"), (4, own[2]), (4, own[2]), (5, passage)]
    for rows in (texts, texts[:5]):
        distinct = sorted({(i, t.encode()) for i, t in rows}, key=lambda r: (r[0], _signed(xxhash.xxh64_intdigest(r[1], 42))))
        plain = plain_repeats([(k, t) for k, (_, t) in enumerate(distinct)])
        want = Counter((i, *plain[distinct.index((i, t.encode()))]) for i, t in rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(tuple(r) for r in substrings.digests(substrings.remove_repeats(docs)).collect()) == want


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


# --- URLs --------------------------------------------------------------------
def plain_rule(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def plain_scores(train, sought):
    """Mean log ratios by recursive Witten-Bell interpolation."""
    counts = {c: Counter() for c in (True, False)}
    for url, accepted in train:
        text = urls._PAD * urls.ORDER + url.lower() + urls._END
        for k in range(urls.ORDER, len(text)):
            for n in range(urls.ORDER + 1):
                counts[accepted][text[k - n:k], text[k]] += 1
    totals = {c: {} for c in counts}
    for c, own in counts.items():
        for (context, _), n in own.items():
            total = totals[c].setdefault(context, [0, 0])
            total[0] += n
            total[1] += 1

    def chance(c, context, char, n):
        shorter = chance(c, context, char, n - 1) if n else urls.UNIFORM
        tail = context[len(context) - n:]
        if tail not in totals[c]:
            return shorter
        total, kinds = totals[c][tail]
        return (counts[c][tail, char] + kinds * shorter) / (total + kinds)

    out = {}
    for url in sought:
        text = urls._PAD * urls.ORDER + url.lower() + urls._END
        logs = [
            math.log(chance(True, text[k - urls.ORDER:k], text[k], urls.ORDER)) - math.log(chance(False, text[k - urls.ORDER:k], text[k], urls.ORDER))
            for k in range(urls.ORDER, len(text))
        ]
        out[url] = sum(logs) / len(logs)
    return out


def test_rules_and_models(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r["page_id"]: r for r in urls.judge(pages).collect()}
    sought = set()
    for page in pages.collect():
        host, path, rule, verdict = plain_rule(page["url"])
        r = rows[page["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
        sought |= {page["url"]} if rule is None else set()
    labelled = [(p["url"], plain_rule(p["url"])[3] == "allow") for p in pages.collect() if plain_rule(p["url"])[3]]
    train = spark.createDataFrame(sorted(set(labelled)), "url string, accepted boolean")
    model = urls.fit(train)
    apart = {r["url"] for r in train.where(F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(urls.FOLDS)) == 0).collect()}
    want = plain_scores(sorted({x for x in labelled if x[0] not in apart}), sought)
    for r in rows.values():
        if r["rule"] is None:
            url = next(p["url"] for p in pages.collect() if p["page_id"] == r["page_id"])
            assert abs(r["score"] - want[url]) < 1e-9 and r["verdict"] == ("allow" if r["score"] >= model.threshold else "block")


def test_awkward_urls(spark):
    texts = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x", "http://com/", "http://com", "x://net/es/a#b", "a://b://c.com/", "http://xcom/", "a\nb://c.net/fr/"]
    pages = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(0, None, 1, 2)], "page_id long, url string, id int, gram int")
    got = urls.judge(pages).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        host, path, rule, verdict = plain_rule(texts[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict in (None, r["verdict"])
    assert urls.judge(pages.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------
def five_word_sets(texts):
    out = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def plain_copies(texts):
    """Smallest id reachable over fingerprints within two bits or sets with a Jaccard similarity of 0.8, all pairs tried."""
    label = plain_components({i: plain_fingerprint(t, 5) for i, t in texts.items()})
    sets = five_word_sets(texts)
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in [*edges, *label.items()]:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def test_near_copies_of_many_kinds(spark):
    """Texts with one to many words changed, a chain of copies of copies, a large group, short texts."""
    draw = __import__("random").Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts, n = {}, 0
    for length in (6, 30, 200, 1200):
        for share in (0, 0.005, 0.01, 0.02, 0.04, 0.1, 0.5):
            words = [word() for _ in range(length)]
            texts[n] = " ".join(words)
            texts[n + 1] = " ".join(word() if draw.random() < share else w for w in words)
            n += 2
    chain = [word() for _ in range(300)]
    for k in range(12):
        chain[20 * k:20 * k + 4] = [word() for _ in range(4)]
        texts[n] = " ".join(chain)
        n += 1
    group = [word() for _ in range(100)]
    for _ in range(60):
        texts[n] = " ".join(word() if draw.random() < 0.01 else w for w in group)
        n += 1
    texts |= {n: "", n + 1: None, n + 2: "one two", n + 3: "ONE two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, size=5, similarity=80).collect()}
    assert got == plain_copies(texts)


def test_near_copies_in_bands_full_of_others(spark):
    """Pairs at 0.81 among texts that share 0.79 with every other: nearly all bands of a pair hold many others."""
    draw = __import__("random").Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    common = [word() for _ in range(884)]
    texts = {}
    for k in range(24):
        own = [word() for _ in range(12)]
        texts |= {k + 100 * j: " ".join([*common, *own, *(word() for _ in range(108))]) for j in range(2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, size=5, similarity=80).collect()}
    assert got == plain_copies(texts) == {i: i % 100 for i in texts}


def test_near_copies_of_texts_with_one_fingerprint(spark, monkeypatch):
    """Of texts with the same fingerprint each can have a near copy of its own."""
    draw = __import__("random").Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    one, two = ([word() for _ in range(60)] for _ in range(2))
    texts = {1: " ".join(one), 2: " ".join(two), 3: " ".join([*two, word()]), 4: " ".join([*one, word()])}
    monkeypatch.setattr(simhash, "fingerprint_column", lambda text, size: F.when(
        text.isin(texts[1], texts[2]), F.lit(0)).when(text == texts[3], F.lit(0xFF)).otherwise(F.lit(0xFF00)).cast("long"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, size=5, similarity=80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_pipeline_against_plain_stages(spark, sf, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = langid.fit(documents)
    kept = {i: t for i, t in rows.items() if (g := model.predict(t))[0] != "und" and g[1] >= corpus_pipeline.LEAST_SCORE}
    groups = plain_copies(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = {d for d, *_ in plain_contained(kept.items(), items)}
    kept = {i: t for i, t in kept.items() if i not in found}
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    field = secrets.fit(left)

    def redacted(text):
        for a, b, _ in reversed(secrets.find(text, field)):
            if "\0" not in text[a:b]:
                text = text[:a] + "\0" * (b - a) + text[b:]
        return re.sub("\0+", "[SECRET]", text)

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = {}
    for i, t in kept.items():
        ids = encoding.encode_ordinary(redacted(t))
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(redacted(t).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_on_awkward_rows(spark, awkward, sf):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns)
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert out.count() > 0
    deduped = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    left = Counter(r["doc_id"] for r in deduped.collect())
    assert left[8] == 1 and left[9] == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_url_models_by_shuffle_joins(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").limit(40)
    by_broadcast = {r["page_id"]: (r["verdict"], r["score"] and round(r["score"], 9)) for r in urls.judge(pages).collect()}
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert {r["page_id"]: (r["verdict"], r["score"] and round(r["score"], 9)) for r in urls.judge(pages).collect()} == by_broadcast


def test_fitting_samples_at_any_size(spark):
    rows = spark.range(20_000)
    assert 800 <= fit_sample(rows, F.col("id"), 1000).count() <= 1200
    assert fit_sample(rows, F.col("id"), 20_000).count() == 20_000
    # Tables of 10^11 rows still give about the bound.
    for total in (10**6, 10**9, 10**11):
        share = (draw_limit(8000, total) + (1 << 63)) / (1 << 64)
        assert abs(share * total - 8000) < 1
