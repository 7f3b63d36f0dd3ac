"""Main text of HTML pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import fit_sample

#: Fitting bounds: about so many pages, and so many of the commonest features.
FIT_PAGES = 3000
FIT_FEATURES = 20_000
#: Weights before anything is learned, and the most a tag may score.
WORD, TAG, TAG_MOST = 1.0, -1.0, -0.01

# Element names of the HTML standard, by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math xmp".split())
NEVER = frozenset(
    "head nav aside footer form button select option label fieldset dialog menu object canvas audio video".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
FLOW = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th hr figure".split())
LABELLED = frozenset(("article", "main"))
#: Words in class and id names of parts that are never main text.
ROLES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "footer header masthead menu nav navbar navigation newsletter notice popup promo related share sharing sidebar "
    "social sponsor sponsored subscribe toolbar".split()
)
#: Words that say of a page what it holds or lacks: the rest of such a name (has-sidebar, no-comments) is no role.
ABOUT = frozenset("has have with without no not hide hidden show is".split())
#: Form elements that may wrap a whole page; they do if they hold most of its words, and at least so many.
WRAPPERS = frozenset(("form", "fieldset"))
LEAST_WRAPPED = 50
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE) for name in RAW}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z0-9]+")


def _tag_end(page: str, at: int) -> int:
    """Index after the tag that begins at ``at``; a quote that is never closed doesn't hide its end."""
    first = page.find(">", at)
    if first < 0:
        return len(page)
    end, k = first, at
    while True:
        quotes = [q for q in (page.find('"', k, end), page.find("'", k, end)) if q >= 0]
        if not quotes:
            return end + 1
        q = min(quotes)
        close = page.find(page[q], q + 1)
        if close < 0:
            return first + 1
        k = close + 1
        if k > end:
            end = page.find(">", k)
            if end < 0:
                return first + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Pieces of a page as (kind, name, data): ``text``, ``open`` and ``close``.

    Comments, declarations and the content of raw elements are left out.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        following = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            piece, end = None, page.find("-->", lt + 4)
            end = n if end < 0 else end + 3
        elif following and following in "!?":
            piece, end = None, page.find(">", lt)
            end = n if end < 0 else end + 1
        elif name := _NAME.match(page, lt + (2 if following == "/" else 1)):
            end = _tag_end(page, lt)
            kind = "close" if following == "/" else "open"
            piece = kind, name.group().lower(), page[name.end():end - 1] if kind == "open" else ""
        else:  # a bare sign is text
            yield "text", "", page[at:lt + 1]
            at = lt + 1
            continue
        if lt > at:
            yield "text", "", page[at:lt]
        at = end
        if piece is None:
            continue
        yield piece
        kind, name, data = piece
        if kind == "open" and name in RAW and not data.endswith("/"):
            close = _CLOSERS[name].search(page, at)
            at = _tag_end(page, close.start()) if close else n
            yield "close", name, ""


def _roles(attributes: str) -> list[str]:
    """Words of the class, id and role values, in order; a name's words end where it begins to speak about something else."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            for word in map(str.lower, _WORDS.findall(name)):
                if word in ABOUT:
                    break
                out.append(word)
    return out


class _Stack:
    """Open elements: the part of the page that words are in, and whether that part is never main text.

    A part is left out below an element that is never main text, or below one whose role
    says so. ``main`` begins anew inside any of them, ``article`` inside a form. A form
    that holds most of the page's words is the page, not a part of it.
    """

    def __init__(self, wrapped: frozenset[int] = frozenset()):
        # name, part, left out, left out because of a form only, inside a marked article
        self.open: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
        self.places: dict[str, list[int]] = {}  # of the open elements, by name
        self.wrapped, self.forms = wrapped, 0

    def push(self, name: str, attributes: str) -> str:
        roles = _roles(attributes)
        key = ".".join([name, *roles[:1]])
        _, part, never, by_form, labelled = self.open[-1]
        wrapper = name in WRAPPERS
        if wrapper:
            self.forms += 1
        if name == "main" or name == "article" and by_form:
            never = by_form = False
        role = any(r in ROLES for r in roles) and name not in ("html", "body", *LABELLED)
        role = role or (name in NEVER and not wrapper) or name in RAW or name == "header" and not labelled
        form = wrapper and self.forms - 1 not in self.wrapped
        if name not in VOID and not attributes.endswith("/"):
            self.places.setdefault(name, []).append(len(self.open))
            left_out = never or role or form
            only_form = left_out and not role and (by_form or form and not never)
            self.open.append((name, part if name in FLOW and not roles else key, left_out, only_form, labelled or name in LABELLED))
        return key

    def pop(self, name: str) -> str:
        if not self.places.get(name):
            return "/" + name
        k = self.places[name][-1]
        key = self.open[k][1]
        for inner, *_ in self.open[k:]:
            self.places[inner].pop()
        del self.open[k:]
        return "/" + (key if key.split(".")[0] == name else name)

    @property
    def part(self) -> str:
        return self.open[-1][1]

    @property
    def never(self) -> bool:
        return self.open[-1][2]

    @property
    def labelled(self) -> bool:
        return self.open[-1][4]


def _wrapping_forms(pieces: list[tuple[str, str, str]]) -> frozenset[int]:
    """Numbers of the forms that hold most of the page's words and at least LEAST_WRAPPED of them."""
    held: list[int] = []
    open_: list[tuple[str, int]] = []
    total = 0
    for kind, name, data in pieces:
        if kind == "text":
            words = len(data.split())
            total += words
            for _, k in open_:
                held[k] += words
        elif name in WRAPPERS and kind == "open":
            open_.append((name, len(held)))
            held.append(0)
        elif name in WRAPPERS:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                del open_[at:]
    return frozenset(k for k, words in enumerate(held) if words >= LEAST_WRAPPED and 2 * words > total)


def _pieces(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """Kind, feature, data, never and labelled of each piece; data is text or the tag's name."""
    found = list(tokens(page))
    stack = _Stack(_wrapping_forms(found))
    for kind, name, data in found:
        if kind == "text":
            yield kind, "word " + stack.part, data, stack.never, stack.labelled
            continue
        inside = stack.labelled
        key = stack.push(name, data) if kind == "open" else stack.pop(name)
        yield kind, "tag " + key, name, stack.never, inside and stack.labelled


def count_features(page: str | None) -> Counter:
    """How often each feature is inside and outside the marked article of a labelled page."""
    counts: Counter = Counter()
    for kind, feature, data, never, labelled in _pieces(page or ""):
        weight = len(data.split()) if kind == "text" else 1
        if weight:
            counts[feature, labelled and not never] += weight
    return counts


class Weights:
    """Scores of words by the part they are in, and of tags."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        total = {
            kind: [1 + sum(r[k] for r in counts if r[0].startswith(kind)) for k in (1, 2)] for kind in ("word", "tag")
        }
        self.of: dict[str, float] = {}
        for feature, inside, outside in counts:
            a, b = total[feature.split(" ")[0]]
            self.of[feature] = math.log((inside + 0.5) / a) - math.log((outside + 0.5) / b)

    def score(self, kind: str, feature: str, never: bool) -> float:
        """Words score what was learned of their part, tags less than 0; a part that is left out anyway doesn't count."""
        if never:
            return 0.0
        return self.of.get(feature, WORD) if kind == "text" else min(self.of.get(feature, TAG), TAG_MOST)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest positive sum; the first of equal ones; (0, 0) if none."""
    best, low, now, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if now <= 0:
            now, start = 0.0, k
        now += x
        if now > best:
            best, low = now, (start, k + 1)
    return low


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, joined by two line feeds."""
    pieces = list(_pieces(page or ""))
    scores = []
    for kind, feature, data, never, _ in pieces:
        one = weights.score(kind, feature, never)
        scores.append(one * len(data.split()) if kind == "text" else one)
    start, end = best_run(scores)
    blocks, block = [], []
    for (kind, _, data, never, _), score in zip(pieces[start:end], scores[start:end]):
        if kind == "text":
            if not never and score >= 0:
                block.append(data)
        elif data not in INLINE:
            blocks.append("".join(block))
            block = []
        elif data == "br":
            block.append(" ")
    blocks.append("".join(block))
    blocks = [" ".join(html.unescape(b).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def fit(pages: DataFrame, html_col: str = "html", url_col: str = "url", sample: int = FIT_PAGES) -> Weights:
    """Learn weights from about ``sample`` pages that mark their article with an element of that name.

    Without such pages every word scores 1 and every tag -1.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(count_features(page))
            yield pd.DataFrame([(f, i, n) for (f, i), n in total.items()], columns=["feature", "inside", "n"])

    labelled = pages.select(F.col(html_col).alias("html"), F.col(url_col).alias("url")).where("html rlike '(?i)<(article|main)[\\\\s>]'")
    sampled = fit_sample(labelled, F.coalesce(F.col("url").cast("string"), F.lit("")), sample)
    rows = (
        sampled.select("html").mapInPandas(count, "feature string, inside boolean, n long").groupBy("feature")
        .agg(F.sum(F.expr("if(inside, n, 0)")).alias("a"), F.sum(F.expr("if(inside, 0, n)")).alias("b"))
        .orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(FIT_FEATURES).collect()
    )
    return Weights([tuple(r) for r in rows])


def extract(html_col: Column, weights: Weights) -> Column:
    """Main text of a column of pages."""

    @F.pandas_udf("string")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return apply(html_col)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page.

    One row per input row: id, url, ``text`` and ``n_chars``. Null, empty and wordless
    pages give an empty text; repeated rows repeat, other columns are ignored, an
    empty table gives no rows. Among equally good regions the first is taken.
    """
    weights = fit(pages, html_col, url_col)
    return pages.select(F.col(id_col), F.col(url_col), extract(F.col(html_col), weights).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
