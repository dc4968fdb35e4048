"""The main body of a page.

Lines are scored by a linear model over their words and form, positive for the text of the post
and negative for what surrounds it.  The labels it learns from come from the data: what stands on
the pages of many posts and in no text that is known to be clean is the site's, a line that is the
title of another post with something around it is a link, and clean lines are text.  A linear scan
then takes the regions with the largest total score.  One region would also take in what the site
puts into the post, so the scan looks for the best set of regions, of which each but the first
costs ``REGION_COST``: a break as strong as that is cut out, a weaker one is bridged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
REGION_COST = 3.0
#: In how many posts a line has to stand to be taken for the site's.
LEAST_POSTS = 5
#: Labelled rows that are fitted on at most: lines of the site and clean lines (those of the most posts, and as many
#: clean ones with the smallest hashes), rare lines among which links are looked for, and pages whose lines the first
#: model labels (smallest hashes).
MOST_AROUND, MOST_CLEAN, MOST_RARE, MOST_PAGES = 6_000, 6_000, 10_000, 2_000
#: Words before and after the title in a line that links to a post, and the shortest title.
BEFORE, AFTER, LEAST_TITLE = 3, 2, 8
#: A line that is text by its form alone; only used where no clean texts are given.
LONG_LINE = 45
#: The most one line can say for or against being text.
LIMIT = 6.0

_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")


def shape(line: str) -> str:
    """The line with single blanks and every number as 0."""
    return _DIGITS.sub("0", " ".join(line.split()))


def shaped(line: Column) -> Column:
    """:func:`shape` as an expression."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"(?U)\d+", "0"))


@lru_cache(maxsize=60_000)
def features(line: str) -> tuple[int, ...]:
    """Hashed features of a shaped line: tokens, pairs, beginnings and ends of words, form."""
    tokens = _TOKEN.findall(line.lower())
    words = [t for t in tokens if t[0].isalnum()]
    found = {f"t{t}" for t in tokens}
    found.update(f"p{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))
    found.update(f"e{w[-2:]}" for w in words)
    found.add(f"first {tokens[0] if tokens else ''}")
    found.add(f"two {' '.join(tokens[:2])}")
    found.add(f"last {' '.join(tokens[-2:])}")
    size = len(line)
    found.add(f"size {min(size // 8, 8)}")
    found.add(f"words {min(len(words), 9)}")
    found.add(f"ends {line[-1:] if line[-1:] in '.?!])' else 'open'}")
    if size >= LONG_LINE and line[-1:] in ".?!":
        found.add("sentence")
    return tuple(crc32(f.encode()) & ((1 << BITS) - 1) for f in sorted(found))


@dataclass
class LineModel:
    weights: np.ndarray
    bias: float

    def score(self, line: str) -> float:
        """Positive for text of the post, negative for what surrounds it."""
        picked = self.weights[list(features(line))]
        return float(np.clip(picked.sum() + self.bias, -LIMIT, LIMIT))


@dataclass
class Labels:
    """Shaped lines: the site's and text with the number of posts they stand in, and links; and pages without labels."""

    around: dict[str, int]
    links: list[str]
    text: dict[str, int]
    pages: list[list[str]] = field(default_factory=list)


def _half(line: str) -> int:
    return crc32(line.encode()) // 7 % 2


def train(labels: Labels) -> LineModel:
    """Weights from labels that may be wrong.

    A line of the site whose words speak for text, by the model of the other half of these lines, and that
    mostly stands between two lines of text on the pages, is no label.  The model is then fitted once more
    with the lines of the pages as the linear scan divides them.
    """
    text = [(s, 1.0, float(np.log2(2 + n))) for s, n in labels.text.items()]
    links = [(s, 0.0, 1.0) for s in labels.links]
    around = [(s, 0.0, float(np.log2(1 + n))) for s, n in labels.around.items()]
    if not text or not around:
        return _fit(text + links + around)
    wrong: set[str] = set()
    for half in (0, 1):
        model = _fit([a for a in around if _half(a[0]) != half] + links + text, steps=100)
        doubted = {s for s, _, _ in around if _half(s) == half and model.score(s) > 0}
        between: dict[str, list[bool]] = defaultdict(list)
        for page in labels.pages:
            for i, s in enumerate(page):
                if s in doubted:
                    between[s].append(0 < i < len(page) - 1 and model.score(page[i - 1]) > 0 and model.score(page[i + 1]) > 0)
        wrong.update(s for s in doubted if not between[s] or sum(between[s]) * 2 > len(between[s]))
    sure = [a for a in around if a[0] not in wrong] + links + text
    first = _fit(sure)
    known = {s for s, _, _ in sure}
    said: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for page in labels.pages:
        for s, kept in zip(page, best_regions([first.score(s) for s in page]), strict=True):
            if s not in known:
                said[s][kept] += 1
    return _fit(sure + [(s, float(inside > outside), 1.0) for s, (outside, inside) in said.items() if inside != outside])


def _fit(examples: list[tuple[str, float, float]], steps: int = 200, speed: float = 0.3) -> LineModel:
    """Logistic regression; both labels weigh the same in all.  Without both labels every line is text."""
    if len({y for _, y, _ in examples}) < 2:
        return LineModel(np.zeros(1 << BITS), 1.0)
    lists = [np.array(features(line)) for line, _, _ in examples]
    y, weight = np.array([e[1] for e in examples]), np.array([e[2] for e in examples])
    for label in (0.0, 1.0):
        weight[y == label] /= weight[y == label].sum() * 2
    used, columns = np.unique(np.concatenate(lists), return_inverse=True)
    rows = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    dim = len(used)
    w, b, squares, square = np.zeros(dim), 0.0, np.full(dim, 1e-10), 1e-10
    for _ in range(steps):
        margin = np.bincount(rows, weights=w[columns], minlength=len(lists)) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        grad = np.bincount(columns, weights=error[rows], minlength=dim) + 1e-6 * w
        squares += grad**2
        square += error.sum() ** 2
        w -= speed * grad / np.sqrt(squares)
        b -= speed * error.sum() / np.sqrt(square)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return LineModel(weights, b)


def best_regions(scores: list[float], cost: float = REGION_COST) -> list[bool]:
    """Which lines belong to the set of regions with the largest total score.

    One scan with two states keeps the best total that ends inside or outside of a region;
    every region after the first costs ``cost``.  Ties leave a line out.
    """
    back: list[tuple[str, str, str]] = []
    # States: n none yet, i inside a region, o outside after one.
    none = 0.0
    inside, outside = float("-inf"), float("-inf")
    for s in scores:
        from_none, from_inside, from_outside = none + s, inside + s, outside - cost + s
        to_inside = max(from_none, from_inside, from_outside)
        origin = "i" if to_inside == from_inside else "n" if to_inside == from_none else "o"
        to_outside = max(outside, inside)
        back.append(("n", origin, "o" if to_outside == outside else "i"))
        inside, outside = to_inside, to_outside
    best = max(none, inside, outside)
    state = "n" if best == none else "o" if best == outside else "i"
    keep = [False] * len(scores)
    for k in range(len(scores) - 1, -1, -1):
        keep[k] = state == "i"
        state = back[k]["nio".index(state)]
    return keep


def _lines(rows: DataFrame, column: str, post: Column) -> DataFrame:
    """``(line, post)``: the shaped lines of every text, each once a text."""
    split = F.array_distinct(F.transform(F.split(F.col(column), "\n"), shaped))
    return rows.where(F.col(column).isNotNull()).select(F.explode(split).alias("line"), post.alias("post")).where(F.col("line") != "")


def line_statistics(posts: DataFrame, content: str, key: str, clean: DataFrame | None, text: str) -> DataFrame:
    """``(h, posts, low, high, clean)`` of every line, by the hash of its shape, over all pages and all clean texts.

    ``posts`` counts the posts a line stands in, ``low`` and ``high`` are the smallest and largest of their hashes,
    ``clean`` says whether a clean text has the line.  Only hashes are shuffled, and pairs of line and post are
    counted in each task first, so a line that stands on every page is no hot key.
    """
    pairs = _lines(posts, content, F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))).select(F.xxhash64("line").alias("h"), "post")
    if clean is not None:
        pairs = pairs.unionByName(_lines(clean, text, F.lit(None).cast("long")).select(F.xxhash64("line").alias("h"), "post"))
    once = pairs.groupBy("h", "post").agg(F.lit(1).alias("one"))
    return once.groupBy("h").agg(F.count("post").alias("posts"), F.min("post").alias("low"), F.max("post").alias("high"), F.bool_or(F.col("post").isNull()).alias("clean"))


def _titles_in(line: str) -> list[str]:
    """What could be a title in a line that has something before or behind it."""
    words = line.split()
    cuts = [(a, b) for a in range(BEFORE + 1) for b in range(AFTER + 1) if 0 < a + b < len(words)]
    return [t for a, b in cuts if len(t := " ".join(words[a : len(words) - b])) >= LEAST_TITLE]


def _spark_hash(text: str) -> int:
    """``F.xxhash64`` of a string."""
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def learn_labels(posts: DataFrame, content: str = "content", title: str = "title", key: str = "post_no", clean: DataFrame | None = None, text: str = "text") -> Labels:
    """Labelled lines from the pages, their titles and texts known to be clean.

    Counts cover all rows; of the lines they label, bounded samples are taken.  Without clean
    texts, long lines that end like a sentence and stand in one post only are text.
    """
    spark = posts.sparkSession
    counted = line_statistics(posts, content, key, clean, text).persist()
    try:
        first = lambda rows, most, *order: [tuple(r) for r in rows.select("h", "posts", "low", "high").orderBy(*order, "h").limit(most).collect()]
        often = F.col("posts") >= LEAST_POSTS
        around = first(counted.where(often & ~F.col("clean")), MOST_AROUND, F.col("posts").desc())
        common = first(counted.where(often & F.col("clean")), MOST_CLEAN // 2, F.col("posts").desc())
        known = first(counted.where(F.col("clean")), MOST_CLEAN)
        rare = first(counted.where(~often & ~F.col("clean")), MOST_RARE)
    finally:
        counted.unpersist()
    wanted = spark.createDataFrame(sorted({(r[0],) for r in (*around, *common, *known, *rare)}), "h long")
    lines = _lines(posts, content, F.lit(None).cast("long"))
    if clean is not None:
        lines = lines.unionByName(_lines(clean, text, F.lit(None).cast("long")))
    found = lines.select(F.xxhash64("line").alias("h"), "line").join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("line").alias("line"))
    name = {r["h"]: r["line"] for r in found.collect()}

    parts = {name[h]: (low, high, [_spark_hash(t) for t in _titles_in(name[h])]) for h, _, low, high in rare}
    asked = spark.createDataFrame(sorted({(t,) for _, _, ts in parts.values() for t in ts}), "t long")
    titles = posts.where(F.col(title).isNotNull()).select(F.xxhash64(shaped(F.col(title))).alias("t"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("post"))
    owners = {r["t"]: (r["low"], r["high"]) for r in titles.join(F.broadcast(asked), "t").groupBy("t").agg(F.min("post").alias("low"), F.max("post").alias("high")).collect()}
    links = [line for line, (low, high, ts) in parts.items() if any(t in owners and owners[t] != (low, high) for t in ts)]

    pages = posts.where(F.length(content) > 0).select(F.xxhash64(content).alias("h")).distinct().orderBy("h").limit(MOST_PAGES)
    texts = posts.select(F.col(content).alias("c"), F.xxhash64(content).alias("h")).join(F.broadcast(pages), "h").groupBy("h").agg(F.min("c").alias("c")).orderBy("h")
    shapes = [[s for line in r["c"].split("\n") if (s := shape(line))] for r in texts.collect()]

    plain = {name[h]: n for h, n, _, _ in (*known, *common)}
    if clean is None:
        others = set(links)
        plain = {s: 1 for h, n, _, _ in rare if n == 1 and len(s := name[h]) >= LONG_LINE and s[-1:] in ".?!" and s not in others}
    return Labels({name[h]: n for h, n, _, _ in around}, links, plain, shapes)


def learn(posts: DataFrame, content: str = "content", title: str = "title", key: str = "post_no", clean: DataFrame | None = None, text: str = "text") -> LineModel:
    """The model for these pages."""
    return train(learn_labels(posts, content, title, key, clean, text))


def line_labels(posts: DataFrame, keys: list[str], content: str, model: LineModel) -> DataFrame:
    """``keys`` with ``around`` (numbers from 1 of the lines that are not the post's) and ``body``.

    Lines are split at ``\\n``; blank lines are counted, belong to neither side, and stay in
    ``body`` only between lines that stay.  Null content yields no row; empty content an empty
    body.  Whole pages are read, each by itself.
    """
    sent = posts.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    picked = posts.where(F.col(content).isNotNull()).select(*keys, F.col(content).alias("_content"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema.fields), "around array<int>, body string"])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, lines_seen, pages_seen = LineModel(*sent.value), {}, {}

        def page(text: str) -> tuple[list[int], str]:
            lines = text.split("\n")
            scores = []
            for line in lines:
                value = lines_seen.get(line)
                if value is None:
                    s = shape(line)
                    value = lines_seen.get(s)
                    if value is None:
                        value = lines_seen[s] = model.score(s) if s else 0.0
                    lines_seen[line] = value
                scores.append(value)
            filled = [bool(line.strip()) for line in lines]
            keep = iter(best_regions([s for s, f in zip(scores, filled, strict=True) if f]))
            kept = [next(keep) if f else None for f in filled]
            around = [i for i, k in enumerate(kept, 1) if k is False]
            body = re.sub(r"\n\s*\n+", "\n\n", "\n".join(line for line, k in zip(lines, kept, strict=True) if k is not False)).strip()
            return around, body

        for batch in batches:
            if len(lines_seen) > 500_000:
                lines_seen.clear()
            if len(pages_seen) > 50_000:
                pages_seen.clear()
            done = []
            for text in batch["_content"]:
                found = pages_seen.get(text)
                if found is None:
                    found = pages_seen[text] = page(text)
                done.append(found)
            out = batch[keys].copy()
            out["around"] = [d[0] for d in done]
            out["body"] = [d[1] for d in done]
            yield out

    return picked.mapInPandas(label, schema)
