"""Cutting oversized items at natural boundaries.

Lexical cohesion finds where the topic changes: the text is cut into small units (sentences
and lines), the words of the units before and after every gap are compared, and a gap whose
similarity lies deep between its neighbouring peaks is a topic boundary.  Each piece ends at
the deepest valley its size allows and the next begins with the last characters of the one
before.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 900
OVERLAP = 120
#: Units compared on either side of a gap.
BLOCK_UNITS = 4

_UNIT_END = re.compile(r"\n+|(?<=[.!?…。！？])[)\]”’\"']*\s+")
_WORD = re.compile(r"\w+")


def _stem(word: str) -> str:
    """Hangul words without what particles and endings change; others in lower case."""
    return word[:2] if word[:1] >= "가" else word.lower()[:6]


def unit_ends(text: str) -> list[int]:
    """Offsets just behind every sentence or line of ``text``, the end of the text included."""
    ends = [m.end() for m in _UNIT_END.finditer(text)]
    return [e for e in ends if 0 < e < len(text)] + [len(text)]


def valley_depths(text: str, ends: list[int]) -> dict[int, float]:
    """The depth of the cohesion valley at every gap between units."""
    bags, start = [], 0
    for end in ends:
        bags.append(Counter(_stem(w) for w in _WORD.findall(text[start:end]) if not w.isdigit()))
        start = end
    similar = []
    for gap in range(1, len(bags)):
        left, right = Counter(), Counter()
        for bag in bags[max(0, gap - BLOCK_UNITS) : gap]:
            left.update(bag)
        for bag in bags[gap : gap + BLOCK_UNITS]:
            right.update(bag)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        similar.append(sum(n * right[w] for w, n in left.items()) / norm if norm else 0.0)
    depths = {}
    for i, s in enumerate(similar):
        peak_left, peak_right = s, s
        for j in range(i - 1, -1, -1):
            if similar[j] < peak_left:
                break
            peak_left = similar[j]
        for j in range(i + 1, len(similar)):
            if similar[j] < peak_right:
                break
            peak_right = similar[j]
        depths[ends[i]] = peak_left - s + peak_right - s
    return depths


def split_points(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``, in order.

    Every piece has at most ``max_chars`` characters, each but the first begins exactly
    ``overlap`` characters before the end of the one before, and together they cover the text.
    A cut is made, in this order, at the deepest valley between units in the window that a piece
    may end in (of equal ones the last, and a line end before a mere sentence end), behind the
    last white space in it, or at the limit.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the pieces")
    if len(text) <= max_chars:
        return [(0, len(text))]
    ends = unit_ends(text)
    depths = valley_depths(text, ends)
    cuts = [e for e in ends if e < len(text)]
    pieces, start, at = [], 0, 0
    while len(text) - start > max_chars:
        # A piece takes at least half of what it may hold beyond its overlap.
        fresh = start + (overlap if pieces else 0)
        low, high = fresh + max(1, (start + max_chars - fresh) // 2), start + max_chars
        while at < len(cuts) and cuts[at] < low:
            at += 1
        best, k = None, at
        while k < len(cuts) and cuts[k] <= high:
            rank = (round(depths.get(cuts[k], 0.0), 6), text[cuts[k] - 1] == "\n", cuts[k])
            best = max(best, rank) if best else rank
            k += 1
        if best:
            end = best[2]
        else:
            end = next((i for i in range(high, low - 1, -1) if text[i - 1].isspace()), high)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, len(text)))
    return pieces


def oversized_items(preprocessed: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(prep_id, item_kind, item_no, text)`` of the blocks and chunks over the limit.

    Blocks are numbered by their place in the array from 1, chunks by their ``chunk_id``.  Null
    arrays, elements and texts are no items.  Length is that of the text as stored, in code points.
    """
    block = preprocessed.select("prep_id", F.posexplode("blocks").alias("place", "item")).select(
        "prep_id", F.lit("block").alias("item_kind"), (F.col("place") + 1).cast("long").alias("item_no"), F.col("item.text").alias("text")
    )
    chunk = preprocessed.select("prep_id", F.explode("chunks").alias("item")).select("prep_id", F.lit("chunk").alias("item_kind"), F.col("item.chunk_id").cast("long").alias("item_no"), F.col("item.text").alias("text"))
    return block.unionByName(chunk).where(F.length("text") > max_chars)


def split_items(items: DataFrame, keys: list[str], text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``keys`` with ``piece_no`` (from 1), ``start`` (from 0) and ``piece`` for every item.

    Items within the limit come out as one piece, null texts not at all.
    """
    picked = items.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema.fields), "piece_no int, start int, piece string"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = [split_points(t, max_chars, overlap) for t in batch["_text"]]
            counts = [len(p) for p in points]
            out = batch[keys].loc[batch.index.repeat(counts)].reset_index(drop=True)
            out["piece_no"] = [i for p in points for i in range(1, len(p) + 1)]
            out["start"] = [s for p in points for s, _ in p]
            out["piece"] = [t[s:e] for t, p in zip(batch["_text"], points, strict=True) for s, e in p]
            yield out

    return picked.mapInPandas(split, schema)
