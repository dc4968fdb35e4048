"""Filling containers of fixed capacity.

Harmonic packing: sizes between C/(k+1) and C/k form class k, and a bin of class k holds k
documents of it, so workers fill their bins without knowing of each other.  Fixed counts alone
leave a good part of the bins free, so what a bin of a class leaves is offered to the documents
of the later classes, the small ones beyond ``CLASSES`` last.  Documents over the capacity are cut into full containers and a rest, and
the rest is packed like any other document.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Documents larger than capacity / CLASSES have bins of their class, smaller ones fill the gaps.
CLASSES = 12
#: Containers that one task fills by itself.
CONTAINERS_A_TASK = 2000


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte-level tokenizer: UTF-8 bytes and one end token; null for null."""
    return F.octet_length(text) + 1


def byte_cuts(data: bytes, capacity: int) -> list[int]:
    """Offsets at which ``data`` (with one end token behind it) is cut into containers.

    A piece ends at the last white space of its last tenth, else between two characters.
    """
    cuts, start = [], 0
    while len(data) + 1 - start > capacity:
        end = start + capacity
        low = end - capacity // 10
        space = max(data.rfind(b"\n", low, end), data.rfind(b" ", low, end))
        if space >= low:
            end = space + 1
        else:
            while end > start + 1 and end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
        cuts.append(end)
        start = end
    return cuts


def sized_pieces(documents: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece_no, start, tokens)``: one piece for each document, more for those over the capacity.

    Only the texts of the latter reach Python.  ``start`` is a byte offset into the UTF-8 text.
    Null texts have no tokens and yield nothing; an empty text is one end token.
    """
    fits = documents.where(byte_tokens(F.col(text)) <= capacity).select(F.col(key), F.lit(1).alias("piece_no"), F.lit(0).alias("start"), byte_tokens(F.col(text)).alias("tokens"))
    large = documents.where(byte_tokens(F.col(text)) > capacity).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = large.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["_key"], batch["_text"], strict=True):
                data = content.encode()
                edges = [0, *byte_cuts(data, capacity), len(data) + 1]
                rows += [(name, i + 1, edges[i], edges[i + 1] - edges[i]) for i in range(len(edges) - 1)]
            yield pd.DataFrame(rows, columns=["_key", "piece_no", "start", "tokens"])

    pieces = large.mapInPandas(cut, f"_key {kind}, piece_no int, start int, tokens int").withColumnRenamed("_key", key)
    return fits.unionByName(pieces)


def harmonic_bins(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """The bin of every size: class by class, then the small ones into what is left free.

    A document of a class goes first into the bin of an earlier class that it fills best; those
    that fit none make bins of their class, a fixed number in each.  Small documents, largest
    first, go into any bin by the same rule.  Bin numbers start at 0.
    """
    by_class: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        if size > capacity:
            raise ValueError("an item is larger than a container")
        by_class.setdefault(min(capacity // max(size, 1), classes), []).append(i)
    bins, free = [0] * len(sizes), 0
    order: list[tuple[int, int]] = []

    def fitted(i: int) -> bool:
        place = bisect.bisect_left(order, (sizes[i], -1))
        if place == len(order):
            return False
        left, b = order.pop(place)
        bins[i] = b
        bisect.insort(order, (left - sizes[i], b))
        return True

    for k in sorted(by_class):
        members = sorted(by_class[k], key=lambda i: (-sizes[i], i))
        if k < classes:
            rest = [i for i in members if not fitted(i)]
            for start in range(0, len(rest), k):
                taken = rest[start : start + k]
                for i in taken:
                    bins[i] = free
                bisect.insort(order, (capacity - sum(sizes[i] for i in taken), free))
                free += 1
        else:
            for i in members:
                if not fitted(i):
                    bins[i] = free
                    bisect.insort(order, (capacity - sizes[i], free))
                    free += 1
    return _emptied(bins, sizes, capacity)


def _emptied(bins: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Whole contents of the emptiest bins moved piece by piece into the space of others."""
    held: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        held.setdefault(b, []).append(i)
    left = {b: capacity - sum(sizes[i] for i in own) for b, own in held.items()}
    order = sorted((space, b) for b, space in left.items())
    for b in sorted(held, key=lambda b: -left[b]):
        if left[b] * 20 < capacity:
            break
        order.pop(bisect.bisect_left(order, (left[b], b)))
        moves, kept = [], list(order)
        for i in sorted(held[b], key=lambda i: -sizes[i]):
            place = bisect.bisect_left(order, (sizes[i], -1))
            if place == len(order):
                break
            space, to = order.pop(place)
            bisect.insort(order, (space - sizes[i], to))
            moves.append((i, to))
        if len(moves) < len(held[b]):
            order = kept
            bisect.insort(order, (left[b], b))
            continue
        for i, to in moves:
            held[to].append(i)
            left[to] -= sizes[i]
            bins[i] = to
        held[b] = []
    names = {b: n for n, b in enumerate(sorted(set(bins)))}
    return [names[b] for b in bins]


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece_no, start, tokens, container)``: where every document goes.

    Documents are dealt out at random, in groups that fill about ``CONTAINERS_A_TASK``
    containers, and each group is packed by itself: only keys and sizes are shuffled, a group
    is bounded, and none depends on another.  Repeated rows are separate documents, and are dealt
    out by their place in the input, so that many of one key do not meet in one group.
    """
    pieces = sized_pieces(documents, key, text, capacity)
    total = documents.agg(F.sum(byte_tokens(F.col(text)).cast("long"))).first()[0] or 0
    groups = max(1, round(total / capacity / CONTAINERS_A_TASK))
    dealt = pieces.select(F.col(key).alias("_key"), "piece_no", "start", "tokens", F.pmod(F.xxhash64(F.col(key), "piece_no", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("_group"))
    kind = dealt.schema["_key"].dataType.simpleString()

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "_key", "piece_no"], ignore_index=True)
        bins = harmonic_bins(group["tokens"].tolist(), capacity)
        return group.assign(container=[f"{group['_group'].iloc[0]}-{b}" for b in bins]).drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(fill, f"_key {kind}, piece_no int, start int, tokens int, container string").withColumnRenamed("_key", key)
