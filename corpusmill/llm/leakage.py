"""Evaluation texts inside training text.

Every document is turned into its sequence of letters and digits.  All of its sequences of ``SEED``
characters are looked up at once among those of the held-out items, which gives for each item an upper
bound of what the document can reproduce of it; only items that reach the limit by that bound are gone
into.  These are added to one generalised suffix automaton, the document is streamed through it a
character at a time, and the longest match at every place is tracked.  Inside the matches the stretches
of each item are chained in the item's own order, and a document gives an item away when the chain
covers enough of it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest match that counts as a stretch, in normalised characters.
SEED = 6
#: Shortest match that is no coincidence wherever it stands.
LONG = 14
#: Share of an item in matches of that length from which small changes between stretches count as covered; below it only what stands there unchanged counts.
LONG_SHARE = 0.2
#: Share of an item that makes it leaked.
COVERAGE = 0.5
#: A change between two stretches counts as part of what is reproduced up to this many characters.
BRIDGE = 14
#: Items of fewer characters have no half that is more than a few letters; they are leaked where they stand as a whole, in words of their own.
WHOLE = 2 * SEED
#: The automaton of a worker starts anew beyond this many characters of items.
AUTOMATON_CHARS = 250_000
#: Characters of texts that are looked up at once, so that a batch takes bounded memory.
LOOKED_UP = 500_000

_TAG = re.compile(r"<[^<>\n]{1,200}>")
_ENTITY = re.compile(r"&#?\w{1,8};")
_NOT_TEXT = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W_]")
_CLUSTER = regex.compile(r"\X")


def _unmarked(text: str) -> str:
    """``text`` with tags blanked and entities read, of the same length."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group())[:1].ljust(len(m.group())), text)
    return text


def plain(text: str) -> str:
    """Letters and digits of ``text``, composed and in lower case.

    Tags, entities, punctuation and white space count for nothing, so that reflowed, quoted or
    marked-up copies look alike.
    """
    bare = _unmarked(text)
    if not bare.isascii() and not unicodedata.is_normalized("NFKC", bare):
        bare = unicodedata.normalize("NFKC", bare)
    return _NOT_TEXT.sub("", bare.lower())


def normalised(text: str) -> tuple[str, list[int]]:
    """:func:`plain` and where each of its characters stands in ``text``."""
    bare = _unmarked(text)
    low = bare.lower()
    if len(low) == len(bare) and unicodedata.is_normalized("NFKC", bare):
        places = [m.start() for m in _LETTER.finditer(low)]
        return "".join([low[i] for i in places]), places
    whole = plain(text)
    out, places = [], []
    for cluster in _CLUSTER.finditer(bare):
        kept = _NOT_TEXT.sub("", unicodedata.normalize("NFKC", cluster.group()).lower())
        start, length = cluster.span()[0], cluster.end() - cluster.start()
        out.append(kept)
        places += [start + min(i, length - 1) if len(kept) == length else start + i * length // len(kept) for i in range(len(kept))]
    if "".join(out) == whole:
        return whole, places
    # Marks that compose over the borders of clusters, or letters whose small form depends on their neighbours.
    return whole, [i * len(text) // max(len(whole), 1) for i in range(len(whole))]


class Automaton:
    """A generalised suffix automaton that texts can be added to at any time."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.size = 0

    def add(self, text: str) -> None:
        self.size += len(text)
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _add(self, moves: dict[str, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p``."""
        copy = self._add(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        made = self._add({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return made

    def matches(self, text: str, least: int) -> Iterator[tuple[int, int]]:
        """``(start, end)`` in ``text`` of every match of ``least`` characters or more that no neighbour extends."""
        moves, link, lengths = self.next, self.link, self.length
        state = size = 0
        for at, c in enumerate(text):
            to = moves[state].get(c)
            if to is None:
                if size >= least:
                    yield at - size, at
                while to is None and state > 0:
                    state = link[state]
                    to = moves[state].get(c)
                size = lengths[state] + 1 if to is not None else 0
                state = to or 0
            else:
                state = to
                size += 1
        if size >= least:
            yield len(text) - size, len(text)


_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str) -> np.ndarray:
    """A 64-bit hash of every sequence of ``SEED`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < SEED:
        return np.zeros(0, np.uint64)
    value = codes[: len(codes) - SEED + 1].copy()
    for n in range(1, SEED):
        value = value * _STEP + codes[n : len(codes) - SEED + 1 + n]
    value *= _MIX
    return value ^ (value >> np.uint64(29))


class Index:
    """All sequences of ``SEED`` characters of the items, as sorted arrays."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        # Items so far apart that no gap between two of them can be bridged.
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + SEED + BRIDGE + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        hashes = [_grams(t) for t in texts]
        places = np.concatenate([at + np.arange(len(h)) for at, h in zip(self.starts, hashes, strict=True)]) if texts else np.zeros(0, np.int64)
        flat = np.concatenate(hashes) if texts else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.places = places[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        bits = max(16, int(len(self.keys) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def candidates(self, texts: list[str]) -> list[list[int]]:
        """For every text the numbers of the items that it may give away: no chain in the item's order can cover more than counted here.

        An item's part is what the sequences met cover of it, and the gaps between that are short enough to be bridged.
        All texts are looked up at once.
        """
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.keys) or not texts:
            return out
        met = _grams("\0".join(texts))
        at = np.flatnonzero(self.seen[met >> self.shift])
        met = met[at]
        key = np.searchsorted(self.keys, met)
        key[key == len(self.keys)] = 0
        right = self.keys[key] == met
        if not right.any():
            return out
        ends = np.cumsum([len(t) + 1 for t in texts])
        own = np.searchsorted(ends, at[right], "right")
        pairs = np.unique(own * len(self.keys) + key[right])
        own, key = np.divmod(pairs, len(self.keys))
        counts = self.last[key] - self.first[key]
        upto = np.cumsum(counts)
        place = self.places[np.arange(upto[-1]) + np.repeat(self.first[key] - (upto - counts), counts)]
        span = int(self.starts[-1] + self.sizes[-1] + SEED + BRIDGE + 1)
        found = np.sort(np.repeat(own, counts) * span + place)
        steps = np.append(np.diff(found), SEED + BRIDGE + 1)
        parts = np.where(steps <= SEED + BRIDGE, steps, SEED)
        own, place = np.divmod(found, span)
        items = np.searchsorted(self.starts, place, "right") - 1
        begin = np.flatnonzero(np.append(True, (items[1:] != items[:-1]) | (own[1:] != own[:-1])))
        enough = np.add.reduceat(parts, begin) >= COVERAGE * self.sizes[items[begin]]
        for text, item in zip(own[begin][enough].tolist(), items[begin][enough].tolist(), strict=True):
            out[text].append(item)
        return out


def stretches(item: str, grams: dict[str, list[int]], text: str, inside: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """``(item place, text place, length)`` of all common stretches of ``SEED`` characters or more, within the parts ``inside`` of the text."""
    found, covered = [], {}
    for start, stop in [(0, len(text))] if inside is None else inside:
        for at in range(start, stop - SEED + 1):
            for place in grams.get(text[at : at + SEED], ()):
                if covered.get(place - at, -1) > at:
                    continue
                end = SEED
                while place + end < len(item) and at + end < len(text) and item[place + end] == text[at + end]:
                    end += 1
                covered[place - at] = at + end
                found.append((place, at, end))
    return found


def chain(found: list[tuple[int, int, int]], reach: int, bridge: int = BRIDGE) -> tuple[int, list[tuple[int, int]]]:
    """The largest part of an item covered in order, and the text spans of it.

    Stretches follow each other in the item and in the text.  Groups of stretches with at most
    ``reach`` characters of text from start to start may stand any distance apart if each has a
    stretch of ``LONG`` characters; what is shorter could be coincidence.  Changes of up to ``bridge``
    characters between neighbours count as covered.
    """
    found = sorted(found, key=lambda f: (f[1], f[0]))
    starts = [f[1] for f in found]
    # Chains that end at a stretch, by what the group they end in has: no long stretch and no group before, a long one, none yet.
    FIRST, SURE, OPEN = range(3)
    best: list[tuple[tuple[int, int, int] | None, ...]] = []
    top = (0, (-1, FIRST))
    #: The best sure chain out of reach that ends up to a place of the item, as a tree of maxima.
    far = [(0, -1)] * (max((p + n for p, _, n in found), default=0) + 1)
    passed = sure = 0
    for k, (place, at, length) in enumerate(found):
        near = bisect_left(starts, at - reach)
        for j in range(passed, near):
            if best[j][SURE] is not None:
                sure += 1
                end = found[j][0] + found[j][2]
                while end < len(far):
                    far[end] = max(far[end], (best[j][SURE][0], j))
                    end += end & -end
        passed = max(passed, near)
        is_long = length >= LONG
        states: list[tuple[int, int, int] | None] = [None, None, None]
        states[SURE if is_long else FIRST] = (length, -1, FIRST)
        if sure:
            for cut in range(length):
                end, before = place + cut, (0, -1)
                while end > 0:
                    before = max(before, far[end])
                    end -= end & -end
                kind = SURE if is_long else OPEN
                if before[1] >= 0 and (states[kind] is None or before[0] + length - cut > states[kind][0]):
                    states[kind] = (before[0] + length - cut, before[1], SURE)
        for j in range(near, k):
            p, a, n = found[j]
            over = max(0, p + n - place, a + n - at)
            if p >= place or a >= at or over >= length:
                continue
            gap_item, gap_text = place - p - n, at - a - n
            bridged = gap_item if 0 < gap_item <= bridge and gap_text <= 2 * bridge else 0
            for kind, ends in enumerate(best[j]):
                to = SURE if is_long else kind
                if ends is not None and (states[to] is None or ends[0] + length - over + bridged > states[to][0]):
                    states[to] = (ends[0] + length - over + bridged, j, kind)
        best.append(tuple(states))
        for kind in (FIRST, SURE):
            if states[kind] is not None:
                top = max(top, (states[kind][0], (k, kind)))
    spans, (k, kind) = [], top[1]
    while k >= 0:
        spans.append((found[k][1], found[k][1] + found[k][2]))
        _, k, kind = best[k][kind]
    return top[0], spans[::-1]


class Leaks:
    """The items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        clean = [(i, n) for i, t in items if t and (n := plain(t))]
        self.items = [(i, n) for i, n in clean if len(n) >= WHOLE]
        self.index = Index([n for _, n in self.items])
        self.automaton, self.added = Automaton(), set()
        self.grams: dict[str, dict[str, list[int]]] = {}
        self.short = None
        if len(self.items) < len(clean):
            import ahocorasick

            self.short = ahocorasick.Automaton()
            by_text: dict[str, list[int]] = {}
            for i, n in clean:
                if len(n) < WHOLE:
                    by_text.setdefault(n, []).append(i)
            for n, ids in by_text.items():
                self.short.add_word(n, (len(n), ids))
            self.short.make_automaton()

    def _index(self, item: str) -> dict[str, list[int]]:
        if item not in self.grams:
            if len(self.grams) > 10_000:
                self.grams.clear()
            grams: dict[str, list[int]] = {}
            for i in range(len(item) - SEED + 1):
                grams.setdefault(item[i : i + SEED], []).append(i)
            self.grams[item] = grams
        return self.grams[item]

    def covered(self, item: str, text: str, inside: list[tuple[int, int]] | None = None) -> tuple[int, list[tuple[int, int]]]:
        """How many characters of ``item`` the normalised ``text`` reproduces, and its spans."""
        found = stretches(item, self._index(item), text, inside)
        long = sum(n for _, n in {(at, n) for _, at, n in found if n >= LONG})
        return chain(found, 4 * len(item), BRIDGE if long >= LONG_SHARE * len(item) else 0)

    def _matched(self, numbers: list[int], text: str) -> list[tuple[int, int]]:
        """The parts of ``text`` that stand in the items, by the automaton; those that overlap put together."""
        if self.automaton.size > AUTOMATON_CHARS:
            self.automaton, self.added = Automaton(), set()
        for number in numbers:
            if number not in self.added:
                self.added.add(number)
                self.automaton.add(self.items[number][1])
        parts: list[tuple[int, int]] = []
        for start, end in sorted(self.automaton.matches(text, SEED)):
            if parts and start <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(end, parts[-1][1]))
            else:
                parts.append((start, end))
        return parts

    def of(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """``(item id, coverage, spans of the text)`` of every item that ``text`` gives away."""
        return next(self.of_all([text]))

    def of_all(self, texts: list[str | None]) -> Iterator[list[tuple[int, float, list[tuple[int, int]]]]]:
        """:meth:`of` for every text, a few at a time."""
        at = 0
        while at < len(texts):
            wholes: list[str] = []
            size = 0
            while at + len(wholes) < len(texts) and size < LOOKED_UP:
                text = texts[at + len(wholes)]
                wholes.append(plain(text) if text else "")
                size += len(wholes[-1])
            for whole, numbers in zip(wholes, self.index.candidates(wholes), strict=True):
                yield self._given_away(texts[at] or "", whole, numbers)
                at += 1

    def _given_away(self, text: str, whole: str, numbers: list[int]) -> list[tuple[int, float, list[tuple[int, int]]]]:
        hits = [(end + 1 - n, end + 1, ids) for end, (n, ids) in self.short.iter(whole)] if self.short else []
        if not numbers and not hits:
            return []
        found = []
        inside = self._matched(numbers, whole) if numbers else []
        for number in numbers:
            item_id, item = self.items[number]
            covered, spans = self.covered(item, whole, inside)
            if covered >= COVERAGE * len(item):
                found.append((item_id, covered / len(item), spans))
        if not found and not hits:
            return []
        _, places = normalised(text)
        alone = lambda at: not 0 <= at < len(text) or not text[at].isalnum()
        short: dict[int, list[tuple[int, int]]] = {}
        for a, b, ids in hits:
            if alone(places[a] - 1) and alone(places[b - 1] + 1):
                for i in ids:
                    short.setdefault(i, []).append((a, b))
        found += [(i, 1.0, spans) for i, spans in short.items()]
        return [(i, c, [(places[a], places[b - 1] + 1) for a, b in spans]) for i, c, spans in found]


def find_leaks(documents: DataFrame, items: list[tuple[int, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, item_id, coverage, spans)``: every document with the items it gives away.

    ``items`` is the held-out set as (id, text) pairs; null and blank ones leak nothing.  The set is
    sent to every worker, so its size is checked by :func:`held_out`.  Documents are read whole
    and shuffled nowhere; null, empty and unaffected ones yield no row, repeated rows one each.
    ``spans`` are the stretches of the stored text to remove.
    """
    picked = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = picked.schema["_key"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaks = _leaks(sent.value)
        for batch in batches:
            rows = [(k, i, round(c, 4), [{"start": a, "end": b} for a, b in s]) for k, given in zip(batch["_key"], leaks.of_all(batch["_text"].tolist()), strict=True) for i, c, s in given]
            yield pd.DataFrame(rows, columns=["_key", "item_id", "coverage", "spans"])

    found = picked.mapInPandas(find, f"_key {kind}, item_id long, coverage double, spans array<struct<start: int, end: int>>")
    return found.withColumnRenamed("_key", key)


_BUILT: dict[int, Leaks] = {}


def _leaks(items: list[tuple[int, str]]) -> Leaks:
    """The index and automaton, built once in a worker."""
    key = hash(tuple(items))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Leaks(items)
    return _BUILT[key]


def held_out(items: DataFrame, most_chars: int = 30_000_000) -> list[tuple[int, str]]:
    """The held-out items, on the driver; refused when they are not the small set they should be."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"the held-out set has {size} characters; more than {most_chars} need several calls")
    return [(r["item_id"], r["text"]) for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").collect()]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans (start, end) that leaked."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join(out) + text[at:]
