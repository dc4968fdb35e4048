"""Text decoded with the wrong encoding: found and restored.

For every pair of a written and a read encoding the garbled sequences of an alphabet are
computed once and put into one multi-pattern automaton.  Its hits mark where a text may be
garbled and by which pair; the stretch around the hits is then turned back by that pair
and replaced only if it turns back completely and the outcome is more plausible than what
stands there.  Correct text in the same block is left as it is.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLACEMENT = "\ufffd"
#: Log frequency of a syllable that the corpus does not have; the same for corpora of any size.
UNKNOWN = -16.5
#: A character that is no ASCII, Hangul or usual sign: one class, so that most texts are passed over fast.
#: Of texts with no such character only those with a Latin letter turned into one syllable can be garbled (ALONE).
STRANGE = r"[^\x{0000}-\x{007F}\x{AC00}-\x{D7A3}\x{00AD}\x{00B7}\x{2010}-\x{2014}\x{2018}-\x{201D}\x{2026}\x{203B}]"
ALONE = r"[\x{AC00}-\x{D7A3}][a-z]|[A-Za-z][\x{AC00}-\x{D7A3}](?![\x{AC00}-\x{D7A3}])"


def _windows_1252(data: bytes) -> str:
    """Windows-1252 as browsers read it: the five unassigned bytes become C1 controls."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def _to_windows_1252(text: str) -> bytes:
    out = bytearray()
    for c in text:
        out += bytes([ord(c)]) if ord(c) in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else c.encode("cp1252")
    return bytes(out)


def _read(data: bytes, encoding: str) -> str:
    if encoding == "cp1250":
        return "".join(bytes([b]).decode("cp1250") if b not in (0x81, 0x83, 0x88, 0x90, 0x98) else chr(b) for b in data)
    return _windows_1252(data) if encoding == "cp1252" else data.decode(encoding)


def _written(text: str, encoding: str) -> bytes:
    if encoding == "cp1250":
        return b"".join(bytes([ord(c)]) if ord(c) in (0x81, 0x83, 0x88, 0x90, 0x98) else c.encode("cp1250") for c in text)
    return _to_windows_1252(text) if encoding == "cp1252" else text.encode(encoding)


#: (written as, read as), the pairs met with Korean, Japanese, Chinese, Russian, Central and West European text.
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp949", "cp1252"), ("cp949", "latin-1"), ("cp949", "gb18030"), ("utf-8", "cp949"), ("utf-8", "gb18030"),
    ("utf-8", "cp932"), ("cp949", "cp932"), ("cp1252", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp932", "latin-1"), ("cp932", "cp1252"),
    ("utf-8", "cp1251"), ("cp949", "cp1251"), ("utf-8", "mac-roman"), ("cp949", "mac-roman"), ("utf-8", "cp437"), ("cp949", "cp437"), ("utf-8", "cp850"), ("utf-8", "big5"), ("utf-8", "euc-jp"),
    ("cp949", "big5"), ("cp949", "euc-jp"),
    ("utf-8", "iso8859-15"), ("utf-8", "iso8859-2"), ("utf-8", "cp1250"), ("utf-8", "koi8-r"), ("utf-8", "cp866"),
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"),
    ("gb18030", "latin-1"), ("gb18030", "cp1252"),
)
#: Encodings of one byte a character.
SINGLE = ("cp1252", "latin-1", "mac-roman", "cp1251", "cp437", "cp850", "iso8859-15", "iso8859-2", "cp1250", "koi8-r", "cp866")
#: Encodings that only Russian text is written in.
RUSSIAN = ("cp1251", "koi8-r", "cp866")
#: Single-byte encodings so seldom read by mistake that only letters count.
RARE_TARGETS = ("iso8859-15", "iso8859-2", "cp1250", "koi8-r", "cp866")
#: The ten commonest letters of Russian, about two thirds of any text.
COMMON_RUSSIAN = "\u043e\u0435\u0430\u0438\u043d\u0442\u0441\u0440\u0432\u043b"
#: Letters with marks of the languages that are most often written with them.
COMMON_LATIN = "\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5\u00e6\u00e7\u00e8\u00e9\u00ea\u00eb\u00ed\u00ee\u00ef\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f8\u00f9\u00fa\u00fb\u00fc\u00fd\u00df\u0153\u0105\u0107\u0119\u0142\u0144\u015b\u017a\u017c\u010d\u010f\u011b\u0148\u0159\u0161\u0165\u016f\u017e\u0151\u0171\u0103\u0219\u021b\u011f\u0131\u015f\u0111"
#: Signs that stand alone and are told from other text only by standing beside one more of the same pair.
SIGNS = "\u00a7\u00b6\u00b1\u00b0\u00d7\u20ac\u00bd\u2030\u00b2"


def _is_hangul(c: str) -> bool:
    return "\uac00" <= c <= "\ud7a3"


def _is_cyrillic(text: str) -> bool:
    return all("\u0400" <= c <= "\u04ff" for c in text)


def _alphabet() -> dict[str, list[str]]:
    """The characters whose garbled forms are precomputed, by kind, from rules alone."""
    standard = lambda leads: [c for lead in leads for trail in range(0xA1, 0xFF) if len(c := bytes([lead, trail]).decode("euc-kr", "ignore")) == 1]
    return {
        "hangul": standard(range(0xB0, 0xC9)),
        "kana": [chr(c) for c in range(0x3041, 0x30FF)],
        "han": standard(range(0xCA, 0xFE)),
        "hanzi": [bytes([lead, trail]).decode("gb2312") for lead in range(0xB0, 0xD7) for trail in range(0xA1, 0xFF)],
        "letter": [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha()],
        "cyrillic": [chr(c) for c in range(0x410, 0x450)],
        "mark": list("\u00a1\u00bf\u00bd\u2030\u00b2\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00b7\u2022\u20ac\u300c\u300d\u300e\u300f\u3008\u3009\u3000\u00a0\u00ab\u00bb\u00a9\u00ae\u00b0\u00b1\u00d7\u2192\u25cb\u25cf\u25a0\u25a1\u203b\u2460\u2461\u00a7\u00b6"),
    }


def _heads(target: str) -> list[str]:
    """What the first two bytes of a Hangul syllable or kana in UTF-8 are in a double-byte encoding."""
    leads = [(0xE3, second) for second in (0x81, 0x82, 0x83)] + [(first, second) for first in range(0xEA, 0xEE) for second in range(0x80, 0xC0)]
    return [c for lead in leads if len(c := bytes(lead).decode(target, "ignore")) == 1 and not c.isascii()]


class Garbled:
    """The automaton of garbled sequences and the restoring of spans."""

    def __init__(self, syllables: dict[str, float]) -> None:
        import ahocorasick

        self.syllables = syllables
        self.floor = UNKNOWN
        kinds = _alphabet()
        found: dict[str, set[tuple[int, str]]] = {}
        for number, (source, target) in enumerate(PAIRS):
            for kind, letters in kinds.items():
                if kind == "han" and source != "utf-8":
                    continue  # two bytes of it say nothing that the syllables around do not
                if (kind == "hanzi") != (source == "gb18030") or source in RUSSIAN and kind != "cyrillic":
                    continue
                for c in letters:
                    try:
                        garbled = _read(_written(c, source), target)
                    except (UnicodeError, ValueError):
                        continue
                    if garbled != c and not garbled.isascii():
                        found.setdefault(garbled, set()).add((number, kind))
            # Three bytes a letter against two a character: the first two bytes of any letter make a character.
            if source == "utf-8" and target not in SINGLE:
                for head in _heads(target):
                    found.setdefault(head, set()).add((number, "head"))
        self.automaton = ahocorasick.Automaton()
        for garbled, uses in found.items():
            self.automaton.add_word(garbled, (len(garbled), tuple(sorted(uses))))
        self.automaton.make_automaton()
        self.reach = {
            number: re.compile(pattern)
            for number, pattern in ((n, "[^\\x00-\\x7f]+(?:[ -@\\[-`{-~]*[^\\x00-\\x7f]+)*" if t in SINGLE else "[^\\x00-\\x7f]+") for n, (_, t) in enumerate(PAIRS))
        }

    def hangul_score(self, text: str) -> float:
        """Mean log frequency of the syllables of ``text``; low where there are none."""
        marks = [self.syllables.get(c, self.floor) for c in text if _is_hangul(c)]
        return sum(marks) / len(marks) if marks else self.floor

    def _plausible(self, span: str, turned: str, pair: tuple[str, str], before: str, after: str) -> bool:
        """Whether ``turned`` is what ``span`` was meant to be."""
        source, target = pair
        if REPLACEMENT in turned or any("\ue000" <= c <= "\uf8ff" for c in turned):
            return False
        if any("\x80" <= c <= "\x9f" for c in turned):
            # Only a text garbled twice has control characters half way.
            return source == "utf-8" and target in ("cp1252", "latin-1") and any(self._turn(turned, ("utf-8", t)) for t in ("latin-1", "cp1252"))
        high = [c for c in turned if c > "\x7f"]
        hangul = [c for c in high if _is_hangul(c)]
        if not high:
            return False
        if target in SINGLE:
            if source == "utf-8":
                if target in RARE_TARGETS and not all(c.isalpha() and (0xC0 <= ord(c) < 0x250 or _is_hangul(c)) for c in high):
                    return False
                # Valid UTF-8 by accident is next to impossible for a lead and its continuation bytes.
                return not (target == "cp1251" and all("\u0400" <= c <= "\u04ff" for c in high) and len(high) < 2)
            if source == "cp1252":
                return all(c in "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u20ac\u2022\u2122\u0152\u0153\u0160\u0161\u017d\u017e\u0178" or c in span for c in high)
            if source in RUSSIAN:
                # Words of mostly small letters; no language has four accented letters in a row, in small letters or in
                # large ones behind a small one, and no Russian word is written in such a way.
                odd = {"cp1251": "[\xc0-\xff][\xe0-\xff]{4,}", "koi8-r": "[\xe0-\xff][\xc0-\xdf]{4,}"}[source] if target in ("latin-1", "cp1252") else "[\u0430-\u044f][\u0410-\u042f]{3,}"
                if source == "cp866":
                    odd = "[\u0402-\u040f\u0452-\u045f\u0490\u0491\u0401\u0451]"
                elif source == "cp1251" and target in ("mac-roman", "cp437", "cp850"):
                    return False
                words = re.findall("[\u0401\u0410-\u044f\u0451]+", turned)
                russian = all(c in "\u0401\u0451\u2116\xab\xbb\u2014\xa0" or "\u0410" <= c <= "\u044f" for c in high)
                # Of two ways to turn a text the one with Russian letters in their usual numbers is right.
                letters = "".join(words).lower()
                russian = russian and sum(c in COMMON_RUSSIAN for c in letters) * 2 >= len(letters)
                return russian and re.search(odd, span) is not None and (source != "cp866" or len(high) >= 4) and all(w[1:].islower() for w in words if len(w) > 1)
            if source == "gb18030":
                # Four frequent characters, with a sign among the letters that they are read as, that are no remains of UTF-8.
                return len(re.findall("[\xc2\xc3][\x80-\xbf]", span)) * 4 < len(high) >= 4 and all("\u4e00" <= c <= "\u9fff" and 0xB0 <= c.encode("gb18030")[0] <= 0xD7 for c in high) and re.search("[\xa1-\xbf\xd7\xf7]", span) is not None and re.search("[\xc0-\xff]", span) is not None
            if source == "cp949":
                if hangul:
                    return self.hangul_score(turned) > self.floor + 2.2 and (len(hangul) >= 2 or not (before.isalpha() or after.isalpha())) and len(hangul) * 2 >= len(high) and not span.isalpha()
                if sum("\u0400" <= c <= "\u04ff" for c in high) >= max(3, 0.8 * len(high)):
                    return True
                if re.fullmatch("[\xa8\xa9][\xa1-\xff]", span):
                    # A letter that the Korean standard has too, inside a word.
                    return 0xC0 <= ord(high[0]) < 0x180 and (before.isascii() and before.isalpha() or after.isascii() and after.islower())
                if re.fullmatch("[\xa1\xa2][\xa1-\xff]", span):
                    return high[0] in "\xa1\xbf" and after.isascii() and after.isalpha() or high[0] in "\xb1\xb0\xa7\xb6\xd7\u20ac\u2019\u2018\u201c\u201d\u300c\u300d\u300e\u300f\u2026\xb7\u2014\u203b\u25cb\u25cf"
                return len(high) == 1 and high[0] in "\u2018\u2019\u201c\u201d\u300c\u300d\u300e\u300f\u2026\u00b7\u2014" or len(high) >= 2 and all(c in "\u2018\u2019\u201c\u201d\u300c\u300d\u300e\u300f\u2026\u00b7\u2014" or "\u3041" <= c <= "\u30ff" for c in high)
            return len(high) >= 3 and sum("\u3041" <= c <= "\u30ff" for c in high) * 2 >= len(high)
        if source == "utf-8":
            if hangul:
                return self.hangul_score(turned) > max(self.hangul_score(span) + 1.0, self.floor + 2.0)
            if all(0xC0 <= ord(c) < 0x180 for c in high):
                # One letter of a Latin word: the span stands inside or before small letters.
                return len(span) <= 2 and (after.isascii() and after.islower() or before.isascii() and before.isalpha() and not _is_hangul(after)) and self.hangul_score(span) < self.floor + 6.0
            return len(high) >= 2 and (all("\u0400" <= c <= "\u04ff" for c in high) or any("\u3041" <= c <= "\u30ff" for c in high)) or high[0] in "\u2018\u2019\u201c\u201d\u2013\u2014\u2026"
        # Double-byte text read as another double-byte encoding.
        if len(span) == 1 and not hangul and not span.isalpha():
            # A letter inside a word; a sign only counts beside another one, see ``repair``.
            return 0xC0 <= ord(high[0]) < 0x180 and before.isascii() and before.isalpha() and after.isascii() and after.isalpha() or high[0] in SIGNS
        return len(hangul) == len(high) and len(hangul) >= 2 and self.hangul_score(turned) > self.floor + 4.0

    def _turn(self, span: str, pair: tuple[str, str]) -> str | None:
        try:
            return _read(_written(span, pair[1]), pair[0])
        except (UnicodeError, ValueError):
            return None

    def repair(self, text: str, depth: int = 3) -> tuple[str, int]:
        """(text with the garbled spans restored, number of spans that were or stay garbled)."""
        lost = len(re.findall(f"{REPLACEMENT}+", text))
        uses: dict[int, list[tuple[int, int]]] = {}
        heads: dict[int, list[int]] = {}
        for end, (length, marks) in self.automaton.iter(text):
            for number, kind in marks:
                hits = uses.setdefault(number, [])
                if kind == "head":
                    heads.setdefault(number, []).append(end + 1 - length)
                else:
                    hits.append((end + 1 - length, end + 1))
        found: list[tuple[int, int, str, int]] = []
        for number, hits in uses.items():
            pair = PAIRS[number]
            done: list[tuple[int, int]] = []
            for start, stop in self._stretches(text, number, hits, heads.get(number, [])):
                # Parts of a stretch that turns back as a whole need no look of their own.
                at = bisect_right(done, (start, len(text))) - 1
                if at >= 0 and stop <= done[at][1]:
                    continue
                span = text[start:stop]
                turned = self._turn(span, pair)
                before, after = text[start - 1 : start], text[stop : stop + 1]
                if turned is not None and self._plausible(span, turned, pair, before, after):
                    found.append((start, stop, turned, number))
                    if not done or done[-1][1] <= start:
                        done.append((start, stop))
        # A Russian word is Hangul by some pairs; it is garbled only beside other text that is so by the same pair.
        sure = {number for start, stop, _, number in found if not _is_cyrillic(text[start:stop])}
        found = [f for f in found if f[3] in sure or PAIRS[f[3]][1] in SINGLE or not _is_cyrillic(text[f[0] : f[1]])]
        # Signs are told by two different ones of the same pair.
        signs: dict[int, set[str]] = {}
        for start, stop, turned, number in found:
            if stop - start == 1 and turned in SIGNS and PAIRS[number][1] not in SINGLE and unicodedata.category(text[start]) not in ("Ps", "Pe"):
                signs.setdefault(number, set()).add(turned)
        found = [f for f in found if not (f[1] - f[0] == 1 and f[2] in SIGNS and PAIRS[f[3]][1] not in SINGLE) or len(signs.get(f[3], ())) >= 2]
        # Most text explained first; a span that overlaps one that is taken is left out.
        taken: list[tuple[int, int, str, int]] = []
        # Of two pairs that turn back the same, the one that gives usual letters and no capital behind a small one.
        odd_case = lambda f: f[2][:1].isupper() and text[f[0] - 1 : f[0]].islower()
        letters = lambda f: [x for c in f[2] if c > "\x7f" for x in c.lower()]
        rare = lambda f: sum(c not in COMMON_LATIN for c in letters(f)) if all(0xC0 <= ord(c) < 0x250 for c in letters(f)) else 0
        for item in sorted(found, key=lambda f: (-sum(c > "\x7f" for c in text[f[0] : f[1]]), rare(f), odd_case(f), f[3], f[0])):
            if all(item[1] <= t[0] or item[0] >= t[1] for t in taken):
                taken.append(item)
        out, at = [], 0
        for start, stop, turned, _ in sorted(taken):
            out += [text[at:start], turned]
            at = stop
        fixed = "".join(out) + text[at:]
        if taken and depth > 1:
            again, more = self.repair(fixed, depth - 1)
            return (again, max(len(taken) + lost, more))
        return fixed, len(taken) + lost

    def _from_heads(self, text: str, number: int, heads: list[int]) -> Iterator[tuple[int, int]]:
        """The longest stretch from each head on that turns back exactly, parts of an earlier one left out."""
        target = PAIRS[number][1]
        after = 0
        for start in heads:
            if start < after:
                continue
            decoder = codecs.getincrementaldecoder("utf-8")()
            stop = start
            for place in range(start, len(text)):
                if text[place].isascii():
                    break
                try:
                    decoder.decode(text[place].encode(target))
                except UnicodeError:
                    break
                if not decoder.getstate()[0]:
                    stop = place + 1
            if stop > start:
                after = stop
                yield start, stop

    def _stretches(self, text: str, number: int, hits: list[tuple[int, int]], heads: list[int]) -> Iterator[tuple[int, int]]:
        """Chains of adjoining hits, and the whole non-ASCII runs around them where these turn back too."""
        seen = set()
        hits.sort()
        chains: list[list[int]] = []
        for start, stop in hits:
            if chains and start <= chains[-1][1]:
                chains[-1][1] = max(stop, chains[-1][1])
            elif chains and PAIRS[number][1] in SINGLE and start - chains[-1][1] <= 24 and text[chains[-1][1] : start].isascii():
                chains[-1][1] = stop
            else:
                chains.append([start, stop])
        for run in self.reach[number].finditer(text):
            headed = bisect_left(heads, run.start()) < bisect_left(heads, run.end())
            if (headed or any(run.start() < c[1] and c[0] < run.end() for c in chains)) and run.span() not in seen:
                seen.add(run.span())
                yield run.span()
        for start, stop in self._from_heads(text, number, heads):
            if (start, stop) not in seen:
                seen.add((start, stop))
                yield start, stop
        source, target = PAIRS[number]
        if source in RUSSIAN:
            return  # only whole words say anything
        # A single syllable says nothing.
        alone = hits if source != "cp949" or target in SINGLE else [h for h in hits if h[1] - h[0] == 1 and not text[h[0]].isalpha()]
        for start, stop in (*chains, *alone):
            if (start, stop) not in seen:
                seen.add((start, stop))
                yield start, stop


def syllable_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(c, n)``: how often each Hangul syllable stands in ``column``, over all rows.

    Counted in each batch before anything is shuffled; there are at most 11,172 rows a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update("".join(t for t in batch.column(0).to_pylist() if t))
        kept = {c: n for c, n in total.items() if _is_hangul(c)}
        yield pa.RecordBatch.from_pydict({"c": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

    return texts.select(column).mapInArrow(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))


def syllable_model(texts: DataFrame, column: str) -> dict[str, float]:
    """Log frequency of every syllable; at most 11,172 entries, whatever the size of the corpus."""
    rows = syllable_counts(texts, column).collect()
    total = sum(r["n"] for r in rows) or 1
    return {r["c"]: math.log(r["n"] / total) for r in rows}


def garbled_suspects(text: Column) -> Column:
    """A cheap test in the scan that every garbled text passes; null is none."""
    return text.isNotNull() & (text.rlike(STRANGE) | text.rlike(ALONE))


_BUILT: dict[int, Garbled] = {}


def _garbled(model: dict[str, float]) -> Garbled:
    """The automaton, built once in a worker."""
    key = hash(frozenset(model.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Garbled(model)
    return _BUILT[key]


def restore_encoding(rows: DataFrame, column: str, keys: list[str], model: dict[str, float] | None = None) -> DataFrame:
    """``keys`` with ``restored`` and ``spans`` of the rows whose ``column`` holds garbled text.

    ``spans`` counts stretches that were decoded wrongly, recoverable or not (what was lost to
    replacement characters stays in place).  Null and empty texts are never cases; texts of any
    length are taken whole.  ``model`` is the syllable model of the corpus; made from ``rows``
    when it is not given.
    """
    if model is None:
        model = syllable_model(rows, column)
    # Case of names: the output is built from keys alone, so that other columns cannot clash.
    picked = rows.where(garbled_suspects(F.col(column))).select(*keys, F.col(column).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys).schema.fields), "restored string", "spans int"])

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        garbled = _garbled(model)
        for batch in batches:
            done = [garbled.repair(t) for t in batch["_text"]]
            out = batch[keys].copy()
            out["restored"] = [d[0] for d in done]
            out["spans"] = [d[1] for d in done]
            yield out[out["spans"] > 0]

    return picked.mapInPandas(restore, schema)
