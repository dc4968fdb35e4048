"""Noise in text from scanned pages.

Two passes over the documents.  The first counts, over all pages, the words, their neighbours
and the lines that come back at the edges of pages.  From the counts the driver learns skip-gram
vectors for the vocabulary.  The second pass takes each document by itself: lines at the edges
that are running headers, footers or page numbers are page furniture; words cut by a
hyphen are joined; and a rare word that a plausible glyph edit turns into a far more frequent
one is taken as a misreading of it when the context agrees.

What is sent to the workers of words is bounded whatever the size of the corpus: a word or pair of
words is kept only if it makes up more than a fixed share of all of them, and there are at most
1 / share of such words.  Of the forms of lines, of which a document has many, only those are sent
that answer a question (:func:`telling_forms`).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of all words, of all pairs, and of all documents (for lines at page edges), and the least counts.
WORD_SHARE, PAIR_SHARE, FORM_SHARE = 1e-6, 2e-6, 1e-5
#: Least share of all words for a word to get vectors, so there are at most 200,000 of them.
VECTOR_SHARE = 5e-6
LEAST = 3
#: How many times as frequent as the misreading its original must be.
RATIO = 12.0
#: What a word that is too rare to be kept counts as, in shares of the least count.
UNKNOWN = 0.5
#: How much better the original must fit the neighbours.
FIT = 4.0
#: Size of the vectors, and what neighbours at a distance of one and two words weigh in their training.
DIM, WINDOW_WEIGHT = 48, (1.0, 0.5)
EDGE = 3
#: In how many times as many documents a form must be furniture as it is text.
ODDS = 3.0
#: A line shorter than this share of its page's longest is no running text.
SHORT = 0.5
#: Entries of a task's counters after which they are handed on, and documents that a task holds as objects at a time.
FLUSH, ROWS = 400_000, 500

_HYPHENS = "-‐‑­¬"
_BROKEN = re.compile(rf"[^\W_](?:[|])?[{_HYPHENS}]$")
_WORD = re.compile(r"[^\s.,()·:;!?\"“”‘’'\[\]{}<>~/‐‑–—\-¬­…※]+")
_DIGITS = re.compile(r"\d+")
_SENTENCE_END = re.compile(r"[.?!…][\"'”’)]*$")

#: Letters that are misread digits, and the fixed table of Latin letter groups that look alike.
LIKE_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "D": "0", "Q": "0", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "q": "9", "g": "9", "T": "7", "A": "4"})
ALIKE = {frozenset(p) for p in (
    ("c", "e"), ("c", "o"), ("e", "o"), ("a", "o"), ("a", "e"), ("u", "v"), ("n", "u"), ("n", "h"), ("h", "b"), ("i", "l"), ("i", "j"), ("l", "t"), ("f", "t"), ("r", "n"), ("g", "q"), ("y", "v"), ("s", "a"),
    ("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("tl", "d"), ("lc", "k"), ("I", "l"), ("li", "b"), ("fi", "h"), ("iu", "m"), ("rr", "n"), ("ti", "h"),
)}
_ROMAN = re.compile(r"^[ivxlc]{1,6}$", re.I)
_NUMBERED = re.compile(r"^(?:(?:p|page|페이지|쪽|제)\s*\.?\s*)?(\d{1,4})(?:\s*(?:쪽|페이지|면))?(?:\s*(?:/|of)\s*\d{1,4})?$", re.I)


def word_key(word: str) -> str:
    """A word with every number as 0."""
    return _DIGITS.sub("0", word)


def words_of(line: str) -> list[str]:
    return [word_key(w) for w in _WORD.findall(line)]


def _jamo(c: str) -> tuple[int, int, int] | None:
    code = ord(c) - 0xAC00
    return (code // 588, code % 588 // 28, code % 28) if 0 <= code < 11172 else None


def _difference(a: str, b: str) -> tuple[int, str, str]:
    """Where two words begin to differ, and the parts in which they do."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return start, a[start : len(a) - end], b[start : len(b) - end]


def _script(c: str) -> str:
    if "가" <= c <= "힣":
        return "hangul"
    if c.isdigit():
        return "digit"
    if c.isascii():
        return "latin" if c.isalpha() else "sign"
    return "other"


def _is_mixed(word: str) -> bool:
    """Whether a word has signs or more than one script, or digits among Latin letters."""
    kinds = {_script(c) for c in word}
    return "sign" in kinds or "other" in kinds or {"latin", "digit"} <= kinds or {"latin", "hangul"} <= kinds


def plausible_edit(seen: str, meant: str) -> int | None:
    """The place of the one difference if a recogniser could read ``meant`` as ``seen``."""
    start, a, b = _difference(seen, meant)
    if not a or not b or len(a) > 2 or len(b) > 2:
        return None
    if len(a) == len(b) == 1:
        one, two = _jamo(a), _jamo(b)
        if one and two:
            return start if sum(x != y for x, y in zip(one, two, strict=True)) == 1 else None
    kinds_a, kinds_b = {_script(c) for c in a}, {_script(c) for c in b}
    if kinds_b == {"hangul"}:
        # Jamo, kana, Han, letters and digits that stand for a syllable.
        return start if kinds_a != {"hangul"} and len(b) == 1 else None
    if kinds_b == {"latin"}:
        if kinds_a & {"digit", "sign", "other"}:
            return start if len(a) <= 2 and len(b) <= 2 else None
        return start if frozenset((a, b)) in ALIKE or frozenset((a.lower(), b.lower())) in ALIKE else None
    return None


def _holes(word: str, width: int) -> Iterator[str]:
    for i in range(len(word) - width + 1):
        yield f"{word[:i]}\0{word[i + width :]}"


def _page_number(part: str, plain: bool = False) -> int | None:
    """The number in a line that is only a page number, with or without decoration; -1 for a Roman one."""
    bare = part.strip(" \t-–—·•|[]()<>{}~=*_.,:")
    if not bare or re.fullmatch(r"\d+\.", part.strip()):
        return None  # a number with a full stop ends a sentence
    if _ROMAN.match(bare):
        return -1 if bare.lower() not in ("l", "i") else 1
    found = _NUMBERED.match(bare) or (_NUMBERED.match(bare.translate(LIKE_DIGITS)) if len(bare) <= 4 and any(c.isdigit() for c in bare) else None)
    return int(found[1]) if found else None


def _parts(line: str) -> list[str]:
    return [p.strip() for p in re.split(r"\s{2,}|\t", line.strip()) if p.strip()]


def _close(a: str, b: str) -> bool:
    """Equal up to about one misread character in six, letter by letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    if len(a) != len(b):
        _, x, y = _difference(a, b)
        return len(x) <= 2 and len(y) <= 2
    differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return len(differing) <= max(1, len(a) // 6) and not any(x.isdigit() and y.isdigit() for x, y in differing)


@dataclass
class Page:
    """A page of a document: its block number, its number, its lines."""

    block: int
    number: int | None
    lines: list[str]
    filled: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.filled = [i for i, line in enumerate(self.lines) if line.strip()]

    def edges(self) -> list[list[int]]:
        """Line numbers from the top and from the bottom, outermost first."""
        return [self.filled[:EDGE], self.filled[: -EDGE - 1 : -1]]


def _near_keys(form: str) -> Iterator[tuple]:
    """Keys of which two forms that are :func:`_close` share one.

    Forms of one length differ in at most ``len // 6`` letters (one at least), so of one part more than
    that one is the same in both; of two lengths they differ in one place of at most two letters, so the
    half before or behind it is the same.
    """
    size = len(form)
    if size < 4:
        return
    parts = max(1, size // 6) + 1
    for i in range(parts):
        at = i * size // parts
        yield size, i, form[at : (i + 1) * size // parts]
    for shorter in (size, size - 1):
        half = (shorter - 2) // 2
        if half > 0:
            yield shorter, "starts", form[:half]
            yield shorter, "ends", form[-half:]


def repeated_edges(pages: list[Page]) -> dict[str, int]:
    """Parts of edge lines that come back on another page of the document, and on how many they stand.

    A part counts where one stands that differs by little.  Parts are compared only with those that share
    a key, so that the work grows with the pages and not with their square.
    """
    on: dict[str, set[int]] = defaultdict(set)
    for k, page in enumerate(pages):
        for edge in page.edges():
            for i in edge:
                for part in _parts(page.lines[i]):
                    if _page_number(part) is None:
                        on[part].add(k)
    by_key: dict[tuple, list[str]] = defaultdict(list)
    for form in on:
        for key in _near_keys(form):
            by_key[key].append(form)
    found = {}
    for form, own in on.items():
        if _SENTENCE_END.search(form):
            continue
        places = set(own)
        compared = {form}
        for key in _near_keys(form):
            for other in by_key[key]:
                if other not in compared:
                    compared.add(other)
                    if not on[other] <= places and _close(form, other):
                        places |= on[other]
        if len(places) >= 2:
            found[form] = len(places)
    return found


def furniture(pages: list[Page], model: Model | None = None, repeated: dict[str, int] | None = None) -> list[set[int]]:
    """The numbers of the furniture lines of every page.

    From the outside inward, a line counts while each of its parts is a page number that agrees with
    those of the other pages, comes back on another page, or is known as furniture of other documents.
    """
    repeated = repeated_edges(pages) if repeated is None else repeated
    offsets: Counter = Counter()
    for page in pages:
        for n in {n for edge in page.edges() for i in edge for p in _parts(page.lines[i]) if (n := _page_number(p)) is not None and n >= 0}:
            offsets[n - (page.number or 0)] += 1
    agreed = offsets.most_common(1)[0] if offsets else (0, 0)
    found = []
    for page in pages:
        own: set[int] = set()
        for edge in page.edges():
            for i in edge:
                parts = _parts(page.lines[i])
                if i in own or not parts:
                    continue
                if all(_is_furniture(p, page, repeated, agreed, model) for p in parts):
                    own.add(i)
                else:
                    break
        # A page that is nothing else keeps its text.
        found.append(own)
    return found


def _is_furniture(part: str, page: Page, repeated: dict[str, int], agreed: tuple[int, int], model: Model | None) -> bool:
    number = _page_number(part)
    if number is not None:
        decorated = part.strip() != part.strip(" -–—·•|[]()<>~=") or not part.strip().isdigit()
        agrees = number - (page.number or 0) == agreed[0] and agreed[1] >= 2
        return decorated or agrees or number == page.number or number < 0
    if part in repeated:
        # By chance a heading or a line of text comes back once, hardly twice.
        return repeated[part] >= 3 or model is None or model.known_furniture(part) or not (model.heading(part) or model.text_line(part))
    return model is not None and model.known_furniture(part)


@dataclass
class Stream:
    """The words of a page in reading order, with the line and place of each."""

    keys: list[str]
    lines: list[tuple[int, int | None, int]]
    raw: list[str]


def reading_order(page: Page, skip: set[int]) -> Stream:
    """Words of the lines that are text; a word cut at the end of a line is joined with its rest."""
    keys: list[str] = []
    lines: list[tuple[int, int | None, int]] = []
    raw: list[str] = []
    open_cut = False
    for i in page.filled:
        if i in skip:
            continue
        line = page.lines[i].rstrip()
        found = _WORD.findall(line)
        if open_cut and found:
            head = raw[-1]
            raw[-1] = head + found[0]
            keys[-1] = word_key(raw[-1])
            lines[-1] = (lines[-1][0], i, len(word_key(head)))
            found = found[1:]
        open_cut = bool(found or open_cut) and _BROKEN.search(line) is not None and bool(keys or found)
        for w in found:
            raw.append(w)
            keys.append(word_key(w))
            lines.append((i, None, 0))
    return Stream(keys, lines, raw)


@dataclass
class Model:
    """Counts and vectors that hold for the whole corpus."""

    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    vectors: dict[str, np.ndarray]
    contexts: dict[str, np.ndarray]
    forms: dict[str, int]
    least: float = LEAST
    one: dict[str, list[str]] = field(default_factory=dict)
    two: dict[str, list[str]] = field(default_factory=dict)
    links: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    near_forms: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        # Whole furniture lines of four characters or more, for lines that a misreading sets apart from them.
        for f, n in self.forms.items():
            if f.startswith("+w ") and n >= LEAST and len(f) >= 7 and n > ODDS * self.forms.get(f"-{f[1:]}", 0):
                self.near_forms.update(_holes(f[3:], 1))
        for w in self.words:
            for h in _holes(w, 1):
                self.one.setdefault(h, []).append(w)
            for h in _holes(w, 2):
                self.two.setdefault(h, []).append(w)

    def known_furniture(self, part: str) -> bool:
        """Whether the line, or how it ends, is furniture in other documents and hardly ever text."""
        if _SENTENCE_END.search(part) or len(part) > 60:
            return False
        if len(part) >= 4 and any(h in self.near_forms for h in _holes(_DIGITS.sub("0", " ".join(part.split())), 1)):
            return True
        return any(self.forms.get(f"+{form}", 0) >= 2 and self.forms.get(f"+{form}", 0) > ODDS * self.forms.get(f"-{form}", 0) for form in edge_forms(part))

    def heading(self, part: str) -> bool:
        """Whether lines that begin so stand at the edges of pages mostly without coming back."""
        form = beginning(part)
        return self.forms.get(f"-{form}", 0) >= 3 * max(1, self.forms.get(f"+{form}", 0))

    def text_line(self, part: str) -> bool:
        """Whether the line is text of other documents at least as often as it is furniture."""
        form = edge_forms(part)[0]
        return self.forms.get(f"-{form}", 0) >= max(1, self.forms.get(f"+{form}", 0))

    def originals(self, word: str) -> list[tuple[str, int]]:
        """Frequent words that ``word`` may be a misreading of, with the place of the difference."""
        found = self.links.get(word)
        if found is None:
            # A word that is not kept may be as frequent as the rarest that are.
            count = self.words.get(word, UNKNOWN * self.least)
            near: set[str] = set()
            for h in _holes(word, 1):
                near.update(self.one.get(h, ()))
                near.update(self.two.get(h, ()))
            for h in _holes(word, 2):
                near.update(self.one.get(h, ()))
                near.update(self.two.get(h, ()))
            found = []
            for w in near:
                if w != word and self.words[w] >= RATIO * count and (at := plausible_edit(word, w)) is not None:
                    found.append((w, at))
            if any(c.isdigit() for c in word) or word[:1] in "lIOZSbBG|":
                turned = word_key(word.translate(LIKE_DIGITS))
                if turned != word and not any(c.isascii() and c.isalpha() for c in turned) and (turned == "0" or self.words.get(turned, 0) >= RATIO * count):
                    found.append((turned, next((i for i, c in enumerate(word) if c.isascii() and not c.isdigit()), 0)))
            found.sort(key=lambda f: (-self.words.get(f[0], 0), f[0]))
            self.links[word] = found
        return found

    def fits(self, word: str, before: list[str], after: list[str]) -> tuple[float, float]:
        """How often ``word`` stands between its neighbours, and how well its vector goes with them."""
        often = (self.pairs.get((before[0], word), 0) if before else 0) + (self.pairs.get((word, after[0]), 0) if after else 0)
        vector = self.vectors.get(word)
        if vector is None:
            return often, -1.0
        around = [self.contexts[c] for c in (*before[:2], *after[:2]) if c in self.contexts]
        return often, float(sum(vector @ a for a in around) / len(around)) if around else 0.0

    def misread(self, keys: list[str], at: int) -> tuple[str, int] | None:
        """The word that the word at a place is a misreading of, if it is one."""
        word = keys[at]
        options = self.originals(word)
        if not options or word == "0":
            return None
        count = self.words.get(word, 0)
        before, after = keys[max(0, at - 2) : at][::-1], keys[at + 1 : at + 3]
        own_often, own_vector = self.fits(word, before, after)
        own_often = max(0.0, own_often)
        best = None
        for meant, place in options:
            often, vector = self.fits(meant, before, after)
            better = often > FIT * own_often
            if not count:
                # A word that hardly exists: its original stands between these neighbours or goes with them,
                # or the word has what no word has, such as a bar or a digit among letters.
                sure = better or vector > 0.0 or meant == "0" or _is_mixed(word) and not _is_mixed(meant)
            else:
                sure = better and often >= LEAST and (vector >= own_vector or often > 5 * FIT * own_often)
            if sure and (best is None or (often, vector) > best[0]):
                best = ((often, vector), meant, place)
        if best:
            return best[1], best[2]
        return None


def edge_forms(part: str) -> list[str]:
    """A line as a whole, how it ends and how it starts, the forms under which furniture is known."""
    words = _DIGITS.sub("0", part).split()
    forms = [f"w {' '.join(words)}"]
    if len(words) >= 3:
        forms += [f"e {' '.join(words[-2:])}", f"s {' '.join(words[:2])}"]
    return forms


def beginning(part: str) -> str:
    """How a line begins; numbered headings that stand at the top of pages by chance are told by it."""
    return f"b {_DIGITS.sub('0', part.split()[0])}"




def _scanned(preprocessed: DataFrame) -> DataFrame:
    """(prep_id, pages): documents with scanned pages, pruned to what is read of the blocks."""
    slim = F.transform("blocks", lambda b, i: F.struct((i + 1).cast("int").alias("block"), F.when(b["block_type"] == "ocr_paragraph", b["text"]).alias("text"), b["page_no"].alias("page")))
    return preprocessed.where(F.exists("blocks", lambda b: b["block_type"] == "ocr_paragraph")).select("prep_id", F.filter(slim, lambda p: p["text"].isNotNull()).alias("pages")).where(F.size("pages") > 0)


def _as_pages(pages: list[dict]) -> list[Page]:
    return [Page(p["block"], p["page"], p["text"].split("\n")) for p in pages if p["text"].strip()]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that not all documents of one are objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def corpus_counts(preprocessed: DataFrame) -> DataFrame:
    """``(kind, key, n)``: words, pairs of neighbours, of words with one between them, and forms at page edges, over all pages.

    A form has ``+`` before it where it is furniture, ``-`` where it is text, and ``?`` where a document will ask
    whether it is text (see :func:`_is_furniture`).  Counted in each task before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        wide: Counter = Counter()
        forms: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            kinds = ["w"] * len(words) + ["p"] * len(pairs) + ["q"] * len(wide) + ["f"] * len(forms)
            keys = [*words, *(f"{a}\t{b}" for c in (pairs, wide) for a, b in c), *forms]
            # With types, as the last batch of a task is empty if the one before it was handed on at the limit.
            batch = pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.string()), "n": pa.array([*words.values(), *pairs.values(), *wide.values(), *forms.values()], pa.int64())})
            for c in (words, pairs, wide, forms):
                c.clear()
            return batch

        for batch in _sliced(batches):
            for row in batch.column(1).to_pylist():
                pages = _as_pages(row)
                repeated = repeated_edges(pages)
                kept: set[str] = set()
                text: set[str] = set()
                for page in pages:
                    width = max((len(page.lines[i]) for i in page.filled), default=0)
                    for edge in page.edges():
                        for p in _parts(page.lines[edge[0]])[:1] if edge else ():
                            # Lines that fill the page are running text, whatever they begin with.
                            if _page_number(p) is None and not _SENTENCE_END.search(p) and len(p) < SHORT * width:
                                (kept if p in repeated else text).add(beginning(p))
                for page, skip in zip(pages, furniture(pages, None, repeated), strict=True):
                    for i in page.filled:
                        parts = _parts(page.lines[i])
                        if i in skip:
                            kept.update(f for p in parts if p in repeated for f in edge_forms(p))
                        elif i in page.filled[1:-1]:
                            # The outermost line may be a header that stands on this page alone.
                            text.update(f for p in parts for f in edge_forms(p))
                    keys = reading_order(page, skip).keys
                    words.update(keys)
                    pairs.update(zip(keys, keys[1:], strict=False))
                    wide.update(zip(keys, keys[2:], strict=False))
                forms.update(f"+{f}" for f in kept)
                forms.update(f"-{f}" for f in text)
                forms.update({f"?{edge_forms(p)[0]}" for p, n in repeated.items() if n == 2})
                forms["documents"] += 1
            if len(words) + len(pairs) + len(wide) + len(forms) > FLUSH:
                yield handed_on()
        yield handed_on()

    return _scanned(preprocessed).mapInArrow(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def learn_vectors(words: dict[str, int], pairs: dict[tuple[str, str], int], wide: dict[tuple[str, str], int] | None = None, epochs: int = 12, negatives: int = 4) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Skip-gram vectors with negative sampling, trained on the counted pairs of a window of two words in both directions."""
    names = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))]
    index = {w: i for i, w in enumerate(names)}
    known = [(index[a], index[b], n * weight) for counts, weight in zip((pairs, wide or {}), WINDOW_WEIGHT, strict=True) for (a, b), n in counts.items() if a in index and b in index]
    if not known:
        return {}, {}
    left, right, n = (np.array(x) for x in zip(*known, strict=True))
    centre, context = np.r_[left, right], np.r_[right, left]
    weight = np.sqrt(np.r_[n, n].astype(np.float64))
    rng = np.random.default_rng(11)
    u, v = (rng.random((len(names), DIM)) - 0.5) / DIM, np.zeros((len(names), DIM))
    noise = np.array([words[w] for w in names], np.float64) ** 0.75
    noise = np.cumsum(noise / noise.sum())
    chance = weight / weight.sum()
    size = 2048
    steps = max(1, epochs * len(centre) // size)
    draw = np.cumsum(chance)
    for step in range(steps):
        rate = 0.25 * (1 - step / steps) + 0.01
        at = np.minimum(np.searchsorted(draw, rng.random(size)), len(centre) - 1)
        c, o = centre[at], context[at]
        for target, label in [(o, 1.0), *((np.minimum(np.searchsorted(noise, rng.random(size)), len(names) - 1), 0.0) for _ in range(negatives))]:
            gain = rate * (label - 1 / (1 + np.exp(-np.clip((u[c] * v[target]).sum(1), -12, 12))))
            move_u, move_v = gain[:, None] * v[target], gain[:, None] * u[c]
            np.add.at(u, c, np.clip(move_u, -0.1, 0.1))
            np.add.at(v, target, np.clip(move_v, -0.1, 0.1))
    return dict(zip(names, u.astype(np.float32), strict=True)), dict(zip(names, v.astype(np.float32), strict=True))


def telling_forms(counts: DataFrame, least: float) -> DataFrame:
    """``(form, plus, minus)``: the forms by which :class:`Model` answers a question otherwise than by not knowing them.

    Those are furniture, beginnings of headings, and lines of text that a document asks for.  Most lines of text
    nobody asks for, and their number grows with the corpus.
    """
    signed = counts.where((F.col("kind") == "f") & (F.col("key") != "documents")).select(F.substring("key", 1, 1).alias("sign"), F.expr("substring(key, 2)").alias("form"), "n")
    count = lambda sign: F.coalesce(F.max(F.when(F.col("sign") == sign, F.col("n"))), F.lit(0))
    both = signed.where((F.col("n") >= least) | (F.col("sign") == "?")).groupBy("form").agg(count("+").alias("plus"), count("-").alias("minus"), count("?").alias("asked"))
    plus, minus, kind = F.col("plus"), F.col("minus"), F.substring("form", 1, 2)
    known = (kind != "b ") & (plus >= 2) & (plus > ODDS * minus)
    heading = (kind == "b ") & (minus >= 3 * F.greatest(F.lit(1), plus))
    text = (kind == "w ") & (F.col("asked") > 0) & (minus >= F.greatest(F.lit(1), plus))
    return both.where(known | heading | text).select("form", "plus", "minus")


def learn(preprocessed: DataFrame) -> dict:
    """What a :class:`Model` is made of, from all scanned pages."""
    counts = corpus_counts(preprocessed).persist()
    try:
        total = {r["kind"]: r["n"] for r in counts.where("kind != 'f'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        documents = counts.where("key = 'documents' and kind = 'f'").agg(F.sum("n")).first()[0] or 0
        pair = max(LEAST, PAIR_SHARE * total.get("p", 0))
        least = {"w": max(LEAST, WORD_SHARE * total.get("w", 0)), "p": pair, "q": pair}
        kept: dict[str, dict] = {}
        for kind, n in least.items():
            rows = counts.where((F.col("kind") == kind) & (F.col("n") >= n)).select("key", "n").collect()
            kept[kind] = {(tuple(r["key"].split("\t")) if kind in "pq" else r["key"]): r["n"] for r in sorted(rows, key=lambda r: r["key"])}
        rows = telling_forms(counts, max(2, FORM_SHARE * documents)).collect()
        kept["f"] = {f"{sign}{r['form']}": n for r in rows for sign, n in (("+", r["plus"]), ("-", r["minus"])) if n}
    finally:
        counts.unpersist()
    vectors, contexts = learn_vectors({w: n for w, n in kept["w"].items() if n >= VECTOR_SHARE * total.get("w", 0)}, kept["p"], kept["q"])
    return {"words": kept["w"], "pairs": kept["p"], "vectors": vectors, "contexts": contexts, "forms": kept["f"], "least": least["w"]}


def faults(pages: list[Page], model: Model) -> list[tuple[Page, set[int], dict[int, set[str]], Stream, dict[int, str]]]:
    """For every page its furniture, the kinds of fault of its lines, its words and the corrections by place."""
    out = []
    for page, skip in zip(pages, furniture(pages, model), strict=True):
        kinds: dict[int, set[str]] = {i: {"page_furniture"} for i in skip}
        text = [i for i in page.filled if i not in skip]
        for i, following in zip(text, text[1:], strict=False):
            if _BROKEN.search(page.lines[i].rstrip()) and page.lines[following].lstrip()[:1].isalnum():
                kinds.setdefault(i, set()).add("broken_word")
        stream = reading_order(page, skip)
        fixed: dict[int, str] = {}
        for at in range(len(stream.keys)):
            meant = model.misread(stream.keys, at)
            if meant:
                first, second, cut = stream.lines[at]
                line = second if second is not None and meant[1] >= cut else first
                kinds.setdefault(line, set()).add("misread")
                fixed[at] = _corrected(stream.raw[at], meant[0])
        out.append((page, skip, kinds, stream, fixed))
    return out


def _corrected(raw: str, meant: str) -> str:
    """The stored word with the correction in it; its digits stay."""
    if "0" not in meant:
        return meant
    numbers = _DIGITS.findall(raw.translate(LIKE_DIGITS) if not any(_script(c) == "hangul" for c in raw) or any(c.isascii() and c.isalpha() for c in raw) else raw)
    out, k = [], 0
    for piece in re.split("(0)", meant):
        if piece == "0":
            out.append(numbers[k] if k < len(numbers) else "0")
            k += 1
        else:
            out.append(piece)
    return "".join(out)


def repaired(page: Page, skip: set[int], stream: Stream, fixed: dict[int, str]) -> str:
    """The text of a page in paragraphs: furniture left out, cut words joined, misreadings corrected, lines reflowed."""
    by_line: dict[int, list[int]] = defaultdict(list)
    for at, (first, _, _) in enumerate(stream.lines):
        by_line[first].append(at)
    width = max((len(page.lines[i].rstrip()) for i in page.filled if i not in skip), default=0)
    paragraphs: list[str] = []
    current = ""
    carried = False
    for i in page.filled:
        if i in skip:
            continue
        line = page.lines[i].strip()
        pieces, at_char = [], 0
        if carried:
            first = _WORD.search(line)
            at_char = first.end() if first else 0
        search = at_char
        carried = False
        for at in by_line.get(i, []):
            whole, second, _ = stream.raw[at], stream.lines[at][1], stream.lines[at][2]
            found = _WORD.search(line, search)
            if not found:
                break
            pieces.append(line[at_char : found.start()])
            pieces.append(fixed.get(at, whole))
            at_char = search = found.end()
            if second is not None:
                at_char, carried = len(line), True
        pieces.append(line[at_char:])
        text = "".join(pieces)
        current = f"{current}{text}" if not current or text[:1] in ".,)?!" or current.endswith("\0") else f"{current} {text}"
        current = current.replace("\0", "")
        if carried:
            current += "\0"
        elif _SENTENCE_END.search(line) and len(line) < 0.8 * width or not _SENTENCE_END.search(line) and len(line) < 0.5 * width:
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current.replace("\0", ""))
    return "\n".join(p.strip() for p in paragraphs)


_BUILT: list[tuple[dict, Model]] = []


def _model(parts: dict) -> Model:
    """The model with its index, built once in a worker; what it was built of is kept, so that it is known again."""
    if not _BUILT or _BUILT[0][0] is not parts:
        _BUILT[:] = [(parts, Model(**parts))]
    return _BUILT[0][1]


def repair_pages(preprocessed: DataFrame, parts: dict | None = None) -> DataFrame:
    """``(prep_id, block_no, text, faults)`` of every scanned page.

    ``text`` is the repaired page, ``faults`` its faulty lines as (line_no, kind).  Blocks of other
    kinds, null and blank blocks and documents without blocks yield no row.  Documents are taken
    whole, each by itself; a document's pages are in one row as stored.
    """
    if parts is None:
        parts = learn(preprocessed)
    sent = preprocessed.sparkSession.sparkContext.broadcast(parts)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in _sliced(batches):
            ids, blocks, texts, found = [], [], [], []
            for prep_id, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for page, skip, kinds, stream, fixed in faults(_as_pages(row), model):
                    ids.append(prep_id)
                    blocks.append(page.block)
                    texts.append(repaired(page, skip, stream, fixed))
                    found.append([{"line_no": i + 1, "kind": k} for i in sorted(kinds) for k in sorted(kinds[i])])
            fault = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_pydict({"prep_id": pa.array(ids, pa.int64()), "block_no": pa.array(blocks, pa.int32()), "text": pa.array(texts, pa.string()), "faults": pa.array(found, fault)})
            if len(model.links) > 1_000_000:
                model.links.clear()

    return _scanned(preprocessed).mapInArrow(repair, "prep_id long, block_no int, text string, faults array<struct<line_no: int, kind: string>>")
