"""Abusive, hateful or sexual content.

A linear classifier over character n-grams whose features are scaled by naive Bayes log-count
ratios.  Reviewers judge whole documents while abuse is mostly a sentence, so the classifier
scores sentences and a document counts as its worst one: training alternates between fitting the
weights and choosing the sentence for which a positive document was judged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are fitted on at most; of more, those with the smallest hash are taken.
MOST_LABELLED = 8_000
BITS = 19
GRAMS = (1, 2, 3, 4, 5)
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Sentences longer than this are judged in parts that overlap by half, so that length dilutes nothing.
SPAN = 120
#: How far above the bias a score has to be at least.
CLEAR = 1.0
#: Weight, in documents, of the corpus in the share of positive documents that have an n-gram; largest log ratio.
PRIOR, MOST_RATIO = 20.0, 4.0
#: Parts of the labelled documents; each is judged by a model of the others.
FOLDS = 2
#: Sentences of a negative document that are fitted on, the highest-scoring ones.
HARDEST = 6
#: Sentences with fewer n-grams are scaled as if they had so many, so that a fragment says little.
LEAST_GRAMS = 90

_END = re.compile(r"\n+|(?<=[.!?。…])[\"'”’)]*\s+")
_BLANKS = re.compile(r" *[^\S\n ][^\S\n]*| {2,}")
_DIGITS = re.compile(r"\d+")
_JOINERS = re.compile(r"(?<=[^\W\d_])[­​-‏⁠﻿ㅡ·._\-~^|/]+(?=[^\W\d_])")
#: A cheap test for the above.
_JOINER = re.compile(r"[­​-‏⁠﻿ㅡ·._\-~^|/]")
_REPEATS = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W\d_])")
_LEET = re.compile(r"(?<=[a-z])[@$!0135](?=[a-z])")
#: Signs and digits that stand for letters inside a word.
LETTERS = dict(zip("@$!0135", "asioies", strict=True))


def plain(text: str) -> str:
    """Composed, in lower case, numbers as 0, long repetitions shortened, and what hides words undone:
    signs for letters inside words, and words spelt with a blank between all letters.  Line ends stay."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = _LEET.sub(lambda m: LETTERS[m.group()], text.lower())
    text = _BLANKS.sub(" ", _REPEATS.sub(r"\1\1", _DIGITS.sub("0", text)))
    return _SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def sentences(text: str) -> list[str]:
    """The normalised sentences of ``text``; long ones in overlapping parts.

    A sentence with signs between its letters is given without them as well.
    """
    out = []
    for piece in _END.split(plain(text)):
        piece = piece.strip()
        if not piece:
            continue
        joined = _JOINERS.sub("", piece) if _JOINER.search(piece) else piece
        for form in (piece,) if joined == piece else (piece, joined):
            if len(form) <= SPAN:
                out.append(form)
            else:
                out += [form[i : i + SPAN] for i in range(0, len(form) - SPAN // 2, SPAN // 2)]
    return out


def hashed(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all sentences, and the number of the sentence of each.

    All n-grams of a length are hashed at once: a polynomial over the code points, mixed by a
    multiplication, of which the upper bits are the place.
    """
    if not many:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    codes = np.frombuffer(f"\0 {' \0 '.join(many)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    start = codes == 0
    owner = np.cumsum(start, dtype=np.int32) - 1
    codes = codes.astype(np.uint64)
    value = np.zeros(len(codes) + 1, np.uint64)
    places, owners = [], []
    # Where an n-gram would reach into the next sentence.
    left = np.diff(np.append(np.flatnonzero(start), len(codes)))
    room = np.arange(len(codes)) - np.flatnonzero(start)[owner]
    room = left[owner] - room
    for n in range(1, max(GRAMS) + 1):
        value = value[:-1][: max(len(codes) - n + 1, 0)] * _STEP + codes[n - 1 :]
        inside = (room[: len(value)] >= n) & ~start[: len(value)]
        places.append(((value[inside] + np.uint64(n)) * _MIX >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(owner[: len(value)][inside])
    return np.concatenate(places), np.concatenate(owners)


def margins(many: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The margin of every sentence: its weights over the root of their number."""
    out = np.empty(len(many))
    for at in range(0, len(many), 4096):
        places, owners = hashed(many[at : at + 4096])
        n = len(many[at : at + 4096])
        sizes = np.bincount(owners, minlength=n)
        out[at : at + 4096] = np.bincount(owners, weights=weights[places], minlength=n) / np.sqrt(np.maximum(sizes, LEAST_GRAMS)) + bias
    return out


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, text: str | None) -> float:
        """The margin of the worst sentence; null and blank texts score lowest."""
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None], seen: dict[str, float] | None = None) -> np.ndarray:
        """:meth:`score` of every text; ``seen`` keeps the margins of sentences."""
        seen = {} if seen is None else seen
        bags = [sentences(t) if isinstance(t, str) else [] for t in texts]
        new = list({s for bag in bags for s in bag if s not in seen})
        seen.update(zip(new, margins(new, self.weights, self.bias).tolist(), strict=True))
        return np.array([max((seen[s] for s in bag), default=-1e9) for bag in bags])


def _gathered(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in one array, the row of each, and the scale of each row."""
    sizes = np.array([len(f) for f in lists])
    return np.concatenate(lists) if lists else np.zeros(0, np.int32), np.repeat(np.arange(len(lists), dtype=np.int32), sizes), 1 / np.sqrt(np.maximum(sizes, LEAST_GRAMS))


def _ratio(positive: list[np.ndarray], corpus: np.ndarray, n_corpus: float) -> np.ndarray:
    """Log ratio of the share of positive documents that have an n-gram to the share of all documents.

    The corpus is counted by sentences; that a document has an n-gram at all follows from how many a
    document has on average.  The share of the positives leans on that of the corpus, so an n-gram no
    positive document has says little, and one that hardly any document has says nothing for certain.
    """
    dim = 1 << BITS
    count = np.bincount(np.concatenate(positive), minlength=dim) if positive else np.zeros(dim)
    everywhere = -np.expm1(-(corpus + 0.5) / (n_corpus + 1.0))
    return np.clip(np.log((count + PRIOR * everywhere) / (len(positive) + PRIOR)) - np.log(everywhere), -MOST_RATIO, MOST_RATIO)


def _fit(lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, steps: int = 80, ridge: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their naive Bayes log-count ratio.

    It starts from the naive Bayes weights themselves (all ones) and is drawn towards them.
    """
    places, rows, scale = _gathered(lists)
    # Only places that occur are fitted; the others keep the weight they start from.
    used, columns = np.unique(places, return_inverse=True)
    dim = len(used)
    value = (ratio[places] * scale[rows]).astype(np.float64)
    w, b = np.full(dim, 0.3), -1.0
    speed, square_w, square_b = 0.1, np.full(dim, 1e-12), 1e-12
    weight = weight / weight.sum()
    for _ in range(steps):
        margin = np.bincount(rows, weights=value * w[columns], minlength=len(lists)) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        grad = np.bincount(columns, weights=value * error[rows], minlength=dim) + ridge * (w - 0.3) / 1000
        slope = error.sum()
        square_w += grad**2
        square_b += slope**2
        w -= speed * grad / np.sqrt(square_w)
        b -= speed * slope / np.sqrt(square_b)
    out = np.full(1 << BITS, 0.3)
    out[used] = w
    return out * ratio, b


def train(labelled: list[tuple[str, float]], corpus: tuple[np.ndarray, int] | None = None, rounds: int = 4) -> Classifier:
    """Fit on (text, share of reviewers who called it abusive) pairs.

    ``corpus`` says in how many sentences of the whole corpus every n-gram stands, and how many documents
    there are (:func:`sentence_frequencies`); the labelled documents stand in for it when it is not given.

    Each round fits the weights on the hardest sentences of negative documents and the chosen ones
    of positive documents, then chooses anew.  From the second round on documents whose label the
    model of the other half of the documents contradicts strongly, as errors of reviewers would
    be, carry no weight.  The threshold is where held-out scores divide the labels best.
    """
    usable = [(t, y) for t, y in labelled if t and t.strip() and y != 0.5]
    if not any(y > 0.5 for _, y in usable) or not any(y < 0.5 for _, y in usable):
        return Classifier(np.zeros(1 << BITS), 0.0, 1.0)
    bags, y = [sentences(t) for t, _ in usable], np.array([float(y > 0.5) for _, y in usable])
    known: dict[str, int] = {}
    for bag in bags:
        for s in bag:
            known.setdefault(s, len(known))
    every, owners = hashed(list(known))
    lists = np.split(every[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(known)))[:-1])
    ids = [np.array([known[s] for s in bag]) for bag in bags]
    fold = np.arange(len(bags)) % FOLDS
    trust = np.ones(len(bags))
    columns, rows, scale = _gathered(lists)
    # What a document has as a whole, each n-gram once.
    whole = [np.unique(np.concatenate([lists[s] for s in i])) for i in ids]
    if corpus is None:
        corpus = (np.bincount(np.concatenate([lists[s] for i in ids for s in i]), minlength=1 << BITS), len(bags))
    chosen: list[int | None] = [None] * len(bags)
    hard: list[np.ndarray | None] = [None] * len(bags)

    def fit(members: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        good, bad = [k for k in members if y[k] and trust[k]], [k for k in members if not y[k] and trust[k]]
        ratio = _ratio([whole[k] if chosen[k] is None else lists[chosen[k]] for k in good], *corpus)
        if any(chosen[k] is None for k in good):
            w, b = ratio, 0.0
        else:
            picked = [(chosen[k], 1.0, 1.0 / len(good)) for k in good] + [(s, 0.0, 1.0 / len(bad) / len(hard[k])) for k in bad for s in hard[k]]
            w, b = _fit([lists[s] for s, _, _ in picked], np.array([p for _, p, _ in picked]), np.array([v for _, _, v in picked]), ratio)
        return w, b, np.bincount(rows, weights=w[columns], minlength=len(lists)) * scale + b

    out_of_fold = np.zeros(len(bags))
    for turn in range(rounds):
        for part in range(FOLDS):
            _, _, margins = fit(np.flatnonzero(fold != part))
            for k in np.flatnonzero(fold == part):
                out_of_fold[k] = margins[ids[k]].max()
                if y[k]:
                    chosen[k] = int(ids[k][margins[ids[k]].argmax()])
                else:
                    hard[k] = ids[k][np.argsort(-margins[ids[k]])[:HARDEST]]
        low, high = np.median(out_of_fold[y == 0]), np.median(out_of_fold[y == 1])
        middle = _divide(out_of_fold, y, low, high)
        trust = np.where(y == 1, out_of_fold > middle, out_of_fold < middle + (0.25 * (high - middle) if turn < rounds - 1 else 0.0)).astype(float)
        if not (trust * y).any():
            trust = np.ones(len(bags))
    w, b, margins = fit(np.arange(len(bags)))
    scores = np.array([margins[i].max() for i in ids])
    fair = trust > 0
    low, high = np.median(scores[(y == 0) & fair]), np.median(scores[(y == 1) & fair])
    # What has no evidence either way scores the bias and must not pass.
    return Classifier(w, b, max(float(_divide(out_of_fold, y, low, high)), b + CLEAR))


def _divide(scores: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """The threshold with the best F1; in the middle of a plateau of equally good ones."""
    grid = np.linspace(low, high, 201)
    best = []
    for t in grid:
        said = scores > t
        hit = float((said & (y == 1)).sum())
        best.append(2 * hit / max(said.sum() + (y == 1).sum(), 1))
    top = np.flatnonzero(np.array(best) >= max(best) - 0.01)
    return float(grid[int(np.median(top))])


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple[str, float]]:
    """(text, mean judgement) of the labelled documents, at most ``most`` of them."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("share"))
    few = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    # At most ``most`` ids, so they go to the texts and not the texts through a shuffle.
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("share").alias("share")).orderBy("doc_id").collect()
    return [(r["text"], r["share"]) for r in rows]


def sentence_frequencies(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many sentences every hashed n-gram stands, over all documents, and the number of documents.

    Counted in each task first, equal sentences once with their number; a task hands on at most one
    row for each of the hash places, and the driver gets as many, whatever the size of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        total = np.zeros((1 << BITS) + 1, np.int64)

        def add() -> None:
            many, n = list(held), np.array(list(held.values()), np.float64)
            for at in range(0, len(many), 4096):
                places, owners = hashed(many[at : at + 4096])
                total[:-1] += np.bincount(places, weights=n[at + owners], minlength=1 << BITS).astype(np.int64)
            held.clear()

        for batch in batches:
            for t in batch["_text"]:
                own = sentences(t)
                held.update(own)
                total[-1] += bool(own)
            if len(held) > 100_000:
                add()
        add()
        places = np.flatnonzero(total)
        yield pd.DataFrame({"place": places.astype(np.int32), "n": total[places]})

    counted = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).mapInPandas(count, "place int, n long")
    rows = counted.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def score_documents(documents: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, abusive)`` of every document, null and blank ones included (never abusive)."""
    sent = documents.sparkSession.sparkContext.broadcast((classifier.weights.astype(np.float32), classifier.bias, classifier.threshold))
    picked = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = picked.schema["_key"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Classifier(*sent.value)
        seen: dict[str, float] = {}
        for batch in batches:
            if len(seen) > 200_000:
                seen.clear()
            scores = model.scores(batch["_text"].tolist(), seen)
            yield pd.DataFrame({"_key": batch["_key"], "score": scores, "abusive": scores > model.threshold})

    return picked.mapInPandas(score, f"_key {kind}, score double, abusive boolean").withColumnRenamed("_key", key)


def source_rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """``(source, n_documents, n_abusive, rate)``; documents without a source form a group of their own."""
    flags = scored.groupBy("doc_id").agg(F.bool_or("abusive").alias("abusive"))
    joined = documents.select("doc_id", "source").join(flags, "doc_id", "left")
    hit = F.count(F.when(F.col("abusive"), 1))
    return joined.groupBy("source").agg(F.count("*").alias("n_documents"), hit.alias("n_abusive"), F.round(hit / F.count("*"), 6).alias("rate"))
