"""Text features, overlap with a reference corpus, and the hashing embedder."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import folded

TOKEN = "[0-9a-zA-Z\\uac00-\\ud7a3]+"


def content_features(text: Column) -> Column:
    """``tok:`` features of every token and ``tri:`` features of the trigrams of tokens of four or more characters."""
    tokens = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.concat(F.lit("tri:"), F.substring(t, i, F.lit(3))))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(F.concat(F.lit("tok:"), t)), F.when(F.length(t) >= 4, grams(t)).otherwise(F.array().cast("array<string>")))))


def feature_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, feature, n)``, combined before the shuffle."""
    return documents.select(F.col(key), F.explode(content_features(F.col(text))).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("n"))


def feature_set(documents: DataFrame, text: str) -> DataFrame:
    """``(feature)``: the distinct features of a corpus."""
    return documents.select(F.explode(content_features(F.col(text))).alias("feature")).distinct()


def overlap_ratio(documents: DataFrame, key: str, text: str, reference: DataFrame) -> DataFrame:
    """``(key, total, matched, ratio)``: the share of a document's features that ``reference`` has.

    Documents without features have ratio 0.  Both sides are shuffled on the feature; AQE splits
    the few features that are very frequent.
    """
    counts = feature_counts(documents, key, text)
    marked = counts.join(reference.select("feature", F.lit(1).alias("known")), "feature", "left")
    sums = marked.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("matched"))
    full = documents.select(key).distinct().join(sums, key, "left")
    total, matched = F.coalesce("total", F.lit(0)), F.coalesce("matched", F.lit(0))
    return full.select(key, total.alias("total"), matched.alias("matched"), F.when(total > 0, matched / total).otherwise(0.0).alias("ratio"))


_TOKENS = re.compile("[0-9a-zA-Z가-힣]+")


def hashed_vector(text: str | None, dim: int = 384) -> list[float]:
    """The hashing embedding: signed, log-damped counts of tokens, token trigrams and character
    trigrams, folded into ``dim`` places by an 8-byte blake2b hash, of unit length, rounded to 8
    places; zeros for a text without features."""
    plain = " ".join((text or "").replace(" ", " ").split()).lower()
    counts: Counter[str] = Counter()
    for token in _TOKENS.findall(plain):
        counts[f"tok:{token}"] += 1
        if len(token) >= 4:
            counts.update(f"tri:{token[i : i + 3]}" for i in range(len(token) - 2))
    counts.update(f"chr:{gram}" for i in range(len(plain) - 2) if (gram := plain[i : i + 3]).strip())
    vector = [0.0] * dim
    for feature, count in counts.items():
        value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        vector[value % dim] += (1.0 if (value >> 8) & 1 else -1.0) * (1.0 + math.log(count))
    norm = math.sqrt(sum(x * x for x in vector))
    return [round(x / norm, 8) for x in vector] if norm else vector


def with_hashed_vector(documents: DataFrame, text: str, dim: int = 384, name: str = "embedding") -> DataFrame:
    """``documents`` with their hashing embedding, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: hashed_vector(t, dim))

    return documents.withColumn(name, embed(F.col(text)))


def with_model_vector(documents: DataFrame, text: str, load: Callable[[], Callable[[list[str]], Any]], dim: int = 384, batch: int = 32, name: str = "embedding") -> DataFrame:
    """``documents`` with the vector a model gives their text, of unit length, rounded to 8 places.

    ``load`` makes the model, once in every worker; the model takes a list of at most ``batch`` texts and
    gives one vector of ``dim`` numbers for each.  Blank and null texts have a null vector, and so has
    one whose numbers are all zero; a vector of another size or with non-finite numbers is an error.
    """

    def one(vector: Any) -> list[float] | None:
        values = np.asarray(vector, np.float64)
        if values.shape != (dim,) or not np.isfinite(values).all():
            raise ValueError(f"the model gave no vector of {dim} finite numbers")
        norm = np.linalg.norm(values)
        return [round(x, 8) for x in (values / norm).tolist()] if norm else None

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                for i, vector in zip(part, model([texts.iloc[i] for i in part]), strict=True):
                    out[i] = one(vector)
            yield pd.Series(out)

    return documents.withColumn(name, embed(F.col(text)))
