"""Ranked search over sources and chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.scoring import first_case

# What a question has to contain to ask for a kind of document, and what that is worth.
FORM_WORDS = ("서식", "양식", "신청서", "제출서류", "별지", "다운로드", "파일", "원서", "확인서")
APPENDIX_WORDS = ("별표", "기준표", "금액표", "배점표", "목록", "등급표")
TOPIC_WORDS = {
    "non_curricular": ("비교과", "프로그램", "특강", "교육", "마일리지"),
    "academic": ("학사", "수강", "휴학", "복학", "졸업", "성적", "시험", "전과"),
    "tuition_scholarship": ("등록", "등록금", "장학", "장학금", "납부", "고지서"),
    "recruitment": ("초빙", "채용", "모집", "교원", "직원", "강사"),
    "notice": ("공지", "공지사항", "안내"),
}
FORM_BOOST, APPENDIX_BOOST, TOPIC_BOOST = 0.14, 0.10, 0.08


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query vector in double precision; null for null, zero, non-finite or differently long vectors.

    One matrix product for each Arrow batch; the vectors go to Python, nothing else of the row does.
    """
    wanted = np.asarray(query, np.float64)
    size = float(np.linalg.norm(wanted))

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        right = np.flatnonzero(lengths == len(wanted))
        out = np.full(len(vectors), np.nan)
        if len(right) and size > 0:
            flat = vectors.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            rows = flat[vectors.offsets.to_numpy()[:-1][right][:, None] + np.arange(len(wanted))]
            with np.errstate(all="ignore"):
                out[right] = (rows @ wanted) / (np.sqrt((rows * rows).sum(1)) * size)
        return pa.array(out, mask=np.isnan(out))

    # Not deterministic for the planner, which would otherwise score once for the filter and once more for the column.
    return score.asNondeterministic()(vector)


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right wins, whatever the session's policy for repeated keys."""
    left, right = F.coalesce(left, F.create_map().cast("map<string,string>")), F.coalesce(right, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def contains(metadata: Column, wanted: dict[str, str]) -> Column:
    """Whether a map has all the given entries; the empty filter matches everything."""
    test = F.lit(True)
    for key, value in wanted.items():
        test = test & F.coalesce(F.try_element_at(metadata, F.lit(key)) == F.lit(value), F.lit(False))
    return test


def _holds(value: Any, wanted: Any) -> bool:
    """JSON containment: objects by key, arrays by some equal or containing element, the rest by value."""
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and _holds(value[k], w) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(_holds(v, w) for v in value) for w in wanted)
    if isinstance(value, list) or isinstance(value, bool) != isinstance(wanted, bool):
        return False
    return value == wanted


def contains_json(document: Column, wanted: dict) -> Column:
    """Whether JSON text contains ``wanted``, at any depth; null and malformed text contain nothing.

    Flat filters on maps are :func:`contains`, which stays in the JVM.
    """

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: _in_json(text, wanted)).astype(bool)

    return test(document)


def _in_json(text: str | None, wanted: dict) -> bool:
    try:
        return text is not None and _holds(json.loads(text), wanted)
    except ValueError:
        return False


@dataclass(frozen=True)
class Intent:
    """What a question asks for besides its meaning."""

    form: float = 0.0
    appendix: float = 0.0
    topic: str = ""
    topic_boost: float = 0.0

    @classmethod
    def of(cls, question: str, dataset: str) -> Intent:
        """Boosts by keyword; a department's pages have none, and topics are those of notices."""
        text = " ".join(question.split()).lower()
        has = lambda words: any(w in text for w in words)
        if dataset not in ("rule", "notice", "student_life"):
            return cls()
        topic = next((t for t, words in TOPIC_WORDS.items() if has(words)), "") if dataset == "notice" else ""
        return cls(FORM_BOOST if has(FORM_WORDS) else 0.0, APPENDIX_BOOST if has(APPENDIX_WORDS) else 0.0, topic, TOPIC_BOOST if topic else 0.0)

    def boost(self, metadata: Column) -> Column:
        """The boost of a document, the first that applies."""
        value = lambda k: F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))
        kind = F.coalesce(F.try_element_at(metadata, F.lit("document_kind")), F.try_element_at(metadata, F.lit("attachment_kind")), F.lit(""))
        named = lambda pattern: value("source_file").rlike(pattern) | value("attachment_name").rlike(pattern)
        return first_case(
            [
                (F.lit(self.form > 0) & ((kind == "form") | (value("is_form") == "true") | named("별지|서식")), self.form),
                (F.lit(self.appendix > 0) & ((kind == "appendix_table") | (value("is_appendix_table") == "true") | named("별표")), self.appendix),
                (F.lit(self.topic_boost > 0) & (value("notice_topic") == self.topic), self.topic_boost),
            ],
            0.0,
        )


def joined(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of active sources with their source's columns and the merged metadata.

    The planner broadcasts the sources when their size allows, by its own threshold.
    """
    s = sources.where(F.col("status") == "active").alias("s")
    return chunks.alias("c").join(s, F.col("c.source_id") == F.col("s.id")).select(
        F.col("c.id").alias("id"), F.col("c.source_id"), F.col("s.source_slug"), F.col("s.source_type"), F.col("s.title"), F.col("s.url"), F.col("s.parent_url"), F.col("c.chunk_id"), F.col("c.chunk_index"),
        F.col("c.content"), merged(F.col("s.metadata"), F.col("c.metadata")).alias("metadata"), F.col("c.embedding"),
    )


def match(chunks: DataFrame, sources: DataFrame, query: list[float], k: int = 10, min_similarity: float = 0.35, wanted: dict[str, str] | None = None) -> DataFrame:
    """The k chunks most similar to a query among those that pass the filter; ties by id.

    The top k is kept per task before anything moves, so one small row set is shuffled.
    """
    scored = joined(chunks, sources).where(contains(F.col("metadata"), wanted or {})).withColumn("similarity", cosine(F.col("embedding"), query))
    return scored.where(F.col("similarity") >= min_similarity).drop("embedding").orderBy(F.col("similarity").desc(), "id").limit(max(k, 0))


def ranked(chunks: DataFrame, sources: DataFrame, query: list[float], priority: DataFrame, intent: Intent, k: int = 10, min_similarity: float = 0.35, weight: float = 0.15, by: str = "hybrid") -> DataFrame:
    """Chunks by similarity, or by similarity mixed with the priority of their source plus the boost.

    The threshold is on the similarity itself.  ``priority`` has (source_id, priority_score).
    """
    if not 0.0 <= weight <= 1.0 or k <= 0:
        raise ValueError("the weight must lie between 0 and 1 and k above 0")
    scored = joined(chunks, sources).withColumn("similarity", cosine(F.col("embedding"), query)).where(F.col("similarity") >= min_similarity).drop("embedding")
    scored = scored.join(priority, "source_id", "left").withColumn("priority_score", F.coalesce("priority_score", F.lit(0.0))).withColumn("intent_boost", intent.boost(F.col("metadata")))
    final = scored.withColumn("final_score", F.col("similarity") * (1.0 - weight) + F.col("priority_score") * weight + F.col("intent_boost"))
    order = [F.col("final_score").desc()] * (by == "hybrid") + [F.col("similarity").desc(), F.col("id")]
    return final.orderBy(*order).limit(k)


def by_priority(chunks: DataFrame, sources: DataFrame, priority: DataFrame, intent: Intent, k: int = 10, most_chars: int = 1200) -> DataFrame:
    """Active sources by priority plus boost, with the beginning of their text.

    The k sources are chosen first; only their chunks are gathered.
    """
    scored = sources.where(F.col("status") == "active").join(priority.withColumnRenamed("source_id", "id"), "id", "left")
    scored = scored.withColumn("priority_score", F.coalesce("priority_score", F.lit(0.0)))
    scored = scored.withColumn("final_score", F.col("priority_score") + intent.boost(F.col("metadata")))
    top = scored.orderBy(F.col("final_score").desc(), F.col("priority_score").desc(), F.col("updated_at").desc(), "id").limit(max(k, 0))
    texts = source_texts(chunks.join(top.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    return top.join(texts, top["id"] == texts["source_id"], "left").select(
        F.col("id").alias("source_id"), "source_slug", "title", F.coalesce(F.left("text", F.lit(most_chars)), F.lit("")).alias("content"), "priority_score", "final_score"
    )


def source_texts(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``(source_id, text)``: the chunks of a source joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.coalesce("content", F.lit("")).alias("content"))))
    return chunks.groupBy("source_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), separator).alias("text"))


def fan_out(branches: list[DataFrame], k: int) -> DataFrame:
    """The best k of several ranked lists; equal similarities go by branch, then by place in it."""
    if not branches:
        raise ValueError("no branch to search")
    along = Window.orderBy(F.col("similarity").desc(), "id")
    placed = [b.withColumn("branch", F.lit(i)).withColumn("branch_rank", F.row_number().over(along)) for i, b in enumerate(branches)]
    union = placed[0]
    for other in placed[1:]:
        union = union.unionByName(other)
    return union.orderBy(F.col("similarity").desc(), "branch", "branch_rank").limit(max(k, 0))


def search_branches(branches: dict[str, Callable[[], DataFrame]], k: int) -> tuple[list[dict], dict[str, str]]:
    """(the best k rows of all branches, what went wrong by the name of the branch).

    Each branch is run by itself, so that one that fails leaves the others' results; if all fail the
    first error is raised.  Every branch gives a ranked list of at most its own k rows.
    """
    if not branches:
        raise ValueError("no branch to search")
    found: list[tuple[float, int, int, dict]] = []
    failed: dict[str, Exception] = {}
    for number, (name, branch) in enumerate(branches.items()):
        try:
            rows = branch().orderBy(F.col("similarity").desc(), "id").collect()
        except Exception as error:  # noqa: BLE001 - any fault of a branch is reported, none ends the search
            failed[name] = error
            continue
        found += [(-row["similarity"], number, place, {**row.asDict(recursive=True), "branch": number}) for place, row in enumerate(rows)]
    if len(failed) == len(branches):
        raise next(iter(failed.values()))
    return [row for *_, row in sorted(found, key=lambda f: f[:3])[: max(k, 0)]], {name: f"{type(error).__name__}: {error}"[:300] for name, error in failed.items()}
