"""Questions into search form, and search results into prompts and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import truncated

# Phrases that carry no meaning for search.
FILLERS = (
    "안녕하세요", "안녕하십니까", "안녕", "감사합니다", "감사해요", "알 수 있을까요", "알려 주세요", "알려주세요", "알려줄래요", "알려줄 수", "자세하게", "자세히", "자세한", "구체적으로",
    "하려고 하는데", "하려는데", "하고 싶은데", "하고 싶어요", "어떻게 해야 되나요", "어떻게 해야 하나요", "어떻게 되나요", "어떻게 하나요", "친구 한 명이", "친구 중에", "친구가", "제가", "저는", "저희", "내가", "나는", "혹시", "좀",
)
# Abbreviations and what they stand for (an institution adds its own, such as those of its campuses).
ABBREVIATIONS = {"복전": "복수전공", "부전": "부전공", "교직": "교직과정", "근장": "근로장학생", "현장실습": "현장실습학기제", "교환학": "교환학생", "졸유": "졸업유예", "조졸": "조기졸업", "국장": "국가장학금"}
# Words that are added where a word stands and they do not.
SYNONYMS = {"교환학생": ("교환수학", "해외수학"), "교환": ("교환학생",), "결석": ("결강", "출결"), "출석": ("출결",), "결강": ("결석",), "출결": ("결석",), "휴강": ("강의 휴업",), "재이수": ("재수강",)}
NO_RESULT = "관련 문서를 찾지 못했습니다."


def _trimmed(text: str) -> str:
    return re.sub(r"[?!.\s]+$", "", re.sub(r"\s+", " ", text.replace(" ", " ")).strip())


def transform(question: str, abbreviations: dict[str, str] = ABBREVIATIONS, fillers: tuple[str, ...] = FILLERS, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> str:
    """A question without fillers, with abbreviations spelt out and synonyms added.

    Longer fillers and abbreviations go first; an abbreviation counts only as a word of its own.
    Transforming twice gives what transforming once gives.
    """
    text = _trimmed(question or "")
    for phrase in sorted(fillers, key=len, reverse=True):
        text = text.replace(phrase, " ")
    text = _trimmed(text)
    for short in sorted(abbreviations, key=len, reverse=True):
        text = re.sub(f"(?<![가-힣A-Za-z0-9]){re.escape(short)}(?![가-힣A-Za-z0-9])", abbreviations[short], text)
    text = _trimmed(text)
    for word, others in synonyms.items():
        if word in text:
            text = " ".join([text, *(o for o in others if o not in text)])
    return _trimmed(text)


def with_search_form(questions: DataFrame, column: str, name: str = "search_form", abbreviations: dict[str, str] = ABBREVIATIONS) -> DataFrame:
    """The search form of every question; a question that is nothing but fillers stays as it is."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda q: None if q is None else transform(q, abbreviations) or q)

    return questions.withColumn(name, apply(F.col(column)))


# What a source without a title is called, what stands where there are no sources, and the sections of a prompt.
NO_TITLE = "(제목 없음)"
NO_SOURCES = "(자료 없음)"
SECTIONS = ("[질문]", "[참고 자료]", "[지시]")
INSTRUCTION = "위 자료만 근거로, 시스템 규칙을 지켜 한국어로 답변하세요."
# Where a title and an address come from, in this order, ``row:`` from a column.
TITLE_CHAIN = ("doc_title", "source_file", "title", "row:title", "row:source_slug")
URL_CHAIN = ("row:url", "doc_url", "source_page_url", "attachment_url")


def _chain(rows: DataFrame, metadata: str, names: tuple[str, ...], default: str) -> Column:
    """The first value that is not empty."""
    values = [F.col(n.removeprefix("row:")) if n.startswith("row:") else F.try_element_at(F.col(metadata), F.lit(n)) for n in names if not n.startswith("row:") or n.removeprefix("row:") in rows.columns]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def as_sources(results: DataFrame, metadata: str = "metadata") -> DataFrame:
    """``(title, uri, content, similarity)`` of search results, as an answer lists them; '' and 0 for what is missing."""
    return results.select(
        _chain(results, metadata, TITLE_CHAIN, NO_TITLE).alias("title"), _chain(results, metadata, URL_CHAIN, "").alias("uri"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def prompt_blocks(results: DataFrame, rank: str, most_chars: int = 1200) -> DataFrame:
    """``(rank, block)``: ``[i] title``, the address where there is one, and the beginning of the content."""
    title = _chain(results, "metadata", tuple(n for n in TITLE_CHAIN if n != "row:title"), NO_TITLE)
    url = _chain(results, "metadata", URL_CHAIN, "")
    head = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), title)
    lines = F.array(head, F.when(url != "", F.concat(F.lit("URL: "), url)), truncated(F.coalesce("content", F.lit("")), most_chars))
    return results.select(F.col(rank).alias("rank"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("block"))


def prompt(results: DataFrame, rank: str, question: str, most_chars: int = 1200) -> DataFrame:
    """One row ``(prompt)``: the question, the blocks in order or that there are none, and the instruction.

    The results of one search are few, by its k.
    """
    parts = F.array_sort(F.collect_list(F.struct("rank", "block")))
    blocks = F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n")
    shown = F.when(F.count("*") > 0, F.regexp_replace(blocks, r"(?U)\s+$", "")).otherwise(NO_SOURCES)
    asked, known, told = SECTIONS
    return prompt_blocks(results, rank, most_chars).agg(F.concat(F.lit(f"{asked}\n{question}\n\n{known}\n"), shown, F.lit(f"\n\n{told}\n{INSTRUCTION}")).alias("prompt"))


def ask(question: str, search: Callable[[str], list[dict]], generate: Callable[[str, list[dict]], str]) -> dict:
    """The answer to a question with its sources; ``search`` and ``generate`` are given (an index, a language model)."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    found = search(transform(question) or question)
    return {"answer": generate(question, found) if found else NO_RESULT, "sources": found}
