from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ids, text


def of(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v")), "i").orderBy("i").collect()]


def test_normalized_lines(spark):
    values = ["a b​c", " a\t\tb \r\n c\rd ", "x\x01y", "one two", "\n\n", "", None, "é é"]
    assert of(spark, text.normalized_lines, values) == ["a bc", "a b\nc\nd", "x y", "one\ntwo", "", "", "", "é é"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a ──── b", "a b"), ("see ^1) ^2) ^3) there", "see there"), ("note ^12) end", "note end"), ("sum =SUM(A1:B2)x done", "sum done"), ("fmt %d, rest", "fmt rest"), ("what??? ok", "what ok"), ("1. Intro ........ 5", "1. Intro 5"),
        ("wow!!!!! yes", "wow!! yes"), ("신 청 기 간 안내", "신청기간 안내"), ("가 나 다", "가 나 다"), ("a\n---\nb\n3 / 7\nc", "a\nb\nc"), ("a\na\nb\na", "a\nb\na"), ("a\n===\na", "a"), ("", ""), (None, ""), ("ééééé", "ééééé"),
    ],
)
def test_cleaned(spark, raw, clean):
    assert of(spark, text.cleaned, [raw]) == [clean]


def test_block_text_is_one_line(spark):
    assert of(spark, text.block_text, ["a\nb\n\nc"]) == ["a b c"]


def test_consecutive_distinct(spark):
    assert of(spark, text.consecutive_distinct, [["a", "a", "b", "a", None, None], [], None], "array<string>") == [["a", "b", "a", None], [], None]


def test_small_functions(spark):
    assert of(spark, text.token_count, ["a b  c", "", " ", None]) == [3, 0, 0, 0]
    assert of(spark, lambda c: text.truncated(c, 4), ["abcd", "abcde", "ab  e", None]) == ["abcd", "abc…", "ab…", None]
    assert of(spark, text.formatted_bytes, [10, 2048, 3 * 1024 * 1024], "long") == ["10 B", "2.0 KB", "3.0 MB"]
    assert of(spark, text.truthy, ["TRUE", " y ", "no", None]) == [True, True, False, False]
    assert of(spark, text.repaired_latin, ["가나".encode().decode("latin-1"), "café", "가", None]) == ["가나", "café", "가", None]
    assert of(spark, text.looks_broken, ["弥辆搬苞" * 30, "가" * 100, "?" * 100, "short"]) == [True, False, True, False]
    assert of(spark, text.line_blocks, ["a\r\n\n b \x0bc", None]) == [["a", "b", "c"], []]
    assert of(spark, lambda c: text.ordered_join(c, "/"), [["b", " a ", "b", "", None]], "array<string>") == ["b/a"]
    assert of(spark, text.without_nul, ["a\0b"]) == ["ab"]
    assert of(spark, text.vector_literal, [[1.0, -2.5]], "array<double>") == ["[1.0,-2.5]"]


def test_keys(spark):
    import hashlib

    row = spark.createDataFrame([("u", None, "s", 3)], "a string, b string, s string, i int").select(ids.slug(F.col("a"), F.col("b")), ids.chunk_key(F.col("s"), F.col("i")), ids.is_uuid(F.lit("1b4e28ba-2fa1-41d2-883f-0016d3cca427"))).first()
    assert tuple(row) == (hashlib.md5(b"u|").hexdigest()[:12], hashlib.sha256(b"s::3").hexdigest()[:16], True)
