from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.splitting import oversized_items, split_items, split_points


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가나다 .\nab", max_size=900), st.integers(20, 200), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limit(text, most, overlap):
    points = split_points(text, most, overlap)
    assert points[0][0] == 0 and points[-1][1] == len(text)
    assert all(end - start <= most for start, end in points)
    for (_, end), (start, _) in zip(points, points[1:], strict=False):
        assert start == end - overlap
    joined = text[slice(*points[0])] + "".join(text[start + overlap : end] for start, end in points[1:])
    assert joined == text


def test_cut_at_the_change_of_topic():
    one = " ".join(f"The library lends books and the library keeps books {w}." for w in ("safe", "dry", "clean", "near"))
    two = " ".join(f"Dormitory rooms need a deposit and dormitory rooms need a key {w}." for w in ("soon", "early", "again", "there"))
    text = f"{one} {two}"
    assert split_points(text, len(one) + 150, 20)[0][1] == len(one) + 1


def test_text_without_any_boundary_is_cut_at_the_limit():
    points = split_points("x" * 2000, 900, 120)
    assert points[0] == (0, 900)
    assert points[1][0] == 780


def test_limit_and_bad_overlap():
    assert split_points("x" * 900) == [(0, 900)]
    assert split_points("") == [(0, 0)]
    with pytest.raises(ValueError):
        split_points("x" * 10, 5, 5)


def test_operator(spark):
    schema = "prep_id long, blocks array<struct<text: string>>, chunks array<struct<chunk_id: int, text: string>>, piece string"
    long = "가나다라. " * 300
    rows = [(1, [("short",), None, (long,), (None,)], [(7, long), (7, long), None, (8, "x" * 900), (None, "x" * 901)], "clash"), (2, None, None, None), (3, [], [], None)]
    df = spark.createDataFrame(rows, schema)
    items = oversized_items(df)
    pieces = split_items(items, ["prep_id", "item_kind", "item_no"]).collect()
    assert {(p.prep_id, p.item_kind, p.item_no) for p in pieces} == {(1, "block", 3), (1, "chunk", 7), (1, "chunk", None)}
    assert max(len(p.piece) for p in pieces) <= 900
    assert split_items(oversized_items(df.limit(0)), ["prep_id"]).count() == 0
