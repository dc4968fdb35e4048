from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.packing import byte_cuts, harmonic_bins, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_no_bin_overflows_and_nothing_is_lost(sizes):
    bins = harmonic_bins(sizes, 100)
    assert len(bins) == len(sizes)
    load = {}
    for b, s in zip(bins, sizes, strict=True):
        load[b] = load.get(b, 0) + s
    assert all(v <= 100 for v in load.values())


def test_little_space_is_left():
    rng = random.Random(2)
    sizes = [min(4096, int(rng.lognormvariate(6.8, 1))) + 1 for _ in range(8000)]
    sizes = [min(s, 4096) for s in sizes]
    bins = harmonic_bins(sizes, 4096)
    assert sum(sizes) / (len(set(bins)) * 4096) > 0.97


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="가a 나\n😀", max_size=300), st.integers(16, 60))
def test_cuts_keep_characters_whole(text, capacity):
    data = text.encode()
    edges = [0, *byte_cuts(data, capacity), len(data)]
    assert "".join(data[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)) == text
    assert all(b - a <= capacity for a, b in zip(edges, edges[1:-1], strict=False))
    assert edges[-1] - edges[-2] + 1 <= capacity


def test_operator(spark):
    rows = [(1, "가" * 3000), (2, None), (3, ""), (4, "short"), (4, "short"), (5, "x" * 4095), (6, "x" * 4096), (7, "a b" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, container string")
    found = pack(df).collect()
    pieces = {}
    load = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.start, r.tokens))
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert {d for d, p in pieces.items() if len(p) > 1 and d != 4} == {1, 6, 7}
    assert set(pieces) == {1, 3, 4, 5, 6, 7} and len(pieces[4]) == 2
    assert max(load.values()) <= 4096
    for doc, size in ((1, 9001), (7, 300_001)):
        assert sum(t for _, t in pieces[doc]) == size
    assert pack(df.limit(0)).count() == 0


def test_repeated_rows_are_dealt_out(spark, monkeypatch):
    from corpusmill.llm import packing

    monkeypatch.setattr(packing, "CONTAINERS_A_TASK", 20)
    df = spark.createDataFrame([(1, "x" * 1000)], "doc_id long, text string").crossJoin(spark.range(1200).select()).repartition(3)
    found = pack(df).collect()
    assert len(found) == 1200
    groups = {}
    for r in found:
        groups[r.container.split("-")[0]] = groups.get(r.container.split("-")[0], 0) + 1
    # 1.2 million tokens are about 15 groups, none of which has a great part of the rows.
    assert len(groups) > 10 and max(groups.values()) < 200
