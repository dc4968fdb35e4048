from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.dates import latest_date, lenient_date
from corpusmill.operators import browse, chunking, features, questions, scoring, search, state, store, tree

TODAY = dt.date(2025, 7, 1)


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_cut_long_prefers_marks_then_blanks():
    text = "a" * 85 + "." + "b" * 60
    assert chunking.cut_long(text, 100, 10) == [text[:86], text[76:]]
    text = "a" * 90 + " " + "b" * 60
    assert chunking.cut_long(text, 100, 10)[0] == text[:91]
    assert [len(p) for p in chunking.cut_long("x" * 250, 100, 10)] == [100, 100, 70]
    assert chunking.cut_long("x" * 25, 10, 10) == ["x" * 10, "x" * 10, "x" * 5]


@pytest.mark.parametrize("size", [899, 900, 901, 1020])
def test_packed_sizes(size):
    chunks = chunking.packed(["x" * size])
    assert chunks[0]["num_chars"] <= 900 and [c["chunk_id"] for c in chunks] == list(range(1, len(chunks) + 1))
    assert max(c["num_chars"] for c in chunks) <= 900 + 120 + 1


def test_packed_carries_the_tail():
    chunks = chunking.packed(["a" * 500, "b" * 500], 900, 120)
    assert [c["text"] for c in chunks] == ["a" * 500, "a" * 120 + "\n" + "b" * 500]
    assert chunking.packed([], 900, 120) == [] and chunking.packed([""], 900, 120) == []


def test_sectioned_names_its_sections():
    chunks = chunking.sectioned([("x" * 600, "one"), ("y" * 600, "two")], 900, 120)
    assert [c["sections"] for c in chunks] == [["one"], ["overlap", "two"]]


def test_chunks_of_documents_and_fallback(spark):
    rows = [(1, [("one line",), (None,), ("two",)], "f.pdf"), (2, [], "g.pdf"), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, blocks array<struct<text: string>>, name string")
    out = {r.id: r for r in chunking.with_chunks(df, fallback=chunking.fallback_text([("file", F.col("name"))])).collect()}
    assert out[1].chunks[0].text == "one line\ntwo" and not out[1].used_metadata_fallback
    assert out[2].chunks[0].text == "file: g.pdf" and out[2].used_metadata_fallback
    assert out[3].chunks == [] and not out[3].used_metadata_fallback


def test_hashed_vector():
    assert features.hashed_vector("", 8) == [0.0] * 8 and features.hashed_vector(None, 8) == [0.0] * 8
    vector = features.hashed_vector("장학금 장학금 신청", 384)
    assert math.isclose(sum(x * x for x in vector), 1.0, rel_tol=1e-6)
    assert vector == features.hashed_vector(" 장학금  장학금 신청 ", 384)


def test_features_and_overlap(spark):
    df = spark.createDataFrame([(1, "abcde xy"), (2, ""), (3, None)], "id int, t string")
    counts = {(r.id, r.feature): r.n for r in features.feature_counts(df, "id", "t").collect()}
    assert counts == {(1, "tok:abcde"): 1, (1, "tri:abc"): 1, (1, "tri:bcd"): 1, (1, "tri:cde"): 1, (1, "tok:xy"): 1}
    reference = spark.createDataFrame([("tok:xy",)], "feature string")
    assert {(r.id, r.ratio) for r in features.overlap_ratio(df, "id", "t", reference).collect()} == {(1, 0.2), (2, 0.0), (3, 0.0)}


def test_dates(spark):
    texts = {"20240305": (2024, 3, 5), "2024-03-05": (2024, 3, 5), "2024.3.5": (2024, 3, 5), "2024년 3월": (2024, 3, 1), "2024": (2024, 1, 1), "2024-13-01": None, "none": None}
    for t, day in texts.items():
        assert one(spark, lenient_date(F.lit(t))) == (dt.date(*day) if day else None), t
    assert one(spark, latest_date(F.lit("2023-01-01"), F.lit("held 2024.5.6 and 2022"), F.lit(None).cast("string"))) == dt.date(2024, 5, 6)
    assert one(spark, latest_date(F.lit("x"))) is None


def test_scores(spark):
    meta = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv]) if kw else F.create_map().cast("map<string,string>")
    kind = lambda title, rules=False, **kw: one(spark, scoring.document_kind(F.lit(title), meta(**kw), rules))
    assert [kind("별표 제1호"), kind("신청서 양식"), kind("안내"), kind("안내", source_kind="file"), kind("안내", is_form="yes"), kind("x", document_kind="attachment")] == ["appendix_table", "form", "post", "attachment", "form", "attachment"]
    assert [kind("신청서", True), kind("별지 제2호 서식", True), kind("x", True)] == ["rule_text", "form", "rule_text"]
    days = [dt.date(2025, 7, 1), dt.date(2024, 9, 1), dt.date(2023, 9, 1), dt.date(2022, 9, 1), dt.date(2021, 1, 1), dt.date(2010, 1, 1), None, dt.date(2030, 1, 1)]
    assert [one(spark, scoring.recency(F.lit(d).cast("date"), TODAY)) for d in days] == [1.0, 0.88, 0.72, 0.55, 0.30, 0.15, 0.35, 1.0]
    assert one(spark, scoring.authority(meta(subcategory="regulation"), F.lit("hak"))) == "school_rule"
    assert one(spark, scoring.authority(meta(subcategory="regulation"), F.lit(""))) == "regulation"
    tree_value = lambda k, d: one(spark, scoring.tree_score(F.lit(k), F.lit(True), F.lit(d)))
    assert [tree_value("regulation", "2"), tree_value("regulation", "x"), tree_value("school_rule", "9"), tree_value("unknown", "1")] == [1.0, 0.80, 0.90, 0.40]
    assert one(spark, scoring.is_top_rule(F.lit("우리대학교 학칙"), meta(doc_type="hak"), ["우리대학교 학칙"]))
    assert one(spark, scoring.attachment_kind(F.lit("별표 3 서식")))["kind"] == "appendix_table"
    assert one(spark, scoring.notice_topic(meta(category="등록·장학"))) == "tuition_scholarship"
    assert one(spark, scoring.is_repealed(F.lit("규정 폐지"), F.lit("x")))
    assert one(spark, scoring.page_role(F.lit("교육과정 안내"), meta()))["score"] == 1.0


def test_upsert_delete_and_keyed_table(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, v string").schema
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], schema)
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], schema)
    once = store.upsert(old, new, ["id"], ["v"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a"), (2, "y"), (3, "z"), (None, "n")] or sorted(map(tuple, once.collect()), key=str) == [(1, "a"), (2, "y"), (3, "z"), (None, "m")]
    assert sorted(map(tuple, store.upsert(once, new, ["id"], ["v"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    table = store.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], schema)
    assert not table.exists() and table.read().count() == 0
    table.upsert(old)
    table.upsert(new, ["v"])
    table.delete(spark.createDataFrame([(1,)], "id int"))
    assert sorted(r.id for r in table.read().where("id is not null").collect()) == [2, 3]
    assert len(table.versions()) == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, v string").schema
    table = store.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], schema, buckets=8)
    table.write(spark.createDataFrame([(i, "a") for i in range(200)], schema))
    before = table.folders()
    table.upsert(spark.createDataFrame([(7, "x"), (1000, "y")], schema), ["v"])
    after = table.folders()
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) <= 2
    rows = {r.id: r.v for r in table.read().collect()}
    assert len(rows) == 201 and rows[7] == "x" and rows[1000] == "y" and rows[8] == "a"
    table.delete(spark.createDataFrame([(i,) for i in range(200)], "id int"))
    assert [r.id for r in table.read().collect()] == [1000]


def test_writer_that_lost_the_race_fails(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "id int, v string").schema
    table = store.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], schema)
    other = store.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], schema)
    monkeypatch.setattr(other, "versions", lambda: [])
    table.write(spark.createDataFrame([(1, "a")], schema))
    with pytest.raises(RuntimeError):
        other.write(spark.createDataFrame([(2, "b")], schema))
    assert [r.v for r in table.read().collect()] == ["a"]


def test_quarantine(spark):
    good, bad = store.quarantine(spark.createDataFrame([("user",), ("x",), (None,)], "role string"), {"role": F.col("role").isin("user")})
    assert good.count() == 1 and sorted((r.role or "", r.failed_tests) for r in bad.collect()) == [("", ["role"]), ("x", ["role"])]


def test_search(spark):
    sources = spark.createDataFrame([("s1", "s1", "pdf", "t", None, None, {"category": "a", "k": "1"}, "active", dt.datetime(2025, 1, 1)), ("s2", "s2", "pdf", "t", None, None, {}, "deleted", dt.datetime(2025, 1, 1))], "id string, source_slug string, source_type string, title string, url string, parent_url string, metadata map<string,string>, status string, updated_at timestamp")
    chunks = spark.createDataFrame([("c1", "s1", 1, 0, "x", {"category": "b"}, [1.0, 0.0]), ("c2", "s1", 2, 1, "y", None, [1.0, 1.0]), ("c3", "s2", 1, 0, "z", {}, [1.0, 0.0]), ("c4", "s1", 3, 2, "n", {}, None), ("c5", "s1", 4, 3, "n", {}, [float("nan"), 1.0])], "id string, source_id string, chunk_id int, chunk_index int, content string, metadata map<string,string>, embedding array<float>")
    found = search.match(chunks, sources, [1.0, 0.0], 10, 0.0).collect()
    assert [(r.id, round(r.similarity, 4)) for r in found] == [("c1", 1.0), ("c2", 0.7071)]
    assert found[0].metadata == {"category": "b", "k": "1"}
    assert search.match(chunks, sources, [1.0, 0.0], -3, 0.0).count() == 0
    assert [r.id for r in search.match(chunks, sources, [1.0, 0.0], 5, 0.0, {"category": "a"}).collect()] == ["c2"]
    priority = spark.createDataFrame([("s1", 0.5)], "source_id string, priority_score double")
    top = search.ranked(chunks, sources, [1.0, 0.0], priority, search.Intent(), 1, 0.0).first()
    assert math.isclose(top.final_score, 0.85 + 0.075)
    with pytest.raises(ValueError):
        search.ranked(chunks, sources, [1.0, 0.0], priority, search.Intent(), 1, 0.0, weight=2)
    assert search.by_priority(chunks, sources, priority, search.Intent()).first().content == "x\n\ny\n\nn\n\nn"


def test_intent():
    assert search.Intent.of("장학금 신청서", "notice") == search.Intent(0.14, 0.0, "tuition_scholarship", 0.08)
    assert search.Intent.of("신청서", "department") == search.Intent()


def test_state(spark):
    old = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", None), (3, "c", [])], "k int, t string, c array<string>")
    new = spark.createDataFrame([(1, "a", ["y", "x", "x"]), (2, "B", None), (4, "d", [])], "k int, t string, c array<string>")
    assert {(r.k, r.kind) for r in state.change_kinds(old, new, "k", ["t"], ["c"]).collect()} == {(1, "skipped"), (2, "updated"), (3, "missing"), (4, "new")}
    known = spark.createDataFrame([(1, 0), (2, 2)], "k int, miss_count int")
    seen = spark.createDataFrame([(3,)], "k int")
    assert {tuple(r) for r in state.misses(known, seen, "k").collect()} == {(1, 1, False), (2, 3, True), (3, 0, False)}
    assert {tuple(r) for r in state.misses(known, seen, "k", counting=False).collect()} == {(1, 0, False), (2, 2, False), (3, 0, False)}


def test_tree_with_cycle_and_orphan(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("o", "gone"), (None, "a")], "id string, parent_id string")
    assert {(r.id, r.depth) for r in tree.tree_paths(nodes).collect()} == {("a", 0), ("b", 1), ("c", 2), ("o", 0)}


CASES = [
    ("수강신청 기간", "수강신청 기간"), ("장학금", "장학금"), ("안녕하세요 휴학 절차 알려주세요", "휴학 절차"), ("복전 신청 어떻게 하나요", "복수전공 신청"), ("교직이수 안내", "교직이수 안내"), ("교직 이수 안내", "교직과정 이수 안내"),
    ("교환학생 가는 방법", "교환학생 가는 방법 교환수학 해외수학"), ("본교 위치", "본교캠퍼스 위치"), ("본교캠 셔틀", "본교캠퍼스 셔틀"), ("본교에서 출발", "본교에서 출발"), ("저는 결석 처리 어떻게 되나요", "결석 처리 결강 출결"), ("복학 신청 기간", "복학 신청 기간"),
]


@pytest.mark.parametrize(("asked", "wanted"), CASES)
def test_questions(asked, wanted):
    table = {**questions.ABBREVIATIONS, "본교": "본교캠퍼스", "본교캠": "본교캠퍼스"}
    assert questions.transform(asked, table) == wanted
    assert questions.transform(wanted, table) == wanted


def test_ask():
    with pytest.raises(ValueError):
        questions.ask(" ", lambda q: [], lambda q, s: "")
    assert questions.ask("휴학", lambda q: [], lambda q, s: "x") == {"answer": questions.NO_RESULT, "sources": []}
    assert questions.ask("휴학", lambda q: [{"id": 1}], lambda q, s: f"{q}{len(s)}")["answer"] == "휴학1"


def test_browse(spark):
    docs = spark.createDataFrame([(1, "장학 안내", "a", "2025-01-02", 1), (2, "Camp Notice", "b", None, 0), (3, None, "a", "2024-01-01", 0)], "id int, title string, category string, date string, n_attachments int")
    ids = lambda **kw: [r.id for r in browse.documents_view(docs, **kw).collect()]
    assert ids() == [1, 3, 2] and ids(newest_first=False) == [2, 3, 1]
    assert ids(title="campnotice") == [2] and ids(since=dt.date(2025, 1, 1)) == [1, 2] and ids(with_attachments=True) == [1]
    assert [r.id for r in browse.page(docs.orderBy("id"), 2, 2).collect()] == [3]
    assert browse.visible(docs, []).count() == 0
    assert one(spark, browse.stored_sources(F.lit('[{"title": " "}]')))[0].title == "제목 없음"
    assert one(spark, browse.stored_sources(F.lit("broken"))) == []
