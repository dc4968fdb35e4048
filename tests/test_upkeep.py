from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import browse, chunking, features, policies, questions, records, search, store, tree
from corpusmill.sources import rules, sinks, web


def test_model_vectors_by_batches(spark):
    calls = []

    def load():
        def model(texts):
            assert 0 < len(texts) <= 3
            calls.append(len(texts))
            return [[len(t), 0.0] for t in texts]

        return model

    rows = [(1, "abc"), (2, None), (3, "  "), (4, "x" * 100_000)] + [(k, "y") for k in range(5, 15)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, v string").coalesce(1)
    got = {r.id: r.embedding for r in features.with_model_vector(df, "text", load, 2, batch=3).collect()}
    assert got[1] == [1.0, 0.0] and got[2] is None and got[3] is None and got[4] == [1.0, 0.0] and len(got) == 14
    assert features.with_model_vector(df.limit(0), "text", load, 2).count() == 0
    with pytest.raises(Exception, match="finite numbers"):
        features.with_model_vector(df, "text", lambda: lambda texts: [[float("nan"), 1.0] for _ in texts], 2).collect()


def test_prompt_and_sources(spark):
    rows = [
        ("a", "row title", "http://row", "slug", "x" * 30, 0.5, {"doc_title": "", "source_file": "f.pdf", "title": "t"}), ("b", None, None, "slug", None, None, {"attachment_url": "http://att"}), ("c", "row title", "", None, "c", 0.1, None),
    ]
    df = spark.createDataFrame(rows, "id string, title string, url string, source_slug string, content string, similarity double, metadata map<string,string>")
    got = [tuple(r) for r in questions.as_sources(df).collect()]
    assert got == [("f.pdf", "http://row", "x" * 30, 0.5), ("slug", "http://att", "", 0.0), ("row title", "", "c", 0.1)]
    placed = df.withColumn("rank", F.expr("CASE id WHEN 'a' THEN 2 WHEN 'b' THEN 1 ELSE 3 END"))
    text = questions.prompt(placed, "rank", "q?", 10).first()[0]
    assert text == f"[질문]\nq?\n\n[참고 자료]\n[1] slug\nURL: http://att\n\n\n[2] f.pdf\nURL: http://row\n{'x' * 9}…\n\n[3] (제목 없음)\nc\n\n[지시]\n{questions.INSTRUCTION}"
    assert "[참고 자료]\n(자료 없음)\n\n" in questions.prompt(placed.limit(0), "rank", "q?").first()[0]


def test_branches_that_fail(spark):
    good = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "id string, similarity double")
    also = spark.createDataFrame([("c", 0.9)], "id string, similarity double")

    def broken():
        raise OSError("no such index")

    rows, failed = search.search_branches({"x": lambda: good, "y": broken, "z": lambda: also}, 2)
    assert [(r["id"], r["branch"]) for r in rows] == [("b", 0), ("c", 2)] and failed == {"y": "OSError: no such index"}
    with pytest.raises(OSError):
        search.search_branches({"y": broken}, 2)


def test_cosine_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    got = {r.id: r.s for r in df.select("id", search.cosine(F.col("v"), [1.0, 0.0]).alias("s")).collect()}
    assert got[1] == 1.0 and got[7] == pytest.approx(0.6) and all(got[k] is None for k in (2, 3, 4, 5, 6, 8))
    assert df.where("id > 3").select(search.cosine(F.col("v"), [0.0, 0.0]).alias("s")).where("s IS NOT NULL").count() == 0


def test_nested_containment(spark):
    rows = [json.dumps({"a": {"b": [1, {"c": 2, "d": 3}]}, "e": True}), "{", None, "[]", json.dumps({"a": {"b": []}, "e": 1})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    holds = lambda wanted: [r.i for r in df.where(search.contains_json(F.col("j"), wanted)).orderBy("i").collect()]
    assert holds({"a": {"b": [{"c": 2}]}}) == [0] and holds({"a": {}}) == [0, 4] and holds({"e": 1}) == [4] and holds({"e": True}) == [0] and holds({"x": None}) == []


def test_records_and_store_rows(spark):
    rows = [("s1", {"doc_title": "t", "source_kind": "attachment", "attachment_name": "별표 제3호"}, "f.pdf"), ("s2", None, None), ("s3", {"category": "학사안내", "document_kind": "notice"}, "x.json")]
    df = spark.createDataFrame(rows, "slug string, p map<string,string>, f string")
    file = F.coalesce(F.try_element_at("p", F.lit("source_kind")) == "attachment", F.lit(False))
    made = df.select("slug", records.enriched(F.col("p"), file, [F.try_element_at("p", F.lit("attachment_name"))], "notice").alias("p"), "f")
    got = {r.slug: r.p for r in made.collect()}
    assert got["s1"]["document_kind"] == "appendix_table" and got["s1"]["is_appendix_table"] == "true" and got["s1"]["appendix_number"].startswith("별표") and "form_number" not in got["s1"]
    assert got["s2"] == {"document_kind": "post", "attachment_kind": "", "is_form": "false", "is_appendix_table": "false"}
    assert got["s3"]["document_kind"] == "notice" and got["s3"]["notice_topic"] == "academic"
    base = made.select("slug", records.base_metadata({"source_slug": F.col("slug"), "source_file": F.col("f")}, F.col("p")).alias("m"))
    m = {r.slug: r.m for r in base.collect()}
    assert len(m["s2"]) == 29 and m["s2"]["source_file"] == "" and m["s2"]["is_notice"] == "false" and m["s1"]["doc_title"] == "t"
    full = base.select(F.lit("id").alias("id"), F.col("slug").alias("source_slug"), F.lit(1).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit("a\0 b").alias("text"), F.col("m").alias("metadata"), F.array(F.lit(0.5)).alias("embedding"))
    sources, chunks = records.store_rows(full, "model", 1)
    s = {r.id: r for r in sources.collect()}
    assert s["s1"].title == "t" and s["s3"].title == "x.json" and s["s2"].title is None and s["s2"].source_type == "unknown"
    c = chunks.first()
    assert (c.content, c.token_count, c.embedding_dim) == ("a b", 2, 1)


def test_nul_at_any_depth(spark):
    rows = [([{"k\0": ["a\0b", None]}], ("x\0", 1)), (None, None)]
    df = spark.createDataFrame(rows, "a array<map<string, array<string>>>, s struct<t: string, n: int>")
    got = records.clean_of_nul(df).collect()
    assert got[0].a == [{"k": ["ab", None]}] and tuple(got[0].s) == ("x", 1) and got[1].a is None and got[1].s is None


def test_policies(spark):
    chats = spark.createDataFrame([("a", "u", 1), ("b", "v", 1), ("c", None, 1)], "id string, user_id string, at int")
    messages = spark.createDataFrame([("1", "a", 1), ("2", "b", 1), ("3", None, 1)], "id string, chat_id string, at int")
    assert [r.id for r in policies.refused(messages, chats, "u").orderBy("id").collect()] == ["2", "3"]
    mine = spark.createDataFrame([("a", "u", 2), ("d", "u", 2)], chats.schema)
    assert sorted(tuple(r) for r in policies.written_chats(chats, mine, "u", ["at"]).where("user_id = 'u'").collect()) == [("a", "u", 2), ("d", "u", 2)]
    for stolen in ([("b", "u", 2)], [("e", "v", 2)], [("e", None, 2)]):
        with pytest.raises(PermissionError):
            policies.written_chats(chats, spark.createDataFrame(stolen, chats.schema), "u", ["at"])
    with pytest.raises(PermissionError):
        policies.written_messages(messages, chats, spark.createDataFrame([("2", "a", 2)], messages.schema), "u", ["at"])
    assert policies.written_messages(messages, chats, spark.createDataFrame([("9", "a", 2)], messages.schema), "u", ["at"]).count() == 4
    left, kept = policies.deleted_chats(chats, messages, chats.select("id"), "u")
    assert sorted(r.id for r in left.collect()) == ["b", "c"] and sorted(r.id for r in kept.collect()) == ["2", "3"]


def test_rule_data(spark):
    inner = {"mixedNodes": [{"id": "r", "text": " Root ", "data": {"kindType": "hak", "lid": "L1"}}, {"id": "c", "parent": "r", "data": {"name": "Child &amp; co", "kindType": "se"}}, {"id": ""}, {"id": "x", "parent": "y"}, {"id": "y", "parent": "x"}]}
    payloads = [json.dumps({"datas": {"treeData": json.dumps(inner)}}), json.dumps({"ruleTree": [{"id": "z"}]}), "{", None, "[]"]
    nodes = rules.tree_nodes(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    found = {r.id: r for r in rules.rule_tree(nodes).collect()}
    assert set(found) == {"r", "c", "x", "y", "z"} and found["c"].path_titles == ["Root", "Child & co"] and found["c"].parent_lid == "L1" and found["c"].depth == 1
    assert found["x"].depth is None and found["r"].is_target and not found["c"].is_target
    assert tuple(rules.tree_totals(nodes).first()) == (5, 1)
    rows = [json.dumps({"datas": [{"boardSeq": " 7 ", "title": "old"}, {"boardSeq": "7", "title": " new  t", "cont": "<p>a</p><p>b</p>"}, {"boardSeq": ""}, {"title": "x"}]}), "{", None]
    previews = rules.bylaw_previews(spark.createDataFrame([(r,) for r in rows], "payload string"))
    assert [(r.board_seq, r.title) for r in previews.collect()] == [("7", "new t")]
    items = spark.createDataFrame([("7",), ("8",), (None,)], "board_seq string")
    assert sorted((str(r.board_seq), r.preview and r.preview.title) for r in rules.with_previews(items, previews).collect()) == [("7", "new t"), ("8", None), ("None", None)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, ".PDF"), (2, "pdf"), (3, None)], "id int, source_ext string")
    sinks.write_documents(docs, str(tmp_path / "d"), "a")
    sinks.write_documents(docs.limit(1), str(tmp_path / "d"), "b")
    assert sorted(p.name for p in (tmp_path / "d" / "dataset=a").iterdir()) == ["ext=pdf", "ext=unknown"]
    assert spark.read.json(str(tmp_path / "d")).count() == 4
    sinks.write_documents(docs, str(tmp_path / "d"), "a")
    assert spark.read.json(str(tmp_path / "d")).count() == 4
    with pytest.raises(ValueError):
        sinks.write_documents(docs, str(tmp_path / "d"), "a", layout="other")
    sinks.write_index(docs, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i" / "index")).count() == 3
    path = sinks.backup(docs, str(tmp_path), "a", "20250701")
    with pytest.raises(Exception, match="already exists"):
        sinks.backup(docs, str(tmp_path), "a", "20250701")
    assert spark.read.json(path).count() == 3
    docs.createOrReplaceTempView("upkeep_docs")
    assert sinks.missing_columns(spark, {"upkeep_docs": ["ID", "x"], "nowhere": ["a"]}) == {"upkeep_docs": ["x"], "nowhere": ["*"]}
    with pytest.raises(RuntimeError, match="nowhere lacks"):
        sinks.ensure_ready(spark, {"nowhere": ["a"]})
    paths = spark.createDataFrame([("a/b.c/d.HWP",), ("x",), ("a/.hidden",)], "p string")
    assert [r[0] for r in paths.select(sinks.output_path(F.col("p"))).collect()] == ["hwp/a/b.c/d.json", "unknown/x.json", "unknown/a/.hidden.json"]
    assert [r[0] for r in paths.limit(1).select(sinks.project_path(F.col("p"), "a/")).collect()] == ["b.c/d.HWP"]


def test_posts_that_go_and_come_back(spark):
    kind = "slug string, html string, status string, deleted_at timestamp"
    t = dt.datetime(2025, 1, 1)
    current = spark.createDataFrame([("a", "1", "active", None), ("b", "2", "active", None), ("c", None, "deleted", t), ("d", "4", "active", None)], kind)
    seen = spark.createDataFrame([("a", "9"), ("c", "8"), ("e", "7")], "slug string, html string")
    gone = spark.createDataFrame([("b",), ("c",), ("nope",)], "slug string")
    got = {r.slug: (r.html, r.status, r.deleted_at) for r in sinks.saved_posts(current, seen, gone, now=F.lit(t)).collect()}
    assert got == {"a": ("9", "active", None), "b": (None, "deleted", t), "c": ("8", "active", None), "d": ("4", "active", None), "e": ("7", "active", None)}


def test_tree_paths_deep_and_cyclic(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(300)] + [("x", "y"), ("y", "x"), ("z", "x"), ("o", "nowhere"), (None, "o")]
    got = {r.id: r for r in tree.tree_paths(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert len(got) == 301 and got["n299"].depth == 299 and got["n299"].path_ids == [f"n{k}" for k in range(300)] and got["o"].depth == 0
    assert tree.tree_paths(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_names_in_headers_and_folders(spark):
    assert web.disposition_name("attachment; filename=\"a; b.pdf\"; filename*=UTF-8''%EA%B0%80.pdf") == "가.pdf"
    assert web.disposition_name("inline; filename=\"a; b.pdf\"") == "a; b.pdf" and web.disposition_name("filename=plain.pdf") == "plain.pdf"
    files = spark.createDataFrame([(1, "d", "a.pdf"), (2, "d", "a-2.pdf"), (3, "d", "a.pdf"), (4, "d", "a.pdf"), (5, "e", "a.pdf"), (6, None, "a.pdf")], "o int, d string, n string")
    taken = spark.createDataFrame([("d", "a-3.pdf"), ("e", "a.pdf")], "d string, n string")
    got = {r.o: r.unique_name for r in web.unique_names(files, "d", "n", "o", taken).collect()}
    assert got == {1: "a.pdf", 2: "a-2.pdf", 3: "a-4.pdf", 4: "a-5.pdf", 5: "a-2.pdf", 6: "a.pdf"}


def test_pages(spark):
    html = "<div class=\"title\">T <b>x</b></div><span class=\"author\">A</span><div class=\"content\">one<br>two</div><a href=\"/f.pdf\">File</a><a href=\"/f.pdf\">File</a><a href=\"/page\">p</a>"
    pages = spark.createDataFrame([("http://h/a", html), ("http://h/b", None), (None, "<a href=")], "url string, html string")
    got = {r.url: r for r in web.post_details(pages).collect()}
    assert got["http://h/a"].title == "T x" and [tuple(a) for a in got["http://h/a"].attachments] == [("File", "http://h/f.pdf")] and got["http://h/b"].title is None

    def fetch(url):
        if url.endswith("b"):
            raise OSError("refused")
        return f"<p>{url}</p>"

    fetched = {r.url: (r.html, r.error) for r in web.fetched_pages(spark, pages, fetch, partitions=2).collect()}
    assert fetched == {"http://h/a": ("<p>http://h/a</p>", None), "http://h/b": (None, "OSError: refused")}
    links = spark.createDataFrame([("http://h/x.pdf", None), ("/down?x", ""), ("/a.html", "x.pdf"), (None, "y.HWP"), ("/a", "b")], "u string, n string")
    assert [r[0] for r in links.select(web.is_attachment(F.col("u"), F.col("n"))).collect()] == [True, True, False, True, False]


def test_bars_plans_and_sections(spark):
    df = spark.createDataFrame([("a", 2), ("b", 4)], "k string, n int")
    assert {r.k: r.share for r in browse.bars(df, "n").collect()} == {"a": 0.5, "b": 1.0} and browse.bars(df.limit(0), "n").count() == 0
    assert {r.share for r in browse.bars(df.withColumn("n", F.lit(0)), "n").collect()} == {0.0}
    assert df.select(browse.percent(F.lit(0.125))).first()[0] == "13%"
    assert store.longest_first(df.select(F.col("k").alias("id"), F.col("n").alias("n_chars")), 1).first().id == "b"
    rows = spark.createDataFrame([("k", 1, "x", {"m": "1"}), ("k", 1, "y", {"m": "2"})], "id string, at int, v string, m map<string,string>")
    assert store.upsert(rows.limit(0), rows, ["id"]).first().v == "y"
    docs = spark.createDataFrame([(1, [("one two three", "A"), ("four", None), (None, "B")]), (2, None)], "id int, blocks array<struct<text: string, section: string>>")
    got = {r.id: r.chunks for r in chunking.with_sectioned_chunks(docs, size=14, overlap=4).collect()}
    assert [(c.text, c.sections) for c in got[1]] == [("one two three", ["A"]), ("hree\nfour", ["overlap", "unknown"])] and got[2] == []
