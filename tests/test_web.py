from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import web

LIST = """<table class="brdList"><tbody>
<tr><td class="bdlNum noti">NOTICE</td><td><a href="?action=view&no=11">Pinned</a></td><td class="bdlDate">2025.01.02</td><td class="bdlFile"><img src=x></td></tr>
<tr><td class="bdlNum">7</td><td><a href="?action=view&amp;no=12"> A <b>post</b></a></td><td class="bdlDate">2025.01.01</td><td class="bdlFile"></td></tr>
<tr><td>no link</td></tr></tbody></table><span>2</span> / 7"""


def test_board_rows():
    rows = web.board_rows(LIST)
    assert [(r["post_no"], r["notice_no"], r["is_notice"], r["title"], r["list_date"], r["has_file"]) for r in rows] == [("11", None, True, "Pinned", "2025.01.02", True), ("12", 7, False, "A post", "2025.01.01", False)]
    assert web.board_rows(None) == [] and web.board_rows("<p>") == []


def test_list_posts(spark):
    pages = spark.createDataFrame([(1, LIST), (2, None), (3, "")], "page_id int, html string")
    assert sorted((r.page_id, r.post_no, r.notice_no) for r in web.list_posts(pages).collect()) == [(1, "11", None), (1, "12", 7)]
    assert sorted(tuple(r[0]) for r in pages.where("html is not null").select(web.page_of(F.col("html"))).collect()) == [(1, 1), (2, 7)]


def test_addresses(spark):
    assert web.with_parameter("http://h/a?x=1&page=2#f", "page", "3") == "http://h/a?x=1&page=3#f"
    assert web.filename_of("http://h/d?fileNm=%EA%B0%80.pdf") == "가.pdf" and web.filename_of("http://h/a/b.hwp?x=1") == "b.hwp" and web.filename_of("http://h/") == "attachment"
    assert web.disposition_name("attachment; filename*=UTF-8''%EA%B0%80.pdf") == "가.pdf" and web.disposition_name('x; filename="a/b.pdf"') == "a_b.pdf" and web.disposition_name(None) == ""
    assert web.download_name("filename=download", "http://h/x.pdf") == "x.pdf" and web.download_name("filename=good.pdf", "http://h/x.pdf") == "good.pdf" and web.download_name(None, "http://h/x.pdf") == "x.pdf"
    df = spark.createDataFrame([("http://h/a/b", "../c"), ("http://h/", None)], "b string, h string")
    assert [r[0] for r in df.select(web.absolute(F.col("b"), F.col("h"))).collect()] == ["http://h/c", None]


def test_names_years_and_titles(spark):
    files = spark.createDataFrame([(1, "a.pdf", 1), (1, "a.pdf", 2), (1, "a", 3), (2, "a.pdf", 4), (1, "a", 5)], "d int, n string, o int")
    assert [r.unique_name for r in web.unique_names(files, "d", "n", "o").orderBy("o").collect()] == ["a.pdf", "a-2.pdf", "a", "a.pdf", "a-2"]
    df = spark.createDataFrame([(None, "guide 2023", "x2022", ""), (2021, "2023", "", ""), (None, "x", "", "/media/2020/a"), (None, None, None, None)], "s int, t string, d string, u string")
    assert [r[0] for r in df.select(web.inferred_year(F.col("s"), F.col("t"), F.col("d"), F.col("u"))).collect()] == [2023, 2021, 2020, None]
    assert spark.range(1).select(web.guide_title(F.lit(" A  guide (PDF) 보기 "))).first()[0] == "A guide"
    items = spark.createDataFrame([("u", "ab", 1), ("u", "abc", 2), ("u", "xyz", 3), ("", "q", 4), (None, "q", 5)], "u string, t string, o int")
    assert [tuple(r) for r in web.longest_titles(items, "u", "t", "o").collect()] == [("u", "abc", 2)]


def test_list_setting():
    assert web.list_setting(" a, ,b") == ["a", "b"] and web.list_setting('["a", " "]') == ["a"] and web.list_setting("") == [] and web.list_setting(["x"]) == ["x"]
    with pytest.raises(ValueError):
        web.list_setting("[broken")
