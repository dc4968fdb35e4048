from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import extract, files


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return out.getvalue()


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


HTML = """<html><head><title>Page</title><script>var x = 1;</script></head><body><div id="gnb">menu</div><div class="content"><h2>Head</h2><p>First paragraph of the text that is long enough to count as content.
 And more of it.</p><ul><li>item one</li><li>item one</li></ul><table><tr><th>a</th><td>b</td></tr><tr><td></td></tr></table><p>목록</p><br><p>open <b>bold</p></div><footer>foot</footer></body></html>"""


def texts(blocks):
    return [b["text"] for b in blocks]


def test_html():
    assert texts(extract.html_blocks(HTML)) == ["Page", "Head", "First paragraph of the text that is long enough to count as content. And more of it.", "item one", "a | b", "open bold"]
    assert extract.html_blocks("") == [] and extract.html_blocks(None) == []
    assert texts(extract.html_blocks("just text\nin lines")) == ["just text", "in lines"]
    assert texts(extract.html_blocks("<div class=x>aa</div><div class=rule><p>bb cc</p></div>", (".rule", "#none"))) == ["bb cc"]
    assert extract.html_text("<p>a&amp;b</p> <i>c</i>") == "a&b c"


def test_plain_kinds():
    assert texts(extract.csv_blocks("a;b\n1; \n;;\n2;3\n")) == ["a | b", "1", "2 | 3"]
    assert texts(extract.text_blocks("one\n\n two  x\n")) == ["one", "two x"]
    post = {"title": "T", "date": "2025-01-01", "content": "", "body": "x\ny", "attachments": [{"name": "f.pdf"}, None, {"name": " "}]}
    assert texts(extract.post_blocks(post)) == ["T", "2025-01-01", "x", "y", "f.pdf"]


def test_pdf_lines():
    pages = [["Header", f"text of page {n} goes", "on and ends here.", "Footer", f"- {n} -"] for n in range(1, 4)]
    assert texts(extract.pdf_blocks(pages)) == [f"text of page {n} goes on and ends here." for n in range(1, 4)]
    assert [extract.pdf_route("x", m) for m in ("always", "auto", "never")] == ["ocr", "ocr", "text"]
    assert extract.pdf_route("x" * 100) == "text"
    with pytest.raises(ValueError):
        extract.pdf_route("x", "maybe")


def test_office_formats():
    w = 'xmlns:w="w"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert [(b["block_type"], b["text"]) for b in extract.docx_blocks(docx)] == [("heading", "Head"), ("paragraph", "Text"), ("table_row", "a | b")]
    xlsx = archive({
        "xl/sharedStrings.xml": '<sst xmlns="s"><si><t>shared</t></si></sst>', "xl/workbook.xml": '<workbook xmlns="s"><sheets><sheet name="First"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row r="2"><c t="s"><v>0</v></c><c t="inlineStr"><is><t>inline</t></is></c><c t="b"><v>1</v></c><c><v>3.5</v></c></row><row><c/></row></sheetData></worksheet>',
    })
    assert [(b["style"], b["row_no"], b["text"]) for b in extract.xlsx_blocks(xlsx)] == [("First", 2, "shared | inline | TRUE | 3.5")]
    pptx = archive({"ppt/slides/slide2.xml": '<s xmlns:a="a"><a:p><a:r><a:t>two</a:t></a:r></a:p></s>', "ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:r><a:t>one</a:t></a:r></a:p></s>', "ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>note</a:t></a:r></a:p></s>'})
    assert [(b["page_no"], b["text"]) for b in extract.pptx_blocks(pptx)] == [(1, "one"), (1, "note"), (2, "two")]
    hwpx = archive({"mimetype": "application/hwp+zip", "Contents/section0.xml": '<s xmlns:hp="h"><hp:p><hp:run><hp:t>문단</hp:t></hp:run></hp:p></s>'})
    assert texts(extract.hwpx_blocks(hwpx)) == ["문단"]
    hwpml = "<HWPML><BODY><P><TEXT><CHAR>가</CHAR><CHAR>나</CHAR></TEXT></P><P><CHAR>가나</CHAR></P></BODY></HWPML>".encode()
    assert texts(extract.hwpml_blocks(hwpml)) == ["가나"]


def test_every_reader_survives_rubbish():
    for ext in (".docx", ".xlsx", ".pptx", ".hwpx", ".xml", ".json", ".html", ".csv", ".txt", ".hwp", ""):
        blocks, _ = extract.extract(b"\x00\xff<<<", ext)
        assert isinstance(blocks, list)
    assert extract.extract(b"{}", ".hwp")[1] == "unsupported: .hwp"
    assert extract.extract(b"x", ".hwp", {".hwp": lambda d: [extract.block("paragraph", "x", "y")]})[0][0]["text"] == "y"


def test_small_helpers():
    assert files.parse_extensions(["pdf,hwp", ".TXT", "pdf", " "]) == [".pdf", ".hwp", ".txt"]
    assert [files.safe_member(n) for n in ("a/b.txt", "/a", "../a", "a/../b", "__MACOSX/a", "d/", "C:/x", "")] == [True, False, False, False, False, False, False, False]
    assert files.safe_identifier("public.rag_chunks") == "public.rag_chunks"
    for bad in ("x; drop table y", "", "1a"):
        with pytest.raises(ValueError):
            files.safe_identifier(bad)
    assert files.jdbc_options("jdbc:postgresql://h/db", "t")["url"].endswith("?connectTimeout=10")


def test_listing_archives_and_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.html").write_text(HTML)
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "z.zip").write_bytes(archive({"in/x.txt": "inside", "../evil.txt": "no", "skip.exe": "no"}))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04broken")
    listed = files.list_files(spark, f"file://{tmp_path}", ["txt,html"])
    found = {r.path.rsplit("/", 1)[1]: r for r in extract.extract_files(listed).collect()}
    assert set(found) == {"a.txt", "b.html"} and found["a.txt"].blocks[0].text == "hello" and found["b.html"].error is None
    members = files.archive_members(files.list_files(spark, f"file://{tmp_path}", ["zip"]), ["txt"]).collect()
    assert {(m.member, bytes(m.content) if m.content else None) for m in members} == {("in/x.txt", b"inside"), (None, None)}
    kinds = files.list_files(spark, f"file://{tmp_path}", ["zip", "bin"]).select(files.sniffed_kind(F.col("content")).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["", "", ".zip"]


def test_json_scans(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"title": "x", "n": 1}, indent=1))
    (tmp_path / "bad.json").write_text("{broken")
    rows = files.json_objects(spark, f"file://{tmp_path}", "title string, n int").collect()
    assert sorted((r.title, r._corrupt_record is not None) for r in rows if r.title) == [("x", False)] and len(rows) == 2
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, f"file://{lines}", "a int").collect()) == [1, 2]
    lines.write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        files.json_lines(spark, f"file://{lines}", "a int").collect()
    assert files.json_lines(spark, f"file://{lines}", "a int", strict=False).count() == 2


def test_failed_paths(spark):
    log = ["[OK] a.pdf", "[FAIL] b.pdf: broken", "[FAIL] a.pdf: x", "[OK] b.pdf", "noise", "[FAIL] c d.pdf: y"]
    df = spark.createDataFrame(list(enumerate(log)), "line_no int, value string")
    assert sorted(r.path for r in files.failed_paths(df).collect()) == ["a.pdf", "c d.pdf"]
