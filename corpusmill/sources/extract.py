"""Documents to typed blocks: HTML, office formats, plain text, decoded PDF lines.

A block is (block_type, style, text, page_no, row_no, line_no).  Formats that need a tool that is
not here (binary word processor files, rendering and recognition of pages) take a function.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.files import table_rows

BLOCKS = "array<struct<block_type: string, style: string, text: string, page_no: int, row_no: int, line_no: int>>"
# What is left out of a page, and what tells a page's content from its frame.
DROPPED = ("script", "style", "noscript", "svg", "canvas", "iframe", "form")
FRAME_TAGS = ("nav", "header", "footer", "aside")
FRAME_NAMES = ("nav", "gnb", "lnb", "snb", "menu", "header", "footer", "breadcrumb", "quick", "search", "banner", "popup", "comment", "reply", "pagination", "print", "share", "zoom", "btn", "button")
GOOD_NAMES = ("content", "cont", "board", "view", "article", "body", "main", "read", "detail")
BAD_NAMES = ("nav", "menu", "header", "footer", "banner", "search", "quick")
IGNORED = ("확대", "축소", "프린트", "인쇄", "공유", "목록", "다음글", "이전글")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def tidy(text: str) -> str:
    return " ".join(text.replace(" ", " ").split())


def block(kind: str, style: str, text: str, page: int | None = None, row: int | None = None, line: int | None = None) -> dict:
    return {"block_type": kind, "style": style, "text": text, "page_no": page, "row_no": row, "line_no": line}


class Node:
    """An element; children are nodes and strings."""

    def __init__(self, name: str, attrs: dict[str, str | None]) -> None:
        self.name, self.names = name, f"{attrs.get('id') or ''} {attrs.get('class') or ''}".lower().strip()
        self.href = attrs.get("href") or ""
        self.children: list[Node | str] = []

    def below(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: str | None = None) -> str:
        parts: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                parts.append(top)
            elif top.name != without:
                stack += reversed(top.children)
        return tidy(" ".join(parts))

    def is_frame(self) -> bool:
        return self.name in FRAME_TAGS or any(w in self.names for w in FRAME_NAMES)

    def worth(self) -> int:
        """Length of the text, more or less by what the element is called; -1 for short ones."""
        size = len(self.text())
        if size < 80:
            return -1
        return size + 400 * any(w in self.names for w in GOOD_NAMES) - 300 * any(w in self.names for w in BAD_NAMES)


class _Tree(HTMLParser):
    """A tolerant tree: unknown ends are skipped, open elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.path = [self.root]
        self.dropping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropping or tag in DROPPED:
            if tag not in VOID:
                self.dropping.append(tag)
            return
        node = Node(tag, dict(attrs))
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.dropping and tag not in DROPPED:
            self.path[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag in self.dropping:
                del self.dropping[len(self.dropping) - 1 - self.dropping[::-1].index(tag) :]
            return
        names = [n.name for n in self.path]
        if tag in names[1:]:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.path[-1].children.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def html_blocks(html: str | None, selectors: tuple[str, ...] = ()) -> list[dict]:
    """Blocks of the main content of a page.

    The content is the element with the most text among the body and its sections, by
    :meth:`Node.worth`, the first of equals.  With ``selectors`` (element names, ``#id`` or
    ``.class``) it is the longest element that one of them picks, if any.  Texts come once.
    """
    root = parsed(html or "")
    everything = list(root.below())
    body = next((n for n in everything if n.name == "body"), root)
    picked = [n for n in everything if any(n.name == s or s[:1] in "#." and s[1:].lower() in n.names.split() for s in selectors)]
    main = max(picked, key=lambda n: len(n.text())) if picked else max([body, *(n for n in body.below() if n.name in ("main", "article", "section", "div", "td") and not n.is_frame())], key=Node.worth)
    blocks: list[dict] = []
    seen: set[str] = set()

    def add(kind: str, style: str, text: str) -> None:
        if text and text not in seen and text not in IGNORED:
            seen.add(text)
            blocks.append(block(kind, style, text))

    title = next((n for n in everything if n.name == "title"), None)
    if title:
        add("heading", "HTMLTitle", title.text())
    emitted = len(blocks)
    stack = [main]
    while stack:
        node = stack.pop()
        if node.is_frame():
            continue
        if node.name == "table":
            rows = (" | ".join(t for c in tr.children if isinstance(c, Node) and c.name in ("th", "td") and (t := c.text("table"))) for tr in node.below() if tr.name == "tr")
            add("table", "HTMLTable", tidy(" ".join(r for r in rows if r)))
            continue
        if re.fullmatch("h[1-6]", node.name):
            add("heading", node.name.upper(), node.text("table"))
        elif node.name == "li":
            add("list_item", "HTMLListItem", node.text("table"))
        elif node.name == "p":
            add("paragraph", "HTMLParagraph", node.text("table"))
        elif node.name in ("blockquote", "pre"):
            add("paragraph", node.name.upper(), node.text("table"))
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    if len(blocks) == emitted and not blocks:
        for piece in _strings(main):
            add("paragraph", "HTMLText", tidy(piece))
    return blocks


def _strings(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield from child.splitlines()
        else:
            yield from _strings(child)


def html_text(html: str | None) -> str:
    return parsed(html or "").text()


def post_blocks(post: dict) -> list[dict]:
    """Blocks of a crawled post: title, date, category, subcategory, body, names of attachments."""
    out = [block("heading" if k == "title" else "metadata", f"JSON{k.title()}", v) for k in ("title", "date", "category", "subcategory") if (v := tidy(str(post.get(k) or "")))]
    out += [block("paragraph", "JSONBody", t, line=i) for i, line in enumerate(str(post.get("content") or post.get("body") or "").splitlines(), 1) if (t := tidy(line))]
    names = ", ".join(n for a in post.get("attachments") or [] if (n := tidy(str((a or {}).get("name") or ""))))
    return [*out, block("attachments", "JSONAttachments", names)] if names else out


def text_blocks(text: str) -> list[dict]:
    return [block("paragraph", "Text", t, line=i) for i, line in enumerate(text.splitlines(), 1) if (t := tidy(line))]


def csv_blocks(text: str) -> list[dict]:
    return [block("table_row", "CSV", row, row=i) for i, row in enumerate(table_rows(text), 1)]


def pdf_blocks(pages: list[list[str]], least: int = 3) -> list[dict]:
    """Blocks of the text lines of PDF pages: lines that stand at the edge of ``least`` pages or more and
    page numbers are left out, lines up to the end of a sentence are joined, repetitions dropped."""
    edges = Counter(line for lines in pages for line in [*lines[:2], *lines[-2:]])
    out: list[dict] = []
    for number, lines in enumerate(pages, 1):
        current = ""
        for line in [*(t for x in lines if (t := tidy(x)) and edges[x] < least and not re.fullmatch(r"[-–\s]*\d+(?:\s*/\s*\d+)?[-–\s]*", t)), ""]:
            current = f"{current} {line}".strip()
            if current and (not line or re.search(r"[.!?。]$", current)):
                if not out or out[-1]["text"] != current:
                    out.append(block("paragraph", "PDFText", current, page=number))
                current = ""
    return out


def pdf_route(text: str, mode: str = "auto", broken: Callable[[str], bool] = lambda t: False) -> str:
    """``text`` or ``ocr``: whether the text of a PDF is to be used or its pages are to be recognised."""
    if mode not in ("always", "auto", "never"):
        raise ValueError(mode)
    return "ocr" if mode == "always" or mode == "auto" and (len(text) < 80 or broken(text)) else "text"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(element: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in element.iter() if _local(e) == name)


def _said(element: ElementTree.Element, name: str = "t") -> str:
    return tidy("".join(e.text or "" for e in _all(element, name)))


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs, headings by style, then the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _xml(archive, "word/document.xml")
        if root is None:
            return []
        inside = {id(p) for t in _all(root, "tbl") for p in _all(t, "p")}
        out = []
        for p in _all(root, "p"):
            style = next((v for s in _all(p, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            if id(p) not in inside and (text := _said(p)):
                out.append(block("heading" if style.lower().startswith(("heading", "title")) else "paragraph", style or "Normal", text))
        for table in _all(root, "tbl"):
            for i, tr in enumerate(_all(table, "tr"), 1):
                if row := " | ".join(t for tc in _all(tr, "tc") if (t := _said(tc))):
                    out.append(block("table_row", "DOCXTable", row, row=i))
        return out


def xlsx_blocks(data: bytes) -> list[dict]:
    """The rows of all sheets: shared and inline strings, numbers as written, booleans as TRUE and FALSE."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared_root = _xml(archive, "xl/sharedStrings.xml")
        shared = [_said(si) for si in shared_root if _local(si) == "si"] if shared_root is not None else []
        book = _xml(archive, "xl/workbook.xml")
        titles = [s.attrib.get("name", "") for s in _all(book, "sheet")] if book is not None else []

        def value(c: ElementTree.Element) -> str:
            kind, raw = c.attrib.get("t"), next((v.text or "" for v in _all(c, "v")), "")
            if kind == "s":
                return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
            if kind == "inlineStr":
                return _said(c)
            return {"0": "FALSE", "1": "TRUE"}.get(raw, raw) if kind == "b" else tidy(raw)

        out = []
        for place, name in enumerate(_numbered(archive.namelist(), r"xl/worksheets/sheet(\d+)\.xml")):
            sheet = _xml(archive, name)
            for i, r in enumerate(_all(sheet, "row") if sheet is not None else (), 1):
                if row := " | ".join(t for c in _all(r, "c") if (t := value(c))):
                    out.append(block("table_row", titles[place] if place < len(titles) else f"Sheet{place + 1}", row, row=int(r.attrib.get("r", i))))
        return out


def pptx_blocks(data: bytes) -> list[dict]:
    """Paragraphs, table rows and notes of every slide, each text once a slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        out, seen = [], set()
        for number, name in enumerate(_numbered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
            slide, notes = _xml(archive, name), _xml(archive, name.replace("slides/slide", "notesSlides/notesSlide"))
            found = []
            if slide is not None:
                inside = {id(p) for t in _all(slide, "tbl") for p in _all(t, "p")}
                found += [("paragraph", "PPTXText", _said(p)) for p in _all(slide, "p") if id(p) not in inside]
                found += [("table_row", "PPTXTable", " | ".join(t for tc in _all(tr, "tc") if (t := _said(tc)))) for tr in _all(slide, "tr")]
            if notes is not None:
                found += [("note", "PPTXNotes", _said(p)) for p in _all(notes, "p")]
            for kind, style, text in found:
                if text and (number, kind, text) not in seen:
                    seen.add((number, kind, text))
                    out.append(block(kind, style, text, page=number))
        return out


def hwpx_blocks(data: bytes) -> list[dict]:
    """Paragraphs of every section."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        out = []
        for number, name in enumerate(_numbered(archive.namelist(), r"Contents/section(\d+)\.xml"), 1):
            section = _xml(archive, name)
            for p in _all(section, "p") if section is not None else ():
                own = tidy("".join(t.text or "" for run in p if _local(run) == "run" for t in run if _local(t) == "t"))
                if own:
                    out.append(block("paragraph", "HWPX", own, page=number))
        return out


def hwpml_blocks(data: bytes, most_noise: int = 4000) -> list[dict]:
    """Paragraphs of a word processor document in one XML file, each once, encoded binary data left out."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return []
    out, seen = [], set()
    for p in (e for e in root.iter() if _local(e).upper() == "P"):
        text = tidy("".join(c.text or "" for c in p.iter() if _local(c).upper() == "CHAR"))
        encoded = len(text) > most_noise and sum(c.isascii() and (c.isalnum() or c in "+/=") for c in text) > 0.9 * len(text)
        if text and text not in seen and not encoded:
            seen.add(text)
            out.append(block("paragraph", "HWPML", text))
    return out


_DECODED = {".html": html_blocks, ".htm": html_blocks, ".txt": text_blocks, ".csv": csv_blocks}
_BINARY = {".docx": docx_blocks, ".xlsx": xlsx_blocks, ".pptx": pptx_blocks, ".hwpx": hwpx_blocks, ".xml": hwpml_blocks}


def extract(data: bytes, ext: str, adapters: dict[str, Callable[[bytes], list[dict]]] | None = None) -> tuple[list[dict], str | None]:
    """(blocks, error) of a file by its extension; adapters stand for formats that need outside tools."""
    try:
        if adapters and ext in adapters:
            return adapters[ext](data), None
        if ext in _DECODED:
            return _DECODED[ext](data.decode("utf-8-sig", "ignore")), None
        if ext == ".json":
            import json

            post = json.loads(data.decode("utf-8-sig"))
            return (post_blocks(post), None) if isinstance(post, dict) else ([], "not an object")
        if ext in _BINARY:
            return _BINARY[ext](data), None
        return [], f"unsupported: {ext or 'no extension'}"
    except Exception as e:  # a file that cannot be read must not end the run
        return [], f"{type(e).__name__}: {e}"


def extract_files(files: DataFrame, adapters: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """``(path, ext, blocks, error)`` of every file, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [extract(bytes(c or b""), e, adapters) for c, e in zip(batch["content"], batch["ext"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "ext": batch["ext"], "blocks": [d[0] for d in done], "error": [d[1] for d in done]})

    from corpusmill.sources.files import extension

    return files.select("path", extension(F.col("path")).alias("ext"), "content").mapInPandas(run, f"path string, ext string, blocks {BLOCKS}, error string")
