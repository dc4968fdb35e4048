"""What pages and addresses of boards say: lists, page numbers, names of files, years, settings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from email.message import Message
from email.utils import collapse_rfc2231_value
from pathlib import PurePosixPath
from urllib.parse import parse_qs, parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import contains_any, one_blank, safe_filename
from corpusmill.sources.extract import Node, parsed, tidy

# Parameters that carry the name of a file, and names that say nothing.
NAME_PARAMETERS = ("filename", "fileName", "fileNm", "flNm", "orgFileNm", "downFileName")
GENERIC_NAMES = ("attachment", "download", "file", "첨부파일", "다운로드")
ROW = "post_no string, notice_no int, is_notice boolean, title string, list_date string, href string, has_file boolean"


def board_rows(html: str | None) -> list[dict]:
    """The posts on a list page: every table row with a link that has a ``no`` parameter.

    The number cell says NOTICE (or is marked so) for pinned posts, which have no number.
    """
    rows = []
    for tr in (n for n in parsed(html or "").below() if n.name == "tr"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.name == "td"]
        link = next((a for a in _named(tr, "a") if "no=" in a.href), None)
        number = re.search(r"[?&]no=(\d+)", link.href) if link else None
        if not number:
            continue
        first = next((c for c in cells if "num" in c.names), cells[0] if cells else None)
        said = first.text() if first else ""
        pinned = said.upper() == "NOTICE" or bool(first and "noti" in first.names.split())
        date = next((c.text() for c in cells if "date" in c.names), "")
        rows.append(
            {
                "post_no": number[1], "notice_no": int(said) if said.isdigit() and not pinned else None, "is_notice": pinned, "title": link.text(), "list_date": date, "href": link.href,
                "has_file": any("file" in c.names and any(True for _ in _named(c, "img")) for c in cells),
            }
        )
    return rows


def _named(node: Node, name: str) -> Iterator[Node]:
    return (n for n in node.below() if n.name == name)


def list_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with one row per post on each list page."""
    keep = [c for c in pages.columns if c != html]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [board_rows(h) for h in batch[html]]
            out = batch[keep].loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
            rows = pd.DataFrame([r for f in found for r in f], columns=[p.split()[0] for p in ROW.split(", ")])
            rows["notice_no"] = rows["notice_no"].astype("Int32")
            yield pd.concat([out, rows], axis=1)

    return pages.mapInPandas(run, f"{kinds}, {ROW}" if kinds else ROW)


def page_of(html: Column) -> Column:
    """(page, last) of an indicator such as ``<span>2</span> / 7``; (1, 1) without one."""
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(html, r"<span>(\d+)</span>\s*/\s*(\d+)", i), F.lit("")).cast("int"), F.lit(1))
    return F.struct(number(1).alias("page"), number(2).alias("last"))


def with_parameter(url: str, key: str, value: str) -> str:
    """The address with one query parameter set."""
    parts = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k != key]
    return urlunsplit(parts._replace(query=urlencode([*query, (key, value)])))


def absolute(base: Column, href: Column) -> Column:
    """A link made absolute; null for null."""

    @F.pandas_udf("string")
    def join(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, hrefs in batches:
            yield pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(bases, hrefs, strict=True)])

    return join(base, href)


def kept_name(name: str) -> str:
    """A name without the characters that file systems refuse."""
    return "".join("_" if c in '\\/:*?"<>|' else c for c in tidy(name))


def _header_parameters(header: str) -> Message:
    """A header read by the grammar of MIME parameters, which knows quoting and the encoded form of values."""
    message = Message()
    message["content-disposition"] = header if header.split(";")[0].strip().isalpha() else f"attachment; {header}"
    return message


def disposition_name(header: str | None) -> str:
    """The file name that a Content-Disposition header gives, '' for none.  An encoded value wins over a plain one."""
    if not header:
        return ""
    values = [v for k, v in _header_parameters(header).get_params([], "content-disposition") if k == "filename"]
    encoded = [v for v in values if isinstance(v, tuple)]
    value = collapse_rfc2231_value((encoded or values or [""])[0])
    return kept_name(unquote(value))


def filename_of(url: str, fallback: str = "attachment") -> str:
    """The name of a file by its address: a parameter that names it, else the end of the path."""
    parts = urlsplit(url)
    query = parse_qs(parts.query)
    candidates = [query[k][0] for k in NAME_PARAMETERS if k in query] + [unquote(PurePosixPath(parts.path).name), fallback]
    return kept_name(next(c for c in candidates if c))


def name_rank(name: str) -> int:
    """How little a name says: 0 for a good one, then garbled, generic, and empty ones."""
    if not name:
        return 3
    if PurePosixPath(name).stem.lower() in GENERIC_NAMES:
        return 2
    return int(any(c == "\ufffd" or "\x80" <= c <= "\xff" for c in name))


def download_name(header: str | None, url: str, fallback: str = "attachment") -> str:
    """The name that says most of those of the header and of the address, the header's among equals.

    A garbled name of the header gives way only to a good one of the address.
    """
    return min((disposition_name(header), filename_of(url, fallback)), key=name_rank)


def unique_names(files: DataFrame, folder: str, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``files`` with ``unique_name``: the second of a name in a folder is ``stem-2.ext``, and so on.

    No number is given that would make the name of another file, of those at hand or of ``taken``
    (folder and name of files that are there already, which keep their names).
    """
    clean = safe_filename(F.col(name))
    stem, ext = F.regexp_replace(clean, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(clean, r"(?<=.)(\.[^.]*)$", 1)
    named = files.withColumn("_clean", clean).withColumn("_stem", stem).withColumn("_ext", ext)
    there = named.select(F.col(folder).alias("_folder"), "_clean").distinct().withColumn("_old", F.lit(0))
    if taken is not None:
        there = there.unionByName(taken.select(F.col(folder).alias("_folder"), safe_filename(F.col(name)).alias("_clean")).distinct().withColumn("_old", F.lit(1)))
    # Names of the form stem-n.ext that stand in the folder under their stem: these numbers are taken.
    number = F.regexp_extract("_clean", r"^.+-(\d{1,9})(?:\.[^.]*)?$", 1)
    base = F.concat(F.regexp_extract("_clean", r"^(.+)-\d{1,9}(?:\.[^.]*)?$", 1), F.regexp_extract("_clean", r"(?<=.)(\.[^.]*)$", 1))
    used = there.where(number != "").select("_folder", base.alias("_clean"), number.cast("long").alias("_n")).groupBy("_folder", "_clean").agg(F.array_sort(F.collect_set("_n")).alias("_used"))
    first = there.groupBy("_folder", "_clean").agg(F.max("_old").alias("_old"))
    same = lambda right: (F.col(f"f.{folder}").eqNullSafe(F.col(f"{right}._folder"))) & (F.col("f._clean") == F.col(f"{right}._clean"))
    joined = named.alias("f").join(used.alias("u"), same("u"), "left").join(first.alias("o"), same("o"), "left").select("f.*", "u._used", F.coalesce("o._old", F.lit(0)).alias("_old"))
    place = F.row_number().over(Window.partitionBy(folder, "_clean").orderBy(order)) + F.col("_old")
    # The place-th number that is not taken: every taken number up to it moves it on by one.
    free = F.aggregate(F.filter(F.coalesce("_used", F.array().cast("array<bigint>")), lambda n: n >= 2), F.col("_place").cast("long"), lambda at, n: F.when(n <= at, at + 1).otherwise(at))
    done = joined.withColumn("_place", place).withColumn("unique_name", F.when(F.col("_place") == 1, F.col("_clean")).otherwise(F.concat("_stem", F.lit("-"), free.cast("string"), "_ext")))
    return done.drop("_clean", "_stem", "_ext", "_used", "_old", "_place")


# What is no attachment, what is one by its ending, and what hints at one in an address.
PAGE_ENDINGS = ("html", "htm", "shtml", "php", "asp", "aspx", "jsp")
FILE_ENDINGS = ("pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "txt", "csv", "png", "jpg", "jpeg", "gif")
FILE_HINTS = ("download", "down", "attach", "file", "atchfile")


def is_attachment(href: Column, name: Column) -> Column:
    """Whether a link leads to a file: by the ending of its address or name, else by a hint in the address; pages never."""
    address, label = F.lower(F.coalesce(href, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    ends = lambda endings: F.greatest(*[c.rlike(rf"\.(?:{'|'.join(endings)})$") for c in (address, label)])
    return ~ends(PAGE_ENDINGS) & (ends(FILE_ENDINGS) | address.rlike("|".join(FILE_HINTS)))


def without_words(rows: DataFrame, title: str, words: list[str]) -> DataFrame:
    """``rows`` whose title has none of the words; rows without a title stay."""
    return rows.where(~contains_any(F.col(title), words))


def category_folder(label: Column) -> Column:
    """A category as the name of a folder."""
    return F.translate(label, "\u00b7 ", "__")


DETAIL = "title string, author string, posted string, content string, attachments array<struct<name: string, url: string>>"


def post_details(pages: DataFrame, html: str = "html", url: str = "url", title_class: str = "title", author_class: str = "author", date_class: str = "date", content_class: str = "content") -> DataFrame:
    """The columns of ``pages`` but its HTML, with title, author, date text, text and attachments of the post on each page.

    Elements are found by class; attachments are the links with the ending of a file, with absolute
    addresses, each once.  Null and broken pages give nulls and no attachments.
    """
    keep = [c for c in pages.columns if c != html]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    classes = {title_class: "title", author_class: "author", date_class: "posted", content_class: "content"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [_detail(h, u, classes) for h, u in zip(batch[html], batch[url], strict=True)]
            out = batch[keep].copy()
            for field in ("title", "author", "posted", "content", "attachments"):
                out[field] = [p[field] for p in parsed]
            yield out

    return pages.mapInPandas(run, f"{kinds}, {DETAIL}" if kinds else DETAIL)


def _detail(html: str | None, url: str | None, classes: dict[str, str]) -> dict:
    root = parsed(html or "")
    found: dict[str, str | None] = {}
    for node in root.below():
        for field in {classes[c] for c in node.names.split() if c in classes}:
            found.setdefault(field, node.text() or None)
    links = {urljoin(url or "", a.href): a.text() for a in _named(root, "a") if a.href}
    files = [{"name": label or filename_of(link), "url": link} for link, label in links.items() if PurePosixPath(urlsplit(link).path).suffix.lower().lstrip(".") in FILE_ENDINGS]
    return {field: found.get(field) for field in ("title", "author", "posted", "content")} | {"attachments": files}


def fetched_pages(spark: SparkSession, urls: DataFrame, fetch: Callable[[str], str | None], url: str = "url", partitions: int = 8, tries: int = 3) -> DataFrame:
    """``(url, html, error)`` of every address, by a function that fetches one; the engine itself opens no connection.

    ``partitions`` bounds how many are fetched at a time.  An address that fails ``tries`` times has
    null HTML and its last error; null addresses and repeated ones are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for address in batch["url"]:
                html, error = None, None
                for _ in range(tries):
                    try:
                        html, error = fetch(address), None
                        break
                    except Exception as fault:  # noqa: BLE001 - whatever the given function raises
                        error = f"{type(fault).__name__}: {fault}"[:300]
                rows.append((address, html, error))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    asked = urls.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().repartition(partitions)
    return asked.mapInPandas(run, "url string, html string, error string")


def guide_title(title: Column) -> Column:
    """A title without the words of its buttons."""
    return F.trim(F.regexp_replace(F.regexp_replace(one_blank(title), r"\s*보기\s*$", ""), r"(?i)\(PDF\)\s*$", ""))


def inferred_year(section: Column, title: Column, download: Column, url: Column) -> Column:
    """The year of a guide: that of its section, else in its title, its file's name, or its address."""
    year = lambda c, p=r"(20\d{2})": F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).cast("int")
    return F.coalesce(section, year(title), year(download), year(url, r"/media/(20\d{2})/"))


def longest_titles(items: DataFrame, url: str, title: str, order: str) -> DataFrame:
    """One item per address, the one with the longest title, of equal ones the first; items without address are left out."""
    best = Window.partitionBy(url).orderBy(F.length(title).desc_nulls_last(), order)
    return items.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def list_setting(value: str | list[str]) -> list[str]:
    """A setting given as a list, as JSON or with commas."""
    if isinstance(value, list):
        return value
    text = value.strip()
    if text.startswith("["):
        found = json.loads(text)
        if not isinstance(found, list):
            raise ValueError("the setting must be an array")
        return [s for x in found if (s := str(x).strip())]
    return [s for x in text.split(",") if (s := x.strip())]
