"""Scans of files: listing, kinds, archives, JSON, lines, logs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections import Counter
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The limits within which an archive is unpacked.
MOST_MEMBERS, MOST_MEMBER_BYTES, MOST_ARCHIVE_BYTES = 300, 100 * 2**20, 500 * 2**20


def parse_extensions(values: list[str]) -> list[str]:
    """``["pdf,hwp", ".TXT"]`` as ``[".pdf", ".hwp", ".txt"]``: dotted, lower case, each once, in order."""
    found = [f".{part.strip().lower().lstrip('.')}" for value in values for part in value.split(",") if part.strip().strip(".")]
    return list(dict.fromkeys(found))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def list_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """``(path, content, length, modificationTime)`` of the files below ``root``; the bytes are read only where used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(extension(F.col("path")).isin(parse_extensions(extensions)))


def json_objects(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One JSON object per file; unreadable files are in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(paths, multiLine=True, mode="PERMISSIVE", encoding="UTF-8")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line, blank lines skipped; a malformed line fails the scan, or is kept apart."""
    if strict:
        return spark.read.schema(schema).json(paths, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _corrupt_record string").json(paths, mode="PERMISSIVE")


def sniffed_kind(content: Column) -> Column:
    """The kind of a download by its first bytes; zip files by their members."""
    head = F.hex(F.substring(content, 1, 8))

    @F.pandas_udf("string")
    def zip_kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_zip_kind)

    return F.when(head.startswith("D0CF11E0A1B11AE1"), ".hwp").when(head.startswith("25504446"), ".pdf").when(head.startswith("504B0304"), zip_kind(content)).otherwise("")


def _zip_kind(data: bytes | None) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
            names = archive.namelist()
            if "mimetype" in names and b"hwp" in archive.read("mimetype")[:64].lower() or any(n.startswith("Contents/section") for n in names):
                return ".hwpx"
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return ""
    for folder, ext in (("word/", ".docx"), ("xl/", ".xlsx"), ("ppt/", ".pptx")):
        if any(n.startswith(folder) for n in names):
            return ext
    return ".zip"


def safe_member(name: str) -> bool:
    """Whether a member of an archive may be unpacked: no absolute path, no way up, no system folder."""
    path = PurePosixPath(name.replace("\\", "/"))
    return bool(name) and not name.endswith("/") and not path.is_absolute() and ":" not in path.parts[0] and ".." not in path.parts and "__MACOSX" not in path.parts


def archive_members(files: DataFrame, extensions: list[str]) -> DataFrame:
    """``(path, member, content, error)`` of the members of zip files, within the limits.

    Members over a limit, and archives that cannot be read, come out with an error and no content.
    """
    wanted = set(parse_extensions(extensions))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_members(path, content, wanted), columns=["path", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, content binary, error string")


def _members(path: str, content: bytes, wanted: set[str]) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            rows, total = [], 0
            infos = [i for i in archive.infolist() if safe_member(i.filename) and PurePosixPath(i.filename).suffix.lower() in wanted]
            for place, info in enumerate(infos):
                total += info.file_size
                error = "too many members" if place >= MOST_MEMBERS else "member too large" if info.file_size > MOST_MEMBER_BYTES else "archive too large" if total > MOST_ARCHIVE_BYTES else None
                rows.append((path, info.filename, None if error else archive.read(info), error))
            return rows
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
        return [(path, None, None, f"unreadable archive: {e}")]


def table_rows(text: str, sniff_chars: int = 4096) -> list[str]:
    """The rows of delimited text as ``a | b | c`` without empty cells; the delimiter is the one that makes the beginning most regular."""
    sample = text[:sniff_chars]

    def regular(delimiter: str) -> tuple[int, int]:
        """How many rows of the sample have the commonest number of cells above one, and that number."""
        widths = Counter(len(row) for row in csv.reader(io.StringIO(sample), delimiter=delimiter) if len(row) > 1)
        return max(((n, w) for w, n in widths.items()), default=(0, 0))

    delimiter = max(",;\t|", key=regular)
    rows = (" | ".join(c for cell in row if (c := " ".join(cell.split()))) for row in csv.reader(io.StringIO(text), delimiter=delimiter))
    return [r for r in rows if r]


def failed_paths(lines: DataFrame) -> DataFrame:
    """``(path)`` of those whose last line in the log says FAIL.

    ``lines`` has (line_no, value) with values such as ``[OK] path`` or ``FAIL path: reason``.
    """
    status = F.regexp_extract("value", r"\b(OK|SKIP|FAIL)\b", 1)
    path = F.trim(F.regexp_extract("value", r"\b(?:OK|SKIP|FAIL)\b\]?:?\s+(.+?)(?::\s.*)?$", 1))
    parsed = lines.select("line_no", status.alias("status"), path.alias("path")).where((F.col("status") != "") & (F.col("path") != ""))
    return parsed.groupBy("path").agg(F.max_by("status", "line_no").alias("status")).where("status = 'FAIL'").select("path")


def jdbc_options(url: str, table: str, connect_timeout: int = 10, **more: str) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")`` with a connect timeout in the address."""
    if "connectTimeout=" not in url:
        url = f"{url}{'&' if '?' in url else '?'}connectTimeout={connect_timeout}"
    return {"url": url, "dbtable": table, **more}


def safe_identifier(name: str) -> str:
    """A table or function name that may be put into a statement."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}(\.[A-Za-z_][A-Za-z0-9_]{0,62})?", name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name
