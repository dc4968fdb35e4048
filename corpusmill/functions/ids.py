"""Keys and hashes that must be the same for every writer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(*parts: Column) -> Column:
    """The first 12 hex digits of the md5 of the parts joined by ``|``; null parts count as ''."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.md5(joined), 1, 12)


def chunk_key(source_slug: Column, chunk_index: Column) -> Column:
    """The first 16 hex digits of the sha256 of ``slug::index``."""
    return F.substring(F.sha2(F.concat(source_slug, F.lit("::"), chunk_index.cast("string")), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_uuid(text: Column) -> Column:
    return F.lower(text).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
