"""Lists that people look through: documents, feedback, chats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents_view(documents: DataFrame, categories: list[str] | None = None, title: str | None = None, since: dt.date | None = None, until: dt.date | None = None, with_attachments: bool | None = None, newest_first: bool = True) -> DataFrame:
    """Filtered and sorted documents (columns ``id, title, category, date, n_attachments``).

    The title filter ignores case and blanks; documents without a date pass the date filter and sort as ''.
    """
    out = documents
    if categories:
        out = out.where(F.col("category").isin(categories))
    if title and title.strip():
        squeezed = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")
        out = out.where(F.contains(squeezed(F.coalesce("title", F.lit(""))), squeezed(F.lit(title))))
    day = F.coalesce("date", F.lit(""))
    if since:
        out = out.where((day == "") | (day >= since.isoformat()))
    if until:
        out = out.where((day == "") | (day <= until.isoformat()))
    if with_attachments is not None:
        out = out.where((F.col("n_attachments") > 0) == with_attachments)
    return out.orderBy(day.desc() if newest_first else day.asc(), "id")


def page(rows: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of an ordered list, from 1."""
    return rows.offset(max(number - 1, 0) * size).limit(size)


def owned(chats: DataFrame, user: str) -> DataFrame:
    """A user's chats, the latest first."""
    return chats.where(F.col("user_id") == user).orderBy(F.col("updated_at").desc(), "id")


def owned_messages(messages: DataFrame, chats: DataFrame, user: str) -> DataFrame:
    """The messages of a user's chats (row-level ownership)."""
    return messages.join(chats.where(F.col("user_id") == user).select(F.col("id").alias("chat_id")).distinct(), "chat_id", "left_semi")


def touched(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with ``updated_at`` moved on to their newest message."""
    newest = messages.groupBy(F.col("chat_id").alias("id")).agg(F.max("created_at").alias("_newest"))
    return chats.join(newest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_newest")).drop("_newest")


def stored_sources(sources: Column) -> Column:
    """The JSON list of sources of a message as structs, numbered from 1, with defaults; empty for what cannot be read."""
    parsed = F.from_json(sources, "array<struct<id: int, title: string, category: string, url: string>>")
    some = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    made = F.transform(parsed, lambda s, i: F.struct((i + 1).alias("id"), some(s["title"], "제목 없음").alias("title"), some(s["category"], "").alias("category"), some(s["url"], "#").alias("url")))
    return F.coalesce(made, F.array().cast("array<struct<id: int, title: string, category: string, url: string>>"))


def visible(sources: DataFrame, selected: list[int]) -> DataFrame:
    """The selected sources; none when nothing is selected."""
    return sources.where(F.col("id").isin(selected)) if selected else sources.limit(0)


def in_order(column: Column, order: list[str], unknown: int = 999) -> Column:
    """The place of a value in a fixed order, unknown ones last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), column)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(unknown)


def bars(rows: DataFrame, count: str) -> DataFrame:
    """``rows`` with ``share``, their count as a part of the largest one, 0 where that is 0."""
    top = rows.agg(F.max(count).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn("share", F.when(F.col("_top") > 0, F.col(count) / F.col("_top")).otherwise(0.0)).drop("_top")


def percent(rate: Column) -> Column:
    """A rate as a whole percentage, halves up."""
    return F.concat(F.floor(rate * 100 + 0.5).cast("string"), F.lit("%"))
