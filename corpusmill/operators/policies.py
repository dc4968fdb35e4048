"""Chats and their owners: what a user may see, add, change and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.store import cascade_delete, upsert


def _own(chats: DataFrame, user: str) -> DataFrame:
    return chats.where(F.col("user_id") == user).select("id").distinct()


def refused(rows: DataFrame, chats: DataFrame, user: str, of: str = "message") -> DataFrame:
    """The rows a user may not write: chats of others or of nobody, messages of chats that are not the user's."""
    if of == "chat":
        return rows.where(~F.coalesce(F.col("user_id") == user, F.lit(False)))
    return rows.join(_own(chats, user).withColumnRenamed("id", "chat_id"), "chat_id", "left_anti")


def _checked(bad: DataFrame) -> None:
    if bad.limit(1).count():
        raise PermissionError("some rows belong to another user")


def written_chats(chats: DataFrame, incoming: DataFrame, user: str, order: list[str]) -> DataFrame:
    """``chats`` after a user inserted or updated ``incoming``: all rows must be the user's, and so must those they replace."""
    _checked(refused(incoming, chats, user, "chat"))
    _checked(refused(chats.join(incoming.select("id").distinct(), "id", "left_semi"), chats, user, "chat"))
    return upsert(chats, incoming, ["id"], order)


def written_messages(messages: DataFrame, chats: DataFrame, incoming: DataFrame, user: str, order: list[str]) -> DataFrame:
    """``messages`` after a user inserted or updated ``incoming``: old and new rows must be of the user's chats."""
    _checked(refused(incoming, chats, user))
    _checked(refused(messages.join(incoming.select("id").distinct(), "id", "left_semi"), chats, user))
    return upsert(messages, incoming, ["id"], order)


def deleted_chats(chats: DataFrame, messages: DataFrame, ids: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without those of the chats ``ids`` that are the user's; the others stay as they are."""
    return cascade_delete(chats, messages, ids.select("id").join(_own(chats, user), "id", "left_semi"), "id", "chat_id")
