"""State between runs over posts: change detection, high watermark, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.scoring import first_case


def change_kinds(stored: DataFrame, incoming: DataFrame, key: str, compared: list[str], sets: list[str] = ()) -> DataFrame:
    """``(key, kind)``: new, updated, skipped (equal) or missing.

    ``sets`` are array columns that are compared without regard to order and repetition.
    """
    digest = lambda df: df.select(F.col(key), F.struct(*[F.col(c) for c in compared], *[F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array()))).alias(c) for c in sets]).alias("state"), F.lit(True).alias("there"))
    both = digest(stored).alias("s").join(digest(incoming).alias("n"), F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    kind = first_case([(F.col("s.there").isNull(), "new"), (F.col("n.there").isNull(), "missing"), (F.to_json("s.state") == F.to_json("n.state"), "skipped")], "updated")
    return both.select(F.coalesce(f"s.{key}", f"n.{key}").alias(key), kind.alias("kind"))


def above_watermark(posts: DataFrame, state: DataFrame, board: str, number: str) -> DataFrame:
    """Posts above the last number of their board; posts without a number always pass."""
    marks = state.select(F.col(board).alias("_board"), F.col("last_no").alias("_last"))
    joined = posts.join(marks, F.col(board).eqNullSafe(F.col("_board")), "left")
    return joined.where(F.col(number).isNull() | F.col("_last").isNull() | (F.col(number) > F.col("_last"))).drop("_board", "_last")


def advanced(state: DataFrame, posts: DataFrame, board: str, number: str) -> DataFrame:
    """``(board, last_no)``, moved forward only."""
    seen = posts.groupBy(board).agg(F.max(number).alias("last_no"))
    return state.select(board, "last_no").unionByName(seen).groupBy(board).agg(F.max("last_no").alias("last_no"))


def misses(state: DataFrame, seen: DataFrame, key: str, most: int = 3, counting: bool = True) -> DataFrame:
    """``(key, miss_count, evicted)``: one more for every key that a run did not see, 0 for those it saw.

    Keys that reach ``most`` are evicted.  With ``counting`` off (a full resync) nothing is counted.
    """
    found = seen.select(key).distinct().withColumn("there", F.lit(True))
    joined = state.select(key, "miss_count").join(found, key, "full_outer")
    count = first_case([(F.col("there"), 0), (F.lit(not counting), F.coalesce("miss_count", F.lit(0)))], F.coalesce("miss_count", F.lit(0)) + 1)
    return joined.select(key, count.cast("int").alias("miss_count")).withColumn("evicted", F.lit(counting) & (F.col("miss_count") >= most))


def merged_sightings(rows: DataFrame, key: str, order: str, sets: list[str], flags: list[str], firsts: list[str]) -> DataFrame:
    """One row per key: union of array columns, any of flags, the first value that is not null by ``order``."""
    return rows.groupBy(key).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in sets],
        *[F.bool_or(c).alias(c) for c in flags],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts],
    )


def last_status(lines: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """``(key, status)`` by the last line of each key; combined before the shuffle."""
    return lines.groupBy(key).agg(F.max_by(status, order).alias(status))
