"""Forests with parent pointers, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import checkpointed


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``(id, root_id, depth, path_ids)`` of every node, root first.

    Nodes without a parent, or whose parent is not there, are roots of depth 0; of repeated ids the
    smallest parent counts.  Nodes on a cycle, and those that hang on nothing but one, have no path.

    Every round puts the path of the topmost known ancestor before each path, so a forest of depth d
    takes log d joins, whatever its number of nodes.  A node with an open path in a round that closed
    none is on a cycle: depths have no gaps.
    """
    known = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    there = known.select(F.col("id").alias("_parent"))
    state = known.join(there, F.col("parent_id") == F.col("_parent"), "left").select("id", F.col("_parent").alias("top"), F.array("id").alias("path_ids"))
    unfinished = None
    while True:
        state = checkpointed(state)
        still = state.where("top IS NOT NULL").count()
        if still in (0, unfinished):
            break
        unfinished = still
        above = state.select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("path_ids").alias("_above"))
        state = state.join(above, F.col("top") == F.col("_id"), "left").select("id", F.col("_top").alias("top"), F.when(F.col("_above").isNull(), F.col("path_ids")).otherwise(F.concat("_above", "path_ids")).alias("path_ids"))
    return state.where("top IS NULL").select("id", F.get("path_ids", F.lit(0)).alias("root_id"), (F.size("path_ids") - 1).alias("depth"), "path_ids")


def prioritized_lookup(rows: DataFrame, key: str, candidates: list[str], table: DataFrame, table_key: str, value: str) -> DataFrame:
    """``(key, value)``: what the first of the candidate columns finds in ``table``, null when none does.

    One join for all candidates: they are unpivoted with their rank and the best match is kept.
    """
    ranked = rows.select(F.col(key), F.posexplode(F.array(*[F.col(c).cast("string") for c in candidates])).alias("rank", "_candidate")).where(F.col("_candidate").isNotNull())
    found = ranked.join(table.select(F.col(table_key).cast("string").alias("_candidate"), F.col(value).alias("_value")).dropDuplicates(["_candidate"]), "_candidate")
    best = found.groupBy(key).agg(F.min_by("_value", "rank").alias(value))
    return rows.select(key).distinct().join(best, key, "left")
