"""Keyed tables: upserts, deletes and rewrites without MERGE.

A table is a folder of versions and a pointer file; a write makes a new version from the old
one and flips the pointer by a rename, so that readers see the old or the new state and a
writer that dies leaves none that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first); rows with a null key are kept apart by it."""
    picked = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_place", F.row_number().over(picked)).where("_place = 1").drop("_place")


def distinct_on(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: DISTINCT ON with a defined choice."""
    picked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(picked)).where("_place = 1").drop("_place")


def _same(a: str, b: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return condition


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with the same key.  Repeating it changes nothing.

    Of several incoming rows of a key the last by ``order`` counts; without an order, which of them counts is
    settled by all their columns, so that running it again gives the same.
    """
    fresh = last_wins(incoming, keys, order or [c for c, kind in incoming.dtypes if c not in keys and not kind.startswith(("map", "variant"))])
    kept = current.alias("c").join(fresh.select(*keys).alias("n"), _same("c", "n", keys), "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.alias("c").join(gone.select(*keys).distinct().alias("g"), _same("c", "g", keys), "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in ``gone`` and without their children."""
    return delete(parents, gone, [key]), delete(children, gone.select(F.col(key).alias(foreign)), [foreign])


def written_back(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with the given columns from ``updates`` where these have a value."""
    fresh = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns]).dropDuplicates(["_key"])
    joined = current.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def split_flat(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A flat table of chunks with their source's columns as a table of sources and one of chunks.

    A source takes its values from its first chunk (by ``chunk_index`` and ``id``), and its times
    from all of them.
    """
    of = Window.partitionBy("source_slug")
    timed = flat.withColumn("first_created", F.min("created_at").over(of)).withColumn("last_updated", F.max("updated_at").over(of))
    sources = distinct_on(timed, ["source_slug"], ["chunk_index", "id"]).select(F.col("source_slug").alias("id"), "source_slug", "metadata", F.col("first_created").alias("created_at"), F.col("last_updated").alias("updated_at"))
    chunks = flat.select("id", F.col("source_slug").alias("source_id"), "chunk_index", "content", "created_at", "updated_at")
    return sources, chunks


def oversized_plan(chunks: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """The chunks of active sources over the limit, with the next free index of their source; in no order, see :func:`longest_first`."""
    active = sources.where(F.col("status") == "active").select(F.col("id").alias("source_id"))
    top = chunks.groupBy("source_id").agg(F.max("chunk_index").alias("max_index"))
    large = chunks.where(F.length("content") > limit).join(active, "source_id").join(top, "source_id")
    return large.select("id", "source_id", "chunk_index", F.length("content").alias("n_chars"), (F.col("max_index") + 1).alias("next_index"))


def longest_first(plan: DataFrame, most: int | None = None) -> DataFrame:
    """A plan in the order in which it is read: the longest chunks first, then by id."""
    ordered = plan.orderBy(F.col("n_chars").desc(), "id")
    return ordered if most is None else ordered.limit(max(most, 0))


def change_totals(plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(sources, deleted, inserted)``: how many sources a rechunking touches, and how many chunks go and come."""
    made = pieces.join(plan.select("id"), "id", "left_semi").agg(F.count("*").alias("inserted"))
    return plan.agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("deleted")).join(F.broadcast(made))


def rechunked(chunks: DataFrame, plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """``chunks`` without those of the plan and with ``pieces`` (parent id, piece_no, content) appended.

    A source's new chunks are numbered on from its last index, by the parent's index and the
    place in the parent.  Old and new come out of one plan, so one write makes both or none.
    """
    order = Window.partitionBy("source_id").orderBy("chunk_index", "id", "piece_no")
    numbered = pieces.join(plan, "id").select("source_id", "content", (F.col("next_index") - 1 + F.row_number().over(order)).alias("chunk_index"))
    made = numbered.select(F.substring(F.sha2(F.concat_ws("::", "source_id", F.col("chunk_index").cast("string")), 256), 1, 16).alias("id"), "source_id", "chunk_index", "content")
    return delete(chunks.select("id", "source_id", "chunk_index", "content"), plan, ["id"]).unionByName(made)


def quarantine(rows: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every test, the others with the names of the tests they fail); a null outcome fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("failed_tests", failed)
    return marked.where(F.size("failed_tests") == 0).drop("failed_tests"), marked.where(F.size("failed_tests") > 0)


class KeyedTable:
    """A versioned Parquet table with a unique key.

    Rows are kept in ``buckets`` by the hash of their key.  A commit names the folder of every bucket, so
    an upsert or delete reads and writes the buckets it has keys of, and takes over the others as they are.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType, buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n[:10].isdigit())

    def versions(self) -> list[str]:
        return [n.split("-", 1)[1] for n in self._commits()]

    def exists(self) -> bool:
        return bool(self.versions())

    def folders(self) -> dict[int, str]:
        """The folder of every bucket that has rows, as of the last commit."""
        found = self._commits()
        if not found:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/commits/{found[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): f for b, f in json.loads(text).items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(sorted(self.folders().values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _commit(self, number: int, kept: dict[int, str], rows: DataFrame) -> None:
        """Write ``rows``, bucket by bucket, and make them the table together with the buckets kept."""
        name = uuid.uuid4().hex
        # One file for each bucket and no more, however many tasks there are.
        placed = rows.select(*self.schema.fieldNames(), self._bucket().alias("_bucket")).repartition("_bucket")
        placed.write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data/{name}"))]
        folders = kept | {int(n.split("=")[1]): f"{name}/{n}" for n in made if n.startswith("_bucket=")}
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        staged = self._path(f"{self.root}/staged-{name}")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        taken = any(n.startswith(f"{number:010d}-") for n in self._commits())
        if taken or not self._fs.rename(staged, self._path(f"{self.root}/commits/{number:010d}-{name}")):
            raise RuntimeError("another writer has committed")

    def write(self, rows: DataFrame) -> None:
        """Make ``rows`` the table.  Fails if another writer has committed since."""
        self._commit(len(self.versions()), {}, rows)

    def _rewrite(self, touching: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        number, folders = len(self.versions()), self.folders()
        # At most as many numbers as there are buckets.
        touched = {r[0] for r in touching.select(self._bucket()).distinct().collect()}
        old = self._read(sorted(f for b, f in folders.items() if b in touched))
        self._commit(number, {b: f for b, f in folders.items() if b not in touched}, change(old))

    def upsert(self, incoming: DataFrame, order: list[str] | None = None) -> None:
        self._rewrite(incoming, lambda old: upsert(old, incoming, self.keys, order))

    def delete(self, gone: DataFrame) -> None:
        self._rewrite(gone, lambda old: delete(old, gone, self.keys))
