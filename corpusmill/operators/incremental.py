"""Processing only what is new or changed since the last successful run.

Two layers share one rule:

* :func:`changed_records` is the rule itself as one plan.  A run owns a commit sequence
  number; the bounds ``(low, high]`` of each successful run are fixed before any row is
  read, and the states of a key at ``low`` and at ``high`` are compared.  Rows of runs
  that failed in between lie inside the bounds of the next successful run, so nothing is
  skipped and nothing is repeated.
* :class:`IncrementalJob` applies the rule run after run.  It writes a run's output into
  a directory of its own and then publishes output and watermark with one atomic rename
  of one commit file, so that a run which dies anywhere leaves no trace that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions.dates import calendar_day
from corpusmill.functions.text import one_blank


def post_state(title: str = "title", list_date: str = "list_date", content: str = "content", attachments: str = "attachments") -> Column:
    """A digest of what makes two sightings of a post the same.

    Title as stored, calendar day of the list date however it is spelt, content with every
    run of white space as one blank, and the ordered attachment names.  Null parts differ
    from empty ones; a date that cannot be read counts as none.
    """
    names = F.transform(F.col(attachments), lambda a: F.coalesce(a["name"], F.lit("\u0001")))
    parts = F.to_json(
        F.struct(
            F.col(title).alias("t"),
            calendar_day(F.col(list_date)).alias("d"),
            one_blank(F.col(content)).alias("c"),
            F.coalesce(names, F.array().cast("array<string>")).alias("a"),
        )
    )
    return F.sha2(parts, 256)


def commit_bounds(runs: DataFrame, seq: str = "run_id", status: str = "status", success: str = "success") -> DataFrame:
    """``(seq, commit_seq)``: for each run the first successful run that is not before it.

    One row per run of the run log, so the ordered window without a key sees the log alone,
    never the data.  Runs after the last successful one have a null ``commit_seq``.
    """
    log = runs.where(F.col(seq).isNotNull()).groupBy(seq).agg(F.max(F.when(F.col(status) == success, F.col(seq))).alias("_own"))
    later = Window.orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(seq, F.min("_own").over(later).alias("commit_seq"))


def changed_records(
    sightings: DataFrame,
    bounds: DataFrame,
    key: str,
    state: Column,
    version: list[str],
    seq: str = "run_id",
) -> DataFrame:
    """``(commit_seq, key)``: the keys each successful run has to handle.

    ``sightings`` has one row per sighting of ``key`` by run ``seq``; the state at a run is
    that of the latest sighting (by ``version``, in order) in that run or any earlier one.
    A key comes out for a run when its state differs from the one at the previous
    successful run, or when it had none.  ``bounds`` comes from :func:`commit_bounds`.

    Rows without key or run are no sightings.  Null versions count as the oldest; fully equal
    versions are settled by the larger digest, so repeated rows change nothing.  Empty input
    gives an empty result.

    Only keys, versions and digests are shuffled.  The first aggregation combines before the
    shuffle, so a key that holds a third of all rows arrives as one row per map task and
    run; what the window sees of a key is bounded by the number of successful runs.
    """
    slim = sightings.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(
        F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(version)], state.alias("state")).alias("_latest")
    )
    by_run = slim.groupBy("_key", "_seq").agg(F.max("_latest").alias("_latest"))
    mapped = by_run.join(bounds.where(F.col("commit_seq").isNotNull()).select(F.col(seq).alias("_seq"), "commit_seq"), "_seq")
    by_commit = mapped.groupBy("_key", "commit_seq").agg(F.max("_latest").alias("_latest"))
    order = Window.partitionBy("_key").orderBy("commit_seq")
    upto = by_commit.select("_key", "commit_seq", F.max("_latest").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_now"))
    before = upto.withColumn("_before", F.lag("_now").over(order))
    # A sighting older than what is known already leaves the running maximum, and so the state, as it was.
    differs = F.col("_before").isNull() | (F.col("_before.state") != F.col("_now.state"))
    return before.where(differs).select("commit_seq", F.col("_key").alias(key))


class IncrementalJob:
    """Run-after-run processing with output and watermark committed together.

    ``root`` holds ``batches/<id>`` (outputs, written by Spark) and ``commits/<n>`` (one file
    each, written under another name and renamed).  The watermark is that of the newest
    commit; a reader sees exactly the batches that commits name.  Two writers that race for
    the same commit number cannot both win, since the rename does not overwrite.
    """

    def __init__(self, spark: SparkSession, root: str, seq: str) -> None:
        self.spark, self.root, self.seq = spark, root.rstrip("/"), seq
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """All commits in order; files a dead writer left under another name are not among them."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit():
                stream = self._fs.open(status.getPath())
                try:
                    raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found.append(json.loads(raw))
        return sorted(found, key=lambda c: c["number"])

    def watermark(self) -> int | None:
        done = self.commits()
        return done[-1]["high"] if done else None

    def run(self, source: DataFrame, process: Callable[[DataFrame, int | None, int], DataFrame], high: int | None = None) -> dict | None:
        """Process the rows with ``low < seq <= high`` and commit; None when there are none.

        ``high`` is fixed before the work starts (by default the largest sequence number there
        is), so rows that arrive meanwhile wait for the next run.  ``process`` gets the rows,
        ``low`` and ``high``.
        """
        done = self.commits()
        low = done[-1]["high"] if done else None
        if high is None:
            high = source.agg(F.max(self.seq)).first()[0]
        if high is None or (low is not None and high <= low):
            return None
        fresh = source.where(F.col(self.seq) <= high)
        if low is not None:
            fresh = fresh.where(F.col(self.seq) > low)
        batch = f"batches/{uuid.uuid4().hex}"
        process(fresh, low, high).write.parquet(f"{self.root}/{batch}")
        commit = {"number": len(done), "low": low, "high": high, "batch": batch}
        self._publish(commit)
        return commit

    def _publish(self, commit: dict) -> None:
        staged = self._path(f"{self.root}/staged/{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/commits/{commit['number']:010d}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"commit {commit['number']} was taken by another writer")

    def output(self, schema: T.StructType) -> DataFrame:
        """All committed output."""
        paths = [f"{self.root}/{c['batch']}" for c in self.commits()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
