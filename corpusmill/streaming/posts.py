"""The incremental operators over streams of posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.store import KeyedTable, last_wins


def upsert_stream(stream: DataFrame, table: KeyedTable, order: list[str], checkpoint: str, available_now: bool = True):
    """Write a stream into a keyed table, the last row of a key winning.

    A batch that is replayed after a failure upserts the same rows again and changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(last_wins(batch, table.keys, order), order)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def miss_counts(stream: DataFrame, key: str, run: str, most: int = 3) -> DataFrame:
    """``(key, run, miss_count, evicted)`` as a stream of states: how many runs have gone by without a key.

    ``stream`` has one row per key and run, seen or not (``seen`` boolean), runs in order.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        # A key has at most one row for each run.
        rows = pd.concat(list(batches)).sort_values(run)
        place = np.arange(1, len(rows) + 1)
        last_seen = np.maximum.accumulate(np.where(rows["seen"].to_numpy(bool), place, 0))
        count = np.where(last_seen > 0, place - last_seen, place + before)
        state.update((int(count[-1]),))
        yield pd.DataFrame({key: keys[0], run: rows[run].to_numpy(), "miss_count": count.astype(np.int32), "evicted": count >= most})

    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {run} long, miss_count int, evicted boolean"
    return stream.groupBy(key).applyInPandasWithState(update, out, "n int", "append", "NoTimeout")


def changed_stream(stream: DataFrame, key: str, digest: str, version: str) -> DataFrame:
    """``(key, version, digest, kind)``: every row whose digest differs from that of the version before it.

    ``version`` (a number that grows) orders the rows of a key, in whatever order a batch holds them.  A row that
    comes when a later version was handled already is left out, and so are a version's repetitions.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, upto = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values([version, digest]).drop_duplicates(version, keep="last")
        if upto is not None:
            rows = rows[rows[version] > upto]
        if len(rows):
            values = rows[digest].to_numpy(object)
            before = np.concatenate([[last], values[:-1]])
            changed = values != before
            state.update((values[-1], int(rows[version].iloc[-1])))
            kinds = np.where([b is None for b in before], "new", "updated")
            yield pd.DataFrame({key: keys[0], version: rows[version].to_numpy()[changed], digest: values[changed], "kind": kinds[changed]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.where(F.col(digest).isNotNull() & F.col(version).isNotNull()).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, {version} long, {digest} string, kind string", "digest string, version long", "append", "NoTimeout"
    )


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``(start, key, n)`` by event time, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now and stop: the form in which a scheduler runs a stream once a day.

    A run that begins while another one of the same checkpoint is going does nothing but raise an error.
    """
    with alone(stream.sparkSession, f"{checkpoint.rstrip('/')}.lock"):
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def alone(spark: SparkSession, lock: str) -> Iterator[None]:
    """Holds a lock file in a folder that all runs share; one that is held raises an error.

    A run that was killed leaves its file, which is to be removed by hand: no run can tell a dead one from a slow one.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lock)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        made = system.createNewFile(path)
    except Exception as error:
        raise RuntimeError(f"cannot make {lock}") from error
    if not made:
        raise RuntimeError(f"another run holds {lock}")
    try:
        yield
    finally:
        system.delete(path, False)
