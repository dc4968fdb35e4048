from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.dates import calendar_day
from corpusmill.operators.incremental import IncrementalJob, changed_records, commit_bounds, post_state

ATTACHMENT = "array<struct<name: string>>"
SIGHTING = f"capture_id long, run_id long, post_no long, title string, list_date string, content string, attachments {ATTACHMENT}, crawled_at timestamp, commit_seq string, _key string"


def at(second: int) -> dt.datetime:
    return dt.datetime(2025, 3, 1, 0, 0, 0) + dt.timedelta(seconds=second)


def found(spark, runs, rows):
    bounds = commit_bounds(spark.createDataFrame(runs, "run_id long, status string"))
    # Extra columns with clashing names must not matter.
    sightings = spark.createDataFrame([(*r, "x", "y") for r in rows], SIGHTING)
    out = changed_records(sightings, bounds, "post_no", post_state(), ["crawled_at", "capture_id"])
    return sorted((r[0], r[1]) for r in out.collect())


def row(capture, run, post, title="t", date="2025-01-02", content="c", names=(), second=None):
    return (capture, run, post, title, date, content, [(n,) for n in names], at(capture if second is None else second))


RUNS = [(1, "success"), (2, "failed"), (3, "success"), (4, "success"), (5, "running")]


def test_failed_runs_are_made_up_for_and_nothing_repeats(spark):
    rows = [row(1, 1, 10), row(2, 2, 11), row(3, 3, 10), row(4, 3, 12), row(5, 4, 12), row(6, 5, 13)]
    assert found(spark, RUNS, rows) == [(1, 10), (3, 11), (3, 12)]


def test_states_that_are_set_back_between_runs_are_no_change(spark):
    rows = [row(1, 1, 10, content="a"), row(2, 2, 10, content="b"), row(3, 3, 10, content="a")]
    assert found(spark, RUNS, rows) == [(1, 10)]


@pytest.mark.parametrize(
    ("change", "differs"),
    [
        ({"title": "u"}, True), ({"date": "2025.1.2."}, False), ({"date": " 20250102 "}, False), ({"date": "2025년 1월 3일"}, True), ({"date": None}, True),
        ({"content": "  c\n"}, False), ({"content": "c d"}, True), ({"content": None}, True), ({"names": ["f"]}, True),
    ],
)
def test_what_counts_as_different(spark, change, differs):
    assert ((3, 10) in found(spark, RUNS, [row(1, 1, 10), row(2, 3, 10, **change)])) is differs


def test_white_space_inside_counts_as_one_blank(spark):
    assert found(spark, RUNS, [row(1, 1, 10, content="a b"), row(2, 3, 10, content=" a  \r\n b ")]) == [(1, 10)]


def test_latest_sighting_wins_even_when_stored_late(spark):
    rows = [row(1, 1, 10, content="new", second=50), row(2, 3, 10, content="old", second=20), row(3, 4, 10, content="newer", second=50)]
    assert found(spark, RUNS, rows) == [(1, 10), (4, 10)]


def test_nulls_and_repeated_rows_and_empty_tables(spark):
    rows = [row(1, 1, None), row(2, None, 10), row(3, 1, 10), row(3, 1, 10)]
    assert found(spark, RUNS, rows) == [(1, 10)]
    assert found(spark, RUNS, []) == []
    assert found(spark, [], [row(1, 1, 10)]) == []


def test_calendar_day(spark):
    texts = ["2025-01-02", "2025/01/02 10:11", "2025.1.2.", "20250102", "2025년 1월 2일", " 2025-01-02 ", "2025-02-30", "soon", "", None]
    days = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(calendar_day(F.col("t"))).collect()]
    assert days == [dt.date(2025, 1, 2)] * 6 + [None] * 4


def test_job_commits_output_and_watermark_together(spark, tmp_path):
    root = f"file://{tmp_path}/job"
    schema = "seq long, v string"
    first = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    more = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], schema)
    keep = lambda rows, low, high: rows

    def fails(rows, low, high):
        raise RuntimeError("lost")

    job = IncrementalJob(spark, root, "seq")
    assert job.run(spark.createDataFrame([], schema), keep) is None
    assert job.run(first, keep)["high"] == 2
    assert job.run(first, keep) is None
    with pytest.raises(RuntimeError):
        IncrementalJob(spark, root, "seq").run(more, fails)
    assert job.watermark() == 2
    # The bound fixed at the start leaves later rows for the next run.
    assert IncrementalJob(spark, root, "seq").run(more, keep, high=3)["low"] == 2
    assert IncrementalJob(spark, root, "seq").run(more, keep)["high"] == 4
    assert sorted(r[0] for r in job.output(more.schema).collect()) == [1, 2, 3, 4]


def test_job_output_of_a_writer_that_died_before_its_commit_is_not_read(spark, tmp_path, monkeypatch):
    job = IncrementalJob(spark, f"file://{tmp_path}/job", "seq")
    rows = spark.createDataFrame([(1, "a")], "seq long, v string")
    monkeypatch.setattr(job, "_publish", lambda commit: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        job.run(rows, lambda r, low, high: r)
    again = IncrementalJob(spark, f"file://{tmp_path}/job", "seq")
    assert again.output(rows.schema).count() == 0
    again.run(rows, lambda r, low, high: r)
    assert again.output(rows.schema).count() == 1
