"""Queries of the core problems (those that need no text model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.incremental import changed_records, commit_bounds, post_state
from corpusmill.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, post_no): the posts every successful run has to handle."""
    bounds = commit_bounds(table(spark, root, "crawl_runs"))
    changed = changed_records(table(spark, root, "notice_posts"), bounds, "post_no", post_state(), ["crawled_at", "capture_id"])
    return changed.select(F.col("commit_seq").cast("long").alias("run_id"), F.col("post_no").cast("long").alias("post_no"))


P1_SQL = r"""
WITH runs AS (SELECT DISTINCT run_id FROM crawl_runs WHERE status = 'success'),
pages AS (
  SELECT post_no, run_id, crawled_at, capture_id, title,
         try_strptime(
           CASE WHEN regexp_matches(d, '^[0-9]{8}$') THEN d
                WHEN regexp_matches(d, '^[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+[0-9]{1,2}')
                THEN regexp_extract(d, '^([0-9]{4})', 1)
                  || lpad(regexp_extract(d, '^[0-9]{4}[^0-9]+([0-9]{1,2})', 1), 2, '0')
                  || lpad(regexp_extract(d, '^[0-9]{4}[^0-9]+[0-9]{1,2}[^0-9]+([0-9]{1,2})', 1), 2, '0')
           END, '%Y%m%d')::date AS day,
         trim(regexp_replace(content, '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{0085}\x{1680}]+', ' ', 'g')) AS body,
         coalesce(list_transform(attachments, lambda a: a.name), []) AS names
  FROM (SELECT *, trim(replace(list_date, chr(160), ' ')) AS d FROM notice_posts WHERE post_no IS NOT NULL)
),
upto AS (
  SELECT r.run_id AS as_of, p.*,
         row_number() OVER (PARTITION BY r.run_id, p.post_no ORDER BY p.crawled_at DESC NULLS LAST, p.capture_id DESC) AS place
  FROM runs r JOIN pages p ON p.run_id <= r.run_id
),
states AS (SELECT * FROM upto WHERE place = 1),
ordered AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS previous FROM runs)
SELECT now.as_of AS run_id, now.post_no
FROM states now JOIN ordered o ON o.run_id = now.as_of
LEFT JOIN states before ON before.as_of = o.previous AND before.post_no = now.post_no
WHERE before.post_no IS NULL
   OR now.title IS DISTINCT FROM before.title OR now.day IS DISTINCT FROM before.day
   OR now.body IS DISTINCT FROM before.body OR now.names IS DISTINCT FROM before.names
"""

QUERIES = {"p1_found": p1_found}
ORACLES = {"p1_found": P1_SQL}
