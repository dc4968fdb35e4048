"""Queries over the language-model operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import abuse, boilerplate, conversations, encoding, leakage, neighbours, packing, scans, splitting
from corpusmill.sources.tables import table


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, block_no, block_type, text), one row per block that is there."""
    placed = table(spark, root, "preprocessed").select("prep_id", F.posexplode("blocks").alias("place", "block"))
    return placed.select("prep_id", (F.col("place") + 1).cast("long").alias("block_no"), "block.block_type", "block.text")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, block_no, line_no, kind): faulty lines of scanned pages."""
    faults = scans.repair_pages(table(spark, root, "preprocessed")).select("prep_id", "block_no", F.explode("faults").alias("fault"))
    return faults.select("prep_id", F.col("block_no").cast("long").alias("block_no"), F.col("fault.line_no").cast("long").alias("line_no"), "fault.kind")


def p2_pages(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, block_no, text): every scanned page as clean paragraphs."""
    return scans.repair_pages(table(spark, root, "preprocessed")).select("prep_id", "block_no", "text")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, block_no): blocks with text that was decoded wrongly."""
    return encoding.restore_encoding(_blocks(spark, root), "text", ["prep_id", "block_no"]).select("prep_id", "block_no").distinct()


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, block_no, restored, spans): those blocks with their original wording."""
    return encoding.restore_encoding(_blocks(spark, root), "text", ["prep_id", "block_no"])


def _pages(spark: SparkSession, root: str) -> DataFrame:
    posts = table(spark, root, "notice_posts")
    # Board comments aside, documents are texts without pages around them.
    clean = table(spark, root, "documents").where("doc_kind is null or doc_kind != 'comment'")
    return boilerplate.line_labels(posts, ["capture_id"], "content", boilerplate.learn(posts, clean=clean))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(capture_id, line_no): lines of pages that are not the post's own text."""
    return _pages(spark, root).select("capture_id", F.explode("around").alias("line_no"))


def p4_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(capture_id, body): the post itself."""
    return _pages(spark, root).select("capture_id", "body")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(chat_id): chats to drop."""
    return conversations.dropped_chats(table(spark, root, "chats"), table(spark, root, "chat_messages"))


def p5_dialogues(spark: SparkSession, root: str) -> DataFrame:
    """The chats that stay, turn by turn."""
    return conversations.dialogues(table(spark, root, "chats"), table(spark, root, "chat_messages"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """(prep_id, item_kind, item_no): items over 900 characters, each of which is cut."""
    pieces = splitting.split_items(splitting.oversized_items(table(spark, root, "preprocessed")), ["prep_id", "item_kind", "item_no"])
    return pieces.where(F.col("piece_no") > 1).select("prep_id", "item_kind", "item_no").distinct()


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of those items."""
    return splitting.split_items(splitting.oversized_items(table(spark, root, "preprocessed")), ["prep_id", "item_kind", "item_no"])


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """(item_kind, items, chars, faults): what the pieces put together again are, and in how many something is wrong with a piece."""
    keys = ["prep_id", "item_kind", "item_no"]
    pieces = p6_pieces(spark, root).withColumn("size", F.length("piece"))
    wrong = (F.col("size") > splitting.MAX_CHARS) | (F.col("size") <= F.when(F.col("piece_no") > 1, splitting.OVERLAP).otherwise(0))
    # All pieces but the first begin 120 characters before the end of the one before.
    ends = pieces.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("start") + F.col("size")).alias("whole"), F.sum("size").alias("sum"), F.bool_or(wrong).alias("wrong"))
    faulty = F.col("wrong") | (F.col("sum") - splitting.OVERLAP * (F.col("n") - 1) != F.col("whole"))
    return ends.groupBy("item_kind").agg(F.count("*").alias("items"), F.sum("whole").alias("chars"), F.count(F.when(faulty, 1)).alias("faults"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_a, chunk_b): pairs of which either is among the 5 most similar of the other."""
    return neighbours.neighbour_pairs(table(spark, root, "rag_chunks"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id): documents that are divided."""
    return packing.pack(table(spark, root, "documents")).where(F.col("piece_no") > 1).select("doc_id").distinct()


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document, or piece of one, with its container."""
    return packing.pack(table(spark, root, "documents"))


def p8_checked(spark: SparkSession, root: str) -> DataFrame:
    """(documents, tokens, overfull): what was packed, and how many containers hold more than they may."""
    packed = packing.pack(table(spark, root, "documents"))
    loads = packed.groupBy("container").agg(F.sum("tokens").alias("load"), F.count(F.when(F.col("piece_no") == 1, 1)).alias("begun"))
    return loads.agg(F.sum("begun").alias("documents"), F.sum("load").alias("tokens"), F.count(F.when(F.col("load") > packing.CAPACITY, 1)).alias("overfull"))


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents"), leakage.held_out(table(spark, root, "eval_items")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, item_id): documents with the evaluation items they give away."""
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, root: str) -> DataFrame:
    """The same with the coverage and the spans to remove."""
    return _leaks(spark, root)


def _scored(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    return abuse.score_documents(documents, abuse.train(abuse.labelled_texts(documents, table(spark, root, "review_labels")), abuse.sentence_frequencies(documents)))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id): abusive, hateful or sexually explicit documents."""
    return _scored(spark, root).where("abusive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """A score for every document."""
    return _scored(spark, root)


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """The rate of such documents by source."""
    return abuse.source_rates(table(spark, root, "documents"), _scored(spark, root))


P5_SQL = r"""
WITH m AS (
  SELECT chat_id, id, content, created_at, lower(regexp_replace(role, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')) AS role
  FROM chat_messages
  WHERE chat_id IS NOT NULL AND content IS NOT NULL AND NOT regexp_full_match(content, '[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]*')
),
bad AS (SELECT DISTINCT chat_id FROM m WHERE created_at IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')),
t AS (
  SELECT *, lag(created_at) OVER (PARTITION BY chat_id, role, content ORDER BY created_at, id) AS before
  FROM m WHERE created_at IS NOT NULL AND role IN ('user', 'assistant')
),
u AS (SELECT * FROM t WHERE before IS NULL OR created_at - before > INTERVAL 10 SECOND),
s AS (
  SELECT chat_id, role, lead(role) OVER w AS following, row_number() OVER w AS place
  FROM u WINDOW w AS (PARTITION BY chat_id ORDER BY created_at, role DESC, id)
)
SELECT DISTINCT chat_id FROM chat_messages WHERE chat_id IS NOT NULL AND chat_id NOT IN (SELECT id FROM chats WHERE id IS NOT NULL)
UNION SELECT id FROM chats WHERE id IS NOT NULL AND id NOT IN (SELECT chat_id FROM m)
UNION SELECT chat_id FROM bad
UNION SELECT chat_id FROM s WHERE (place = 1 AND role = 'assistant') OR (role = 'user' AND following IS DISTINCT FROM 'assistant')
"""

P5_DIALOGUES_SQL = (
    "WITH dropped AS ("
    + P5_SQL
    + r"""),
m AS (
  SELECT chat_id, id, content, epoch_us(created_at) AS ts, lower(regexp_replace(role, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')) AS role
  FROM chat_messages
  WHERE chat_id IS NOT NULL AND content IS NOT NULL AND created_at IS NOT NULL AND NOT regexp_full_match(content, '[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}]*')
),
t AS (SELECT *, lag(ts) OVER (PARTITION BY chat_id, role, content ORDER BY ts, id) AS before FROM m WHERE role IN ('user', 'assistant')),
u AS (SELECT * FROM t WHERE before IS NULL OR ts - before > 10000000),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, role DESC, id) AS gap FROM u),
z AS (
  SELECT CASE WHEN gap <= 1800000000 THEN 0 WHEN gap <= 86400000000 THEN ceil(gap / 60000000)::BIGINT * 60000000
    WHEN gap <= 8640000000000 THEN ceil(gap / 3600000000)::BIGINT * 3600000000 ELSE ceil(gap / 86400000000)::BIGINT * 86400000000 END AS size
  FROM g WHERE gap IS NOT NULL
),
k AS (SELECT size, row_number() OVER (ORDER BY size) AS place, count(*) OVER () AS total FROM z),
b AS (SELECT greatest(coalesce(min(size), 0), 1800000000) AS bound FROM k WHERE place >= 0.99 * total)
SELECT chat_id, row_number() OVER w AS turn_no, 1 + sum(CASE WHEN gap > bound THEN 1 ELSE 0 END) OVER w AS sitting_no, role, content, id
FROM g, b WHERE chat_id NOT IN (SELECT chat_id FROM dropped)
WINDOW w AS (PARTITION BY chat_id ORDER BY ts, role DESC, id ROWS UNBOUNDED PRECEDING)
"""
)

P6_SQL = """
WITH b AS (SELECT prep_id, unnest(blocks) AS item, generate_subscripts(blocks, 1) AS item_no FROM preprocessed),
c AS (SELECT prep_id, unnest(chunks) AS item FROM preprocessed)
SELECT DISTINCT prep_id, 'block' AS item_kind, item_no FROM b WHERE length(item.text) > 900
UNION SELECT DISTINCT prep_id, 'chunk', item.chunk_id::bigint FROM c WHERE length(item.text) > 900
"""

P7_SQL = """
WITH u AS (
  SELECT id, embedding::DOUBLE[] AS v FROM rag_chunks
  WHERE id IS NOT NULL AND len(embedding) = 384 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY c DESC) AS place FROM s),
t AS (SELECT a, min(c) AS kth FROM k WHERE place <= 5 GROUP BY a)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM s JOIN t USING (a) WHERE c >= kth - 0.000001
"""

P6_CHECKED_SQL = """
WITH b AS (SELECT unnest(blocks) AS item FROM preprocessed), c AS (SELECT unnest(chunks) AS item FROM preprocessed)
SELECT item_kind, count(*) AS items, sum(n)::BIGINT AS chars, 0 AS faults
FROM (SELECT 'block' AS item_kind, length(item.text) AS n FROM b UNION ALL SELECT 'chunk', length(item.text) FROM c) WHERE n > 900 GROUP BY 1
"""

P8_CHECKED_SQL = "SELECT count(*) AS documents, sum(strlen(text) + 1)::BIGINT AS tokens, 0 AS overfull FROM documents WHERE text IS NOT NULL"

P8_SQL = "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) + 1 > 4096"

QUERIES = {
    "p2_found": p2_found, "p2_pages": p2_pages,
    "p4_found": p4_found, "p4_bodies": p4_bodies, "p3_found": p3_found, "p3_restored": p3_restored, "p5_found": p5_found, "p5_dialogues": p5_dialogues,
    "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_checked": p6_checked, "p8_checked": p8_checked, "p8_found": p8_found, "p8_containers": p8_containers,
    "p7_found": p7_found, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
}
ORACLES = {"p5_found": P5_SQL, "p5_dialogues": P5_DIALOGUES_SQL, "p6_found": P6_SQL, "p7_found": P7_SQL, "p8_found": P8_SQL, "p6_checked": P6_CHECKED_SQL, "p8_checked": P8_CHECKED_SQL}
