"""Documents, blocks, posts, chats and lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import dates, ids, text
from corpusmill.operators import browse, chunking, questions, scoring, state, store, tree
from corpusmill.plans.registry import Registry
from corpusmill.sources import web
from corpusmill.sources.tables import table

R = Registry()
_SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+"


@R.query("SELECT doc_id, g.g + 1 AS slice_no, md5(substr(text, 1 + g.g * 780, 900)) AS digest FROM documents, range(0, 4000) g(g) WHERE g.g * 780 < length(text)")
def stride_slices(spark: SparkSession, root: str) -> DataFrame:
    """Every document in slices of 900 characters that overlap by 120."""
    d = table(spark, root, "documents").where("length(text) > 0")
    return d.select("doc_id", F.posexplode(chunking.stride_slices(F.col("text"))).alias("p", "slice")).select("doc_id", (F.col("p") + 1).cast("long").alias("slice_no"), F.md5("slice").alias("digest"))


@R.query(rf"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def white_space(spark: SparkSession, root: str) -> DataFrame:
    """Texts with single blanks."""
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.one_blank(F.col("text"))).alias("digest"))


_LINE_ENDS = r"\r\n|[\r\n\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"


@R.query(rf"WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_LINE_ENDS}')) AS line FROM documents) SELECT doc_id, count(*) AS n_lines FROM l WHERE trim(regexp_replace(line, '{_SPACE}', ' ', 'g')) <> '' GROUP BY 1")
def line_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Lines of every document that are not blank."""
    return table(spark, root, "documents").select("doc_id", F.size(text.line_blocks(F.col("text"))).cast("long").alias("n_lines")).where("n_lines > 0")


@R.query("WITH b AS (SELECT prep_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS place FROM preprocessed), t AS (SELECT prep_id, place, b.text AS x, lag(b.text) OVER (PARTITION BY prep_id ORDER BY place) AS before FROM b WHERE b.text IS NOT NULL) SELECT prep_id, count(*) AS kept FROM t WHERE before IS NULL OR x <> before GROUP BY 1")
def consecutive_distinct(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of every document without immediate repetitions."""
    texts = F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: t.isNotNull())
    return table(spark, root, "preprocessed").select("prep_id", F.size(text.consecutive_distinct(texts)).cast("long").alias("kept")).where("kept > 0")


@R.query("WITH p AS (SELECT prep_id, b.page_no AS page, string_split(b.text, chr(10)) AS l FROM (SELECT prep_id, unnest(blocks) AS b FROM preprocessed) WHERE b.block_type = 'ocr_paragraph' AND b.text IS NOT NULL), e AS (SELECT prep_id, unnest(list_concat(l[1:2], l[-2:])) AS line FROM p) SELECT prep_id, line, count(*) AS n FROM e WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) >= 3")
def repeated_edge_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines at the edges of three pages or more of a document."""
    lines = F.split("b.text", "\n")
    pages = table(spark, root, "preprocessed").select("prep_id", F.explode("blocks").alias("b")).where("b.block_type = 'ocr_paragraph' AND b.text IS NOT NULL")
    edges = F.concat(F.slice(lines, 1, 2), F.when(F.size(lines) >= 2, F.slice(lines, -2, 2)).otherwise(lines))
    return pages.select("prep_id", F.explode(edges).alias("line")).where("trim(line) <> ''").groupBy("prep_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


_BLOCK = "(SELECT prep_id, b.text AS text, place FROM (SELECT prep_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS place FROM preprocessed) WHERE b.text IS NOT NULL)"


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    placed = table(spark, root, "preprocessed").select("prep_id", F.posexplode("blocks").alias("p", "b")).where("b.text IS NOT NULL")
    return placed.select("prep_id", (F.col("p") + 1).cast("long").alias("place"), F.col("b.text").alias("text"))


@R.query(rf"SELECT prep_id, place FROM {_BLOCK} WHERE length(text) >= 80 AND ((len(regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]')) / length(text) >= 0.15 AND len(regexp_extract_all(text, '[\x{{AC00}}-\x{{D7A3}}]')) / length(text) <= 0.10) OR len(regexp_extract_all(text, '[?\x{{FFFD}}]')) / length(text) >= 0.08 OR len(regexp_extract_all(text, '\?\?')) >= 8)")
def broken_texts(spark: SparkSession, root: str) -> DataFrame:
    """Blocks whose text was extracted badly."""
    return _blocks(spark, root).where(text.looks_broken(F.col("text"))).select("prep_id", "place")


@R.query(rf"WITH l AS (SELECT prep_id, unnest(string_split(text, chr(10))) AS line FROM {_BLOCK}) SELECT prep_id, count(*) AS noise FROM l WHERE regexp_full_match(trim(line), '[-=*_~\s]{{3,}}|\d+\s*/\s*\d+') GROUP BY 1")
def noise_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines that say nothing (blank ones aside), by document."""
    lines = _blocks(spark, root).select("prep_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.is_noise_line(F.col("line")) & ~F.col("line").rlike(r"(?U)^\s*$")).groupBy("prep_id").agg(F.count("*").alias("noise"))


@R.query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(title, '')), '장학') OR contains(lower(coalesce(title, '')), 'scholarship')")
def title_keywords(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose title has one of some words."""
    return table(spark, root, "documents").where(text.contains_any(F.col("title"), ["장학", "Scholarship"])).select("doc_id")


@R.query("SELECT prep_id, coalesce(sum(length(c.text)), 0)::bigint AS chars, count(c.text) AS chunks FROM (SELECT prep_id, unnest(CASE WHEN len(chunks) > 0 THEN chunks ELSE [NULL] END) AS c FROM preprocessed) GROUP BY 1")
def chunk_totals(spark: SparkSession, root: str) -> DataFrame:
    """True sizes of every document's chunks, whatever its header says."""
    each = table(spark, root, "preprocessed").select("prep_id", F.explode_outer("chunks").alias("c"))
    return each.groupBy("prep_id").agg(F.coalesce(F.sum(F.length("c.text")), F.lit(0)).cast("long").alias("chars"), F.count("c.text").alias("chunks"))


@R.query("WITH c AS (SELECT slug, prep_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM preprocessed) SELECT prep_id, substr(sha256(slug || '::' || i), 1, 16) AS id, i AS chunk_index FROM c WHERE trim(regexp_replace(coalesce(c.text, ''), '\\s+', ' ', 'g')) <> ''".replace("\\\\s", "\\s"))
def chunk_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of all chunks with text; indexes count those without."""
    docs = table(spark, root, "preprocessed").withColumn("meta", F.coalesce("provenance", F.create_map().cast("map<string,string>")))
    placed = docs.withColumn("meta", F.map_from_arrays(F.array(F.lit("prep_id")), F.array(F.col("prep_id").cast("string"))))
    records = chunking.chunk_records(placed.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["num_lines"].alias("num_lines"), c["num_chars"].alias("num_chars")))), "slug", "chunks", F.col("meta"))
    return records.select(F.col("metadata")["prep_id"].cast("long").alias("prep_id"), "id", F.col("chunk_index").cast("long").alias("chunk_index"))


@R.query("SELECT lower(CASE WHEN source_ext LIKE '.%' THEN source_ext ELSE '.' || source_ext END) AS ext, count(*) AS n, count(*) FILTER (WHERE len(chunks) > 0) AS ok, count(*) FILTER (WHERE coalesce(len(chunks), 0) = 0) AS empty, coalesce(sum(len(chunks)), 0)::bigint AS chunks FROM preprocessed WHERE source_ext IS NOT NULL GROUP BY 1")
def manifest(spark: SparkSession, root: str) -> DataFrame:
    """What a run has done, by kind of file."""
    ext = F.lower(F.when(F.col("source_ext").startswith("."), F.col("source_ext")).otherwise(F.concat(F.lit("."), "source_ext")))
    size = F.coalesce(F.size("chunks"), F.lit(0))
    size = F.when(F.col("chunks").isNull(), 0).otherwise(size)
    kept = table(spark, root, "preprocessed").where("source_ext IS NOT NULL")
    return kept.groupBy(ext.alias("ext")).agg(F.count("*").alias("n"), F.count(F.when(size > 0, 1)).alias("ok"), F.count(F.when(size == 0, 1)).alias("empty"), F.sum(size).cast("long").alias("chunks"))


@R.query("SELECT count(*) AS documents, count(*) FILTER (WHERE scanned) AS scanned, round(100.0 * count(*) FILTER (WHERE scanned) / count(*), 1) AS percent FROM (SELECT coalesce(list_bool_or(list_transform(blocks, lambda b: b.block_type = 'ocr_paragraph')), false) AS scanned FROM preprocessed)")
def scanned_share(spark: SparkSession, root: str) -> DataFrame:
    """How many documents are scanned."""
    scanned = F.coalesce(F.exists("blocks", lambda b: b["block_type"] == "ocr_paragraph"), F.lit(False))
    n = F.count(F.when(scanned, 1))
    return table(spark, root, "preprocessed").agg(F.count("*").alias("documents"), n.alias("scanned"), F.round(100.0 * n / F.count("*"), 1).alias("percent"))


@R.query("SELECT prep_id, slug, substr(md5(coalesce(source_relative_to_input, '')), 1, 12) AS expected FROM preprocessed")
def file_slugs(spark: SparkSession, root: str) -> DataFrame:
    """The slug of every file and the one its path should have."""
    return table(spark, root, "preprocessed").select("prep_id", "slug", ids.slug(F.col("source_relative_to_input")).alias("expected"))


@R.query("SELECT capture_id, substr(md5(coalesce(url, '') || '|' || coalesce(title, '')), 1, 12) AS slug FROM notice_posts")
def post_slugs(spark: SparkSession, root: str) -> DataFrame:
    """Slugs of posts by address and title."""
    return table(spark, root, "notice_posts").select("capture_id", ids.slug(F.col("url"), F.col("title")).alias("slug"))


@R.query("WITH p AS (SELECT *, regexp_extract(trim(replace(list_date, chr(160), ' ')), '^(\\d{4})\\D*(\\d{1,2})\\D+(\\d{1,2})', ['y', 'm', 'd']) AS a, trim(replace(list_date, chr(160), ' ')) AS t FROM notice_posts) SELECT capture_id, strftime(coalesce(try_strptime(CASE WHEN regexp_full_match(t, '\\d{8}') THEN t END, '%Y%m%d'), try_strptime(a.y || lpad(a.m, 2, '0') || lpad(a.d, 2, '0'), '%Y%m%d')), '%Y-%m-%d') AS day FROM p".replace("\\\\", "\\"))
def list_days(spark: SparkSession, root: str) -> DataFrame:
    """The calendar day of every sighting."""
    return table(spark, root, "notice_posts").select("capture_id", F.date_format(dates.calendar_day(F.col("list_date")), "yyyy-MM-dd").alias("day"))


_A, _B = "run_id <= 20", "run_id > 20"
_STATE = "SELECT post_no, title, coalesce(content, '') AS content, list_sort(list_distinct(coalesce(categories, []))) AS categories FROM (SELECT *, row_number() OVER (PARTITION BY post_no ORDER BY crawled_at DESC, capture_id DESC) AS place FROM notice_posts WHERE {where}) WHERE place = 1"


@R.query(f"WITH s AS ({_STATE.format(where=_A)}), n AS ({_STATE.format(where=_B)}) SELECT coalesce(s.post_no, n.post_no) AS post_no, CASE WHEN s.post_no IS NULL THEN 'new' WHEN n.post_no IS NULL THEN 'missing' WHEN s.title = n.title AND s.content = n.content AND s.categories = n.categories THEN 'skipped' ELSE 'updated' END AS kind FROM s FULL JOIN n ON s.post_no = n.post_no")
def change_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Posts as known after some runs against what later runs saw."""
    posts = table(spark, root, "notice_posts").withColumn("content", F.coalesce("content", F.lit("")))
    latest = lambda where: store.last_wins(posts.where(where), ["post_no"], ["crawled_at", "capture_id"])
    return state.change_kinds(latest(_A), latest(_B), "post_no", ["title", "content"], ["categories"])


@R.query(f"WITH m AS (SELECT category, max(notice_no) AS last_no FROM notice_posts WHERE {_A} GROUP BY 1) SELECT capture_id FROM notice_posts p LEFT JOIN m ON m.category IS NOT DISTINCT FROM p.category WHERE {_B} AND (p.notice_no IS NULL OR m.last_no IS NULL OR p.notice_no > m.last_no)")
def above_watermark(spark: SparkSession, root: str) -> DataFrame:
    """Later sightings above the last number of their board."""
    posts = table(spark, root, "notice_posts")
    marks = posts.where(_A).groupBy("category").agg(F.max("notice_no").alias("last_no"))
    return state.above_watermark(posts.where(_B), marks, "category", "notice_no").select("capture_id")


@R.query(f"WITH m AS (SELECT category, max(notice_no) AS last_no FROM notice_posts GROUP BY 1) SELECT coalesce(category, '') AS category, coalesce(last_no, -1) AS last_no FROM m")
def watermarks(spark: SparkSession, root: str) -> DataFrame:
    """The last number of every board after two runs."""
    posts = table(spark, root, "notice_posts")
    marks = posts.where(_A).groupBy("category").agg(F.max("notice_no").alias("last_no"))
    return state.advanced(marks, posts.where(_B), "category", "notice_no").select(F.coalesce("category", F.lit("")).alias("category"), F.coalesce("last_no", F.lit(-1)).alias("last_no"))


@R.query("WITH k AS (SELECT DISTINCT post_no FROM notice_posts WHERE run_id <= 44), s AS (SELECT DISTINCT post_no, run_id FROM notice_posts WHERE run_id IN (45, 46, 47)), a AS (SELECT post_no FROM k UNION SELECT post_no FROM s), c AS (SELECT post_no, CASE WHEN post_no IN (SELECT post_no FROM s WHERE run_id = 47) THEN 0 WHEN post_no IN (SELECT post_no FROM s WHERE run_id = 46) THEN 1 WHEN post_no IN (SELECT post_no FROM s WHERE run_id = 45) THEN 2 ELSE 3 END AS miss_count FROM a) SELECT post_no, miss_count, miss_count >= 3 AS evicted FROM c")
def miss_counter(spark: SparkSession, root: str) -> DataFrame:
    """Posts that the last three runs did not see."""
    posts = table(spark, root, "notice_posts")
    known = posts.where("run_id <= 44").select("post_no", F.lit(0).alias("miss_count")).distinct()
    for run in (45, 46, 47):
        known = state.misses(known, posts.where(F.col("run_id") == run), "post_no")
    return known.select("post_no", "miss_count", "evicted")


@R.query("SELECT post_no, bool_or(is_notice) AS is_notice, arg_min(notice_no, capture_id) FILTER (WHERE notice_no IS NOT NULL) IS NOT NULL AS numbered, array_to_string(list_sort(list_distinct(flatten(list(coalesce(categories, []))))), '|') AS categories FROM notice_posts GROUP BY 1")
def merged_sightings(spark: SparkSession, root: str) -> DataFrame:
    """One row a post of all its sightings."""
    merged = state.merged_sightings(table(spark, root, "notice_posts"), "post_no", "capture_id", ["categories"], ["is_notice"], ["notice_no"])
    return merged.select("post_no", "is_notice", F.col("notice_no").isNotNull().alias("numbered"), F.array_join("categories", "|").alias("categories"))


@R.query("SELECT p.capture_id, a.saved_path, p.title FROM (SELECT capture_id, title, unnest(attachments) AS a FROM notice_posts) p WHERE p.a.downloaded AND (p.capture_id, p.a.saved_path) IN (SELECT (max(capture_id), a.saved_path) FROM (SELECT capture_id, unnest(attachments) AS a FROM notice_posts) WHERE a.downloaded AND a.saved_path IS NOT NULL GROUP BY a.saved_path)".replace("(SELECT (max(capture_id), a.saved_path)", "(SELECT max(capture_id), a.saved_path"))
def attachment_provenance(spark: SparkSession, root: str) -> DataFrame:
    """For every saved file the sighting that wrote it last."""
    each = table(spark, root, "notice_posts").select("capture_id", "title", F.explode("attachments").alias("a")).where("a.downloaded AND a.saved_path IS NOT NULL")
    best = each.groupBy(F.col("a.saved_path").alias("saved_path")).agg(F.max(F.struct("capture_id", "title")).alias("last"))
    again = each.select("capture_id", F.col("a.saved_path").alias("saved_path"), "title")
    return again.join(best.select("saved_path", F.col("last.capture_id").alias("capture_id")), ["capture_id", "saved_path"]).select("capture_id", "saved_path", "title")


@R.query("WITH a AS (SELECT capture_id, unnest(attachments) AS a FROM notice_posts) SELECT n.capture_id, n.a.url AS url, count(o.capture_id) > 0 AS have FROM a n LEFT JOIN a o ON o.a.url = n.a.url AND o.capture_id < n.capture_id AND o.a.downloaded WHERE NOT n.a.downloaded GROUP BY ALL")
def attachment_reuse(spark: SparkSession, root: str) -> DataFrame:
    """Failed downloads of files that an earlier sighting has."""
    each = table(spark, root, "notice_posts").select("capture_id", F.explode("attachments").alias("a"))
    have = each.where("a.downloaded").groupBy(F.col("a.url").alias("url")).agg(F.min("capture_id").alias("first"))
    missing = each.where("NOT a.downloaded").select("capture_id", F.col("a.url").alias("url")).distinct()
    return missing.join(have, "url", "left").select("capture_id", "url", F.coalesce(F.col("first") < F.col("capture_id"), F.lit(False)).alias("have"))


@R.query("SELECT capture_id, coalesce(string_agg(DISTINCT trim(a.name), ' / ' ORDER BY trim(a.name)), '') AS names FROM (SELECT capture_id, unnest(attachments) AS a FROM notice_posts) WHERE trim(a.name) <> '' GROUP BY 1")
def joined_names(spark: SparkSession, root: str) -> DataFrame:
    """The distinct names of a sighting's attachments, joined."""
    names = F.array_sort(F.filter(F.transform("attachments", lambda a: a["name"]), lambda n: n.isNotNull()))
    return table(spark, root, "notice_posts").where(F.size("attachments") > 0).select("capture_id", text.ordered_join(names, " / ").alias("names"))


@R.query("SELECT capture_id FROM notice_posts WHERE len(list_filter(attachments, lambda a: regexp_matches(lower(a.name), '\\.(pdf|hwp|hwpx|docx|xlsx|pptx|zip)$'))) > 0".replace("\\\\", "\\"))
def with_documents(spark: SparkSession, root: str) -> DataFrame:
    """Sightings with an attachment that can be read."""
    return table(spark, root, "notice_posts").where(F.exists("attachments", lambda a: F.lower(a["name"]).rlike(r"\.(pdf|hwp|hwpx|docx|xlsx|pptx|zip)$"))).select("capture_id")


@R.query("WITH l AS (SELECT run_id, post_no AS path, CASE WHEN len(list_filter(attachments, lambda a: NOT a.downloaded)) > 0 THEN 'FAIL' ELSE 'OK' END AS status, capture_id FROM notice_posts) SELECT path FROM l GROUP BY 1 HAVING arg_max(status, capture_id) = 'FAIL'")
def failed_last(spark: SparkSession, root: str) -> DataFrame:
    """Posts whose last sighting failed to download something."""
    lines = table(spark, root, "notice_posts").select(F.col("post_no").alias("path"), F.when(F.exists("attachments", lambda a: ~a["downloaded"]), "FAIL").otherwise("OK").alias("status"), "capture_id")
    return state.last_status(lines, "path", "status", "capture_id").where("status = 'FAIL'").select("path")


@R.query("SELECT capture_id, regexp_matches(title, '별표\\s*(제)?\\s*\\d+') AS appendix, regexp_matches(title, '서식|양식|신청서') AS form FROM notice_posts".replace("\\\\", "\\"))
def attachment_kinds(spark: SparkSession, root: str) -> DataFrame:
    """What titles say of forms and appendices."""
    kind = scoring.attachment_kind(F.col("title"))["kind"]
    return table(spark, root, "notice_posts").select("capture_id", (kind == "appendix_table").alias("appendix"), (kind == "form").alias("form"))


@R.query("WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL::varchar AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), w AS (SELECT id, id AS root_id, 0 AS depth, [id] AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.root_id, w.depth + 1, list_append(w.path, n.id) FROM n JOIN w ON n.parent_id = w.id) SELECT id, root_id, depth, array_to_string(path, '/') AS path FROM w")
def tree_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of a forest of regions, nations and suppliers."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = table(spark, root, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nodes = nodes.union(table(spark, root, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(table(spark, root, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))
    return tree.tree_paths(nodes).select("id", "root_id", "depth", F.array_join("path_ids", "/").alias("path"))


@R.query("SELECT s.id, coalesce(a.prep_id, b.prep_id) AS prep_id FROM rag_sources s LEFT JOIN (SELECT slug, min(prep_id) AS prep_id FROM preprocessed GROUP BY 1) a ON a.slug = s.source_slug LEFT JOIN (SELECT slug, min(prep_id) AS prep_id FROM preprocessed GROUP BY 1) b ON b.slug = s.id")
def prioritized_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The file of every source by the first of several keys."""
    files = table(spark, root, "preprocessed").groupBy("slug").agg(F.min("prep_id").alias("prep_id"))
    sources = table(spark, root, "rag_sources").select("id", "source_slug", F.col("id").alias("second"))
    return tree.prioritized_lookup(sources, "id", ["source_slug", "second"], files, "slug", "prep_id")


@R.query("SELECT id, title FROM rag_sources WHERE category IN ('채용', '비교과') AND contains(replace(lower(coalesce(title, '')), ' ', ''), '캠프') ORDER BY id")
def documents_view(spark: SparkSession, root: str) -> DataFrame:
    """The document browser with filters."""
    docs = table(spark, root, "rag_sources").select("id", "title", "category", F.date_format("processed_at", "yyyy-MM-dd").alias("date"), F.lit(0).alias("n_attachments"))
    return browse.documents_view(docs, ["채용", "비교과"], "캠프", dt.date(2000, 1, 1), dt.date(2100, 1, 1), False).select("id", "title")


@R.query("SELECT doc_id, abusive, reviewer FROM review_labels WHERE abusive = 1 ORDER BY reviewed_at DESC NULLS LAST, doc_id, reviewer LIMIT 10 OFFSET 10")
def feedback_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of judgements of one kind."""
    rows = table(spark, root, "review_labels").where("abusive = 1").orderBy(F.col("reviewed_at").desc_nulls_last(), "doc_id", "reviewer")
    return browse.page(rows, 2).select("doc_id", "abusive", "reviewer")


_USER = "(SELECT user_id FROM chats WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)"


def _user(spark: SparkSession, root: str) -> str:
    counts = table(spark, root, "chats").where("user_id IS NOT NULL").groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id")
    return counts.first()["user_id"]


@R.query(f"SELECT DISTINCT id, epoch_us(updated_at) AS updated_us FROM chats WHERE user_id = {_USER}")
def chat_list(spark: SparkSession, root: str) -> DataFrame:
    """A user's chats."""
    return browse.owned(table(spark, root, "chats"), _user(spark, root)).select("id", F.unix_micros("updated_at").alias("updated_us")).distinct()


@R.query(f"SELECT id, chat_id FROM chat_messages WHERE chat_id IN (SELECT id FROM chats WHERE user_id = {_USER})")
def owned_messages(spark: SparkSession, root: str) -> DataFrame:
    """The messages of a user's chats."""
    return browse.owned_messages(table(spark, root, "chat_messages"), table(spark, root, "chats"), _user(spark, root)).select("id", "chat_id")


@R.query("SELECT c.id, epoch_us(max(greatest(c.updated_at, coalesce(m.newest, c.updated_at)))) AS updated_us FROM chats c LEFT JOIN (SELECT chat_id, max(created_at) AS newest FROM chat_messages GROUP BY 1) m ON m.chat_id = c.id GROUP BY 1")
def touched_chats(spark: SparkSession, root: str) -> DataFrame:
    """Chats moved on to their newest message."""
    return browse.touched(table(spark, root, "chats"), table(spark, root, "chat_messages")).groupBy("id").agg(F.max(F.unix_micros("updated_at")).alias("updated_us"))


@R.query("SELECT count(*) FILTER (WHERE coalesce(role IN ('user', 'assistant'), false)) AS kept, count(*) FILTER (WHERE NOT coalesce(role IN ('user', 'assistant'), false)) AS refused FROM chat_messages")
def role_check(spark: SparkSession, root: str) -> DataFrame:
    """Messages that the role constraint keeps and refuses."""
    kept, refused = store.quarantine(table(spark, root, "chat_messages"), {"role": F.col("role").isin("user", "assistant")})
    marked = kept.select(F.lit(1).alias("ok")).unionByName(refused.select(F.lit(0).alias("ok")))
    return marked.agg(F.count(F.when(F.col("ok") == 1, 1)).alias("kept"), F.count(F.when(F.col("ok") == 0, 1)).alias("refused"))


@R.query("SELECT m.id, (j.value->>'title') AS title FROM chat_messages m, json_each(m.sources) j WHERE m.sources IS NOT NULL AND json_valid(m.sources)")
def stored_sources(spark: SparkSession, root: str) -> DataFrame:
    """The sources that messages carry."""
    return table(spark, root, "chat_messages").where("sources IS NOT NULL").select("id", F.explode(browse.stored_sources(F.col("sources"))).alias("s")).select("id", "s.title")


_ONE_TITLE = f"trim(regexp_replace(title, '{_SPACE}', ' ', 'g'))"


@R.query(f"SELECT DISTINCT id, CASE WHEN length({_ONE_TITLE}) > 12 THEN left({_ONE_TITLE}, 12) || '…' ELSE {_ONE_TITLE} END AS short FROM chats WHERE title IS NOT NULL")
def chat_titles(spark: SparkSession, root: str) -> DataFrame:
    """Short titles of chats."""
    return table(spark, root, "chats").where("title IS NOT NULL").select("id", text.chat_title(F.col("title"), 12).alias("short")).distinct()


@R.query("SELECT category, CASE category WHEN '공지사항' THEN 1 WHEN '학사안내' THEN 2 ELSE 999 END AS place, count(*) AS n FROM rag_sources GROUP BY ALL")
def category_order(spark: SparkSession, root: str) -> DataFrame:
    """Categories in a fixed order."""
    return table(spark, root, "rag_sources").groupBy("category").agg(F.count("*").alias("n")).select("category", browse.in_order(F.col("category"), ["공지사항", "학사안내"]).cast("int").alias("place"), "n")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def semi_join(spark: SparkSession, root: str) -> DataFrame:
    """A pruned scan and a semi-join."""
    orders = table(spark, root, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, root, "lineitem").where("l_shipdate >= TIMESTAMP '1998-01-01'").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@R.query("SELECT event_type, count(*) AS n, max(value) AS top, count(*) FILTER (WHERE (props->>'k')::int >= 5) AS large FROM events GROUP BY 1")
def event_props(spark: SparkSession, root: str) -> DataFrame:
    """Counts over JSON properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.count(F.when(k >= 5, 1)).alias("large"))


@R.query("SELECT url, capture_id FROM (SELECT url, capture_id, row_number() OVER (PARTITION BY url ORDER BY length(title) DESC NULLS LAST, capture_id) AS place FROM notice_posts WHERE coalesce(url, '') <> '') WHERE place = 1")
def longest_titles(spark: SparkSession, root: str) -> DataFrame:
    """For every address the sighting with the longest title."""
    return web.longest_titles(table(spark, root, "notice_posts"), "url", "title", "capture_id").select("url", "capture_id")


@R.query("SELECT capture_id, TRY_CAST(regexp_extract(title, '(20\\d{2})', 1) AS INT) AS year FROM notice_posts WHERE regexp_matches(title, '20\\d{2}')".replace("\\\\", "\\"))
def title_years(spark: SparkSession, root: str) -> DataFrame:
    """The year that a title names."""
    none = F.lit(None).cast("string")
    return table(spark, root, "notice_posts").select("capture_id", web.inferred_year(none.cast("int"), F.col("title"), none, none).alias("year")).where("year IS NOT NULL")


@R.query()
def unique_names(spark: SparkSession, root: str) -> DataFrame:
    """Names under which all attachments of a post can be kept in one folder."""
    each = table(spark, root, "notice_posts").select("post_no", "capture_id", F.posexplode("attachments").alias("p", "a")).select("post_no", F.concat_ws("-", F.lpad(F.col("capture_id").cast("string"), 12, "0"), "p").alias("place"), "a.name")
    return web.unique_names(each.where("name IS NOT NULL"), "post_no", "name", "place").select("post_no", "place", "unique_name")


@R.query()
def cleaned_texts(spark: SparkSession, root: str) -> DataFrame:
    """Documents cleaned of the traces of layout."""
    return table(spark, root, "documents").select("doc_id", text.cleaned(F.col("text")).alias("cleaned"))


@R.query()
def packed_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks packed into chunks anew."""
    fallback = chunking.fallback_text([("문서 파일명", F.col("source_file")), ("문서 경로", F.col("source_path"))])
    docs = chunking.with_chunks(table(spark, root, "preprocessed").select("prep_id", "blocks", "source_file", "source_path"), "blocks", fallback)
    return docs.select("prep_id", "chunks", "used_metadata_fallback")


@R.query()
def search_forms(spark: SparkSession, root: str) -> DataFrame:
    """The search form of every question that users asked."""
    asked = table(spark, root, "chat_messages").where("lower(trim(role)) = 'user' AND content IS NOT NULL").select("id", "content")
    return questions.with_search_form(asked, "content")


@R.query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def event_runs(spark: SparkSession, root: str) -> DataFrame:
    """The place of every event among those of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, root, "events").select("event_id", "user_id", F.row_number().over(w).alias("place"))


QUERIES, ORACLES = R.queries, R.oracles
