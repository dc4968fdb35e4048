"""Records, prompts, policies, rule data and sinks over the tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import one_blank
from corpusmill.operators import browse, chunking, features, policies, questions, records, search, store
from corpusmill.plans import retrieval
from corpusmill.plans.registry import Registry
from corpusmill.session import scratch_path
from corpusmill.sources import rules, sinks, web
from corpusmill.sources.tables import table

R = Registry()
_SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+"


def _surface() -> object:
    """A model that any text embedder could stand for: characters, digits and blanks of each text."""
    return lambda texts: np.array([[len(t), sum(c in "0123456789" for c in t), t.count(" ")] for t in texts], float)


@R.query("WITH v AS (SELECT id, length(content)::DOUBLE AS a, length(regexp_replace(content, '[^0-9]', '', 'g'))::DOUBLE AS b, (length(content) - length(replace(content, ' ', '')))::DOUBLE AS c FROM rag_chunks WHERE trim(regexp_replace(content, '" + _SPACE + "', ' ', 'g')) <> '') SELECT id, round(round(a / sqrt(a * a + b * b + c * c), 8), 4) AS x, round(round(b / sqrt(a * a + b * b + c * c), 8), 4) AS y, round(round(c / sqrt(a * a + b * b + c * c), 8), 4) AS z FROM v")
def model_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The vectors that a given model makes of the chunks, of unit length."""
    made = features.with_model_vector(table(spark, root, "rag_chunks").select("id", "content"), "content", _surface, 3, name="v").where("v IS NOT NULL")
    return made.select("id", *[F.round(F.col("v")[i], 4).alias(n) for i, n in enumerate("xyz")])


_ANSWERS = f"{retrieval._BASE}, top AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM scored QUALIFY rank <= 5)"
_TITLE = "coalesce(nullif(metadata['doc_title'], ''), nullif(metadata['source_file'], ''), nullif(metadata['title'], ''), {row}nullif(source_slug, ''), '(제목 없음)')"
_ROW_TITLE = _TITLE.format(row="nullif(title, ''), ")
_URI = "coalesce(nullif(url, ''), nullif(metadata['doc_url'], ''), nullif(metadata['source_page_url'], ''), nullif(metadata['attachment_url'], ''), '')"


def _top(spark: SparkSession, root: str) -> DataFrame:
    return search.match(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), retrieval._query_vector(spark, root), 5, -1.0)


@R.query(f"{_ANSWERS} SELECT {_ROW_TITLE} AS title, {_URI} AS uri, coalesce(content, '') AS content, round(similarity, 6) AS similarity FROM top")
def answer_sources(spark: SparkSession, root: str) -> DataFrame:
    """The sources of an answer, as its reader sees them."""
    return questions.as_sources(_top(spark, root)).withColumn("similarity", F.round("similarity", 6))


_BLOCK = f"'[' || rank || '] ' || {_TITLE.format(row='')} || CASE WHEN {_URI} <> '' THEN chr(10) || 'URL: ' || {_URI} ELSE '' END || chr(10) || CASE WHEN length(coalesce(content, '')) > 1200 THEN regexp_replace(left(content, 1199), '{_SPACE}$', '') || '…' ELSE coalesce(content, '') END"


@R.query(f"{_ANSWERS} SELECT '[질문]' || chr(10) || '{retrieval.QUESTION}' || chr(10) || chr(10) || '[참고 자료]' || chr(10) || regexp_replace(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank), '{_SPACE}$', '') || chr(10) || chr(10) || '[지시]' || chr(10) || '위 자료만 근거로, 시스템 규칙을 지켜 한국어로 답변하세요.' AS prompt FROM top")
def prompt_text(spark: SparkSession, root: str) -> DataFrame:
    """The prompt made of the results of a search."""
    placed = _top(spark, root).withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")))
    return questions.prompt(placed, "rank", retrieval.QUESTION)


def _provenance(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "preprocessed").select("prep_id", "slug", "source_file", "source_path", "source_relative_to_input", "source_ext", "chunks", F.col("provenance").alias("before"))
    kind = F.coalesce(one_blank(F.try_element_at("before", F.lit("source_kind"))), F.lit(""))
    is_file = (kind == "attachment") | ~F.coalesce(F.col("source_ext"), F.lit("")).isin("", ".json")
    names = [F.col("source_file"), *[F.try_element_at("before", F.lit(k)) for k in ("attachment_name", "source_page_url")], F.col("source_path")]
    return docs.withColumn("provenance", records.enriched(F.col("before"), is_file, names, "notice"))


_NAMES = f"trim(regexp_replace(coalesce(source_file, '') || ' ' || coalesce(provenance['attachment_name'], '') || ' ' || coalesce(provenance['source_page_url'], '') || ' ' || coalesce(source_path, ''), '{_SPACE}', ' ', 'g'))"


@R.query(f"""
WITH n AS (SELECT prep_id, provenance, {_NAMES} AS names, trim(coalesce(provenance['source_kind'], '')) = 'attachment' OR coalesce(source_ext, '') NOT IN ('', '.json') AS is_file FROM preprocessed)
SELECT prep_id, CASE WHEN NOT is_file THEN coalesce(provenance['document_kind'], 'post') WHEN names = '' THEN '' WHEN regexp_matches(names, '별표\\s*(?:제)?\\s*(\\d+)') THEN 'appendix_table'
  WHEN regexp_matches(names, '별지\\s*(?:제)?\\s*(\\d+)|서식|양식|신청서') THEN 'form' ELSE 'attachment' END AS document_kind FROM n""")
def enriched_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The kind of every file after its metadata was completed."""
    return _provenance(spark, root).select("prep_id", F.col("provenance")["document_kind"].alias("document_kind"))


def _records(spark: SparkSession, root: str) -> DataFrame:
    docs = _provenance(spark, root)
    base = records.base_metadata({"source_slug": F.col("slug"), "source_file": F.col("source_file"), "source_path": F.col("source_path"), "source_relative_to_input": F.col("source_relative_to_input"), "source_ext": F.col("source_ext"), "preprocessed_path": sinks.output_path(F.col("source_relative_to_input"))}, F.col("provenance"))
    placed = docs.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["num_lines"].alias("num_lines"), c["num_chars"].alias("num_chars"))))
    return chunking.chunk_records(placed, "slug", "chunks", base)


@R.query(f"""
WITH c AS (SELECT prep_id, slug, source_file, source_ext, provenance, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS place FROM preprocessed)
SELECT substr(sha256(slug || '::' || (place - 1)), 1, 16) AS id, slug AS source_slug, place - 1 AS chunk_index, coalesce(source_file, '') AS source_file, coalesce(provenance['doc_title'], '') AS doc_title, c.num_chars::VARCHAR AS num_chars, 31 AS n_keys
FROM c WHERE trim(regexp_replace(coalesce(c.text, ''), '{_SPACE}', ' ', 'g')) <> ''""")
def full_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of chunks with all that is known of their document."""
    m = F.col("metadata")
    return _records(spark, root).select("id", "source_slug", F.col("chunk_index").cast("long").alias("chunk_index"), m["source_file"].alias("source_file"), m["doc_title"].alias("doc_title"), m["num_chars"].alias("num_chars"), F.size("metadata").alias("n_keys"))


@R.query(f"""
WITH c AS (SELECT slug, source_file, source_path, source_ext, provenance AS p, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS place FROM preprocessed)
SELECT slug AS id, place - 1 AS chunk_index, coalesce(nullif(p['doc_title'], ''), nullif(source_file, '')) AS title, coalesce(nullif(p['doc_url'], ''), nullif(p['attachment_url'], '')) AS url, nullif(source_path, '') AS file_path, nullif(source_ext, '') AS file_ext,
  CASE WHEN regexp_replace(lower(trim(coalesce(source_ext, ''))), '^\\.', '') <> '' THEN regexp_replace(lower(trim(source_ext)), '^\\.', '') WHEN trim(coalesce(p['attachment_url'], '')) <> '' THEN 'attachment' WHEN trim(coalesce(p['doc_url'], '')) <> '' THEN 'web' ELSE 'unknown' END AS source_type
FROM c WHERE trim(regexp_replace(coalesce(c.text, ''), '{_SPACE}', ' ', 'g')) <> ''""")
def store_rows(spark: SparkSession, root: str) -> DataFrame:
    """What the store gets of every record: its source's columns with their defaults."""
    made = _records(spark, root).withColumn("embedding", F.array().cast("array<double>"))
    sources, chunks = records.store_rows(made.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("_index"), F.col("chunk_index").cast("string")))), "m")
    return sources.select("id", F.col("metadata")["_index"].cast("long").alias("chunk_index"), "title", "url", "file_path", "file_ext", "source_type")


@R.query("SELECT id, replace(title, chr(0), '') AS title, replace(metadata['category'], chr(0), '') AS category FROM rag_sources")
def nul_free(spark: SparkSession, root: str) -> DataFrame:
    """Sources without NUL characters anywhere in them."""
    return records.clean_of_nul(table(spark, root, "rag_sources").select("id", "title", "metadata")).select("id", "title", F.try_element_at("metadata", F.lit("category")).alias("category"))


@R.query("SELECT prep_id, coalesce(nullif(lower(regexp_extract(source_relative_to_input, '[^/]\\.([^./]+)$', 1)), ''), 'unknown') || '/' || regexp_replace(source_relative_to_input, '([^/])\\.[^./]*$', '\\1') || '.json' AS path FROM preprocessed WHERE source_relative_to_input IS NOT NULL")
def output_paths(spark: SparkSession, root: str) -> DataFrame:
    """Where the result of every file goes."""
    return table(spark, root, "preprocessed").where("source_relative_to_input IS NOT NULL").select("prep_id", sinks.output_path(F.col("source_relative_to_input")).alias("path"))


@R.query("WITH r AS (SELECT prep_id, source_path AS path, CASE WHEN chunks IS NULL THEN 'failed' WHEN len(chunks) = 0 THEN 'skipped' ELSE 'ok' END AS status, coalesce(len(chunks), 0) AS n FROM preprocessed) SELECT count(*) AS num_files, count(*) FILTER (WHERE status = 'ok') AS num_ok, count(*) FILTER (WHERE status = 'skipped') AS num_skipped, count(*) FILTER (WHERE status = 'failed') AS num_failed, sum(n)::BIGINT AS num_chunks, least(1000, count(*) FILTER (WHERE status = 'failed')) AS listed FROM r")
def run_manifest(spark: SparkSession, root: str) -> DataFrame:
    """What a run has done, with lists of what was skipped and what failed."""
    n = F.coalesce(F.when(F.col("chunks").isNotNull(), F.size("chunks")), F.lit(0))
    status = F.when(F.col("chunks").isNull(), "failed").when(n == 0, "skipped").otherwise("ok")
    done = table(spark, root, "preprocessed").select(F.col("source_path").alias("path"), status.alias("status"), F.when(status != "ok", "no chunks").alias("reason"), n.alias("num_chunks"))
    return sinks.manifest(done).select("num_files", "num_ok", "num_skipped", "num_failed", "num_chunks", F.size("failures").cast("long").alias("listed"))


@R.query("SELECT coalesce(nullif(lower(regexp_replace(coalesce(source_ext, ''), '^\\.', '')), ''), 'unknown') AS ext, count(*) AS n FROM preprocessed GROUP BY 1")
def laid_out(spark: SparkSession, root: str) -> DataFrame:
    """Documents written by kind of file and read back."""
    path = scratch_path(spark, "documents")
    sinks.write_documents(table(spark, root, "preprocessed").select("prep_id", "slug", "source_ext", "blocks"), path, "all")
    return spark.read.schema("prep_id long, slug string, dataset string, ext string").json(path).groupBy("ext").agg(F.count("*").alias("n"))


@R.query("""
WITH a AS (SELECT slug, arg_max(content_hash, capture_id) AS h FROM notice_posts WHERE run_id <= 24 AND slug IS NOT NULL GROUP BY 1), b AS (SELECT slug FROM notice_posts WHERE run_id > 24 AND slug IS NOT NULL GROUP BY 1)
SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN b.slug IS NULL THEN 'deleted' ELSE 'active' END AS status FROM a FULL JOIN b ON a.slug = b.slug""")
def saved_posts(spark: SparkSession, root: str) -> DataFrame:
    """The store of posts after a crawl: those seen again are active, the others are moved away."""
    posts = table(spark, root, "notice_posts").where("slug IS NOT NULL")
    last = lambda rows: rows.groupBy("slug").agg(F.max_by("content", "capture_id").alias("html"))
    current = last(posts.where("run_id <= 24")).withColumn("status", F.lit("active")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    seen = last(posts.where("run_id > 24"))
    gone = current.join(seen, "slug", "left_anti").select("slug")
    return sinks.saved_posts(current, seen, gone, now=F.lit(dt.datetime(2025, 7, 1))).select("slug", "status")


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """A tree payload of regions and nations: a few rows, as JSON in a string in JSON."""
    node = lambda i, parent, name, kind: F.struct(i.alias("id"), parent.alias("parent"), F.struct(name.alias("name"), F.lit(kind).alias("kindType"), F.lit("").alias("lid")).alias("data"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, root, "region").select(node(key("r", "r_regionkey"), F.lit("#"), F.col("r_name"), "group").alias("n"))
    nations = table(spark, root, "nation").select(node(key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_name"), "gyu").alias("n"))
    whole = regions.unionByName(nations).agg(F.to_json(F.struct(F.collect_list("n").alias("ruleTree"))).alias("tree"))
    return whole.select(F.to_json(F.struct(F.struct("tree").withField("treeData", F.col("tree")).dropFields("tree").alias("datas"))).alias("payload"))


@R.query("SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS titles, false AS is_target FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey")
def rule_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree of a payload with paths."""
    return rules.rule_tree(rules.tree_nodes(_tree(spark, root))).select("id", "depth", F.array_join("path_titles", "/").alias("titles"), "is_target")


@R.query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS num_nodes, (SELECT count(*) FROM nation) AS num_targets")
def tree_totals(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of a tree and those to be fetched."""
    return rules.tree_totals(rules.tree_nodes(_tree(spark, root)))


def _bylaws(spark: SparkSession, root: str) -> DataFrame:
    row = F.struct(F.col("doc_id").cast("string").alias("boardSeq"), F.col("title").alias("title"), F.lit("<p>a</p>").alias("cont"))
    return table(spark, root, "documents").where("doc_kind = 'rule'").select(F.to_json(F.struct(F.array(row).alias("datas"))).alias("payload"))


@R.query(f"SELECT doc_id, CASE WHEN doc_kind = 'rule' THEN trim(regexp_replace(coalesce(title, ''), '{_SPACE}', ' ', 'g')) END AS preview FROM documents WHERE doc_kind IN ('rule', 'guide')")
def bylaws(spark: SparkSession, root: str) -> DataFrame:
    """Rules and guides with the preview row that there is of the rules."""
    items = table(spark, root, "documents").where("doc_kind IN ('rule', 'guide')").select("doc_id", F.col("doc_id").cast("string").alias("board_seq"))
    return rules.with_previews(items, rules.bylaw_previews(_bylaws(spark, root))).select("doc_id", "preview.title").toDF("doc_id", "preview")


@R.query("WITH d AS (SELECT slug, min(prep_id) AS prep_id FROM (SELECT slug, prep_id, row_number() OVER (PARTITION BY slug ORDER BY processed_at DESC NULLS LAST, prep_id DESC) AS place FROM preprocessed) WHERE place = 1 GROUP BY 1) SELECT s.id, d.prep_id FROM rag_sources s LEFT JOIN d ON d.slug = s.id")
def page_documents(spark: SparkSession, root: str) -> DataFrame:
    """Sources with their file, by category and slug."""
    pages = table(spark, root, "rag_sources").select("id", F.lit("all").alias("category"), F.col("id").alias("slug"))
    newest = store.last_wins(table(spark, root, "preprocessed").select("slug", "prep_id", "processed_at"), ["slug"], ["processed_at", "prep_id"])
    docs = newest.select(F.lit("all").alias("category"), "slug", "prep_id", F.col("processed_at").alias("crawled_at"))
    return rules.with_documents(pages, docs).select("id", "document.prep_id")


@R.query("SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 3}')")
def contained_props(spark: SparkSession, root: str) -> DataFrame:
    """Events whose properties contain an object."""
    return table(spark, root, "events").where(search.contains_json(F.col("props"), {"k": 3})).select("event_id")


_USER = "(SELECT user_id FROM chats WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)"


def _user(spark: SparkSession, root: str) -> str:
    counts = table(spark, root, "chats").where("user_id IS NOT NULL").groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id")
    return counts.first()["user_id"]


@R.query(f"SELECT id FROM chat_messages WHERE chat_id IS NULL OR chat_id NOT IN (SELECT id FROM chats WHERE user_id = {_USER})")
def refused_messages(spark: SparkSession, root: str) -> DataFrame:
    """Messages that a user may not write."""
    return policies.refused(table(spark, root, "chat_messages"), table(spark, root, "chats"), _user(spark, root)).select("id")


@R.query(f"SELECT (SELECT count(*) FROM chats WHERE user_id IS DISTINCT FROM {_USER} AND id NOT IN (SELECT id FROM chats WHERE user_id = {_USER})) AS chats, (SELECT count(*) FROM chat_messages WHERE chat_id IS NULL OR chat_id NOT IN (SELECT id FROM chats WHERE user_id = {_USER})) AS messages")
def without_user(spark: SparkSession, root: str) -> DataFrame:
    """What stays when a user deletes all chats, of whoever: only the user's go."""
    chats, messages = table(spark, root, "chats"), table(spark, root, "chat_messages")
    left, kept = policies.deleted_chats(chats, messages, chats.select("id"), _user(spark, root))
    return left.agg(F.count("*").alias("chats")).join(F.broadcast(kept.agg(F.count("*").alias("messages"))))


@R.query("SELECT capture_id, place, NOT (regexp_matches(u, '\\.(html|htm|shtml|php|asp|aspx|jsp)$') OR regexp_matches(n, '\\.(html|htm|shtml|php|asp|aspx|jsp)$')) AND (regexp_matches(u, '\\.(pdf|hwp|hwpx|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|txt|csv|png|jpg|jpeg|gif)$') OR regexp_matches(n, '\\.(pdf|hwp|hwpx|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|txt|csv|png|jpg|jpeg|gif)$') OR regexp_matches(u, 'download|down|attach|file|atchfile')) AS is_file FROM (SELECT capture_id, generate_subscripts(attachments, 1) - 1 AS place, lower(coalesce(unnest(attachments).url, '')) AS u, lower(coalesce(unnest(attachments).name, '')) AS n FROM notice_posts)")
def attachment_links(spark: SparkSession, root: str) -> DataFrame:
    """Which links of posts lead to files."""
    each = table(spark, root, "notice_posts").select("capture_id", F.posexplode("attachments").alias("place", "a"))
    return each.select("capture_id", F.col("place").cast("long").alias("place"), web.is_attachment(F.col("a.url"), F.col("a.name")).alias("is_file"))


@R.query("SELECT id FROM rag_sources WHERE title IS NULL OR NOT regexp_matches(lower(title), '캠프|특강')")
def titles_without(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose title has none of some words."""
    return web.without_words(table(spark, root, "rag_sources"), "title", ["캠프", "특강"]).select("id")


@R.query("SELECT DISTINCT category, replace(replace(category, '·', '_'), ' ', '_') AS folder FROM rag_sources")
def category_folders(spark: SparkSession, root: str) -> DataFrame:
    """Categories as names of folders."""
    return table(spark, root, "rag_sources").select("category", web.category_folder(F.col("category")).alias("folder")).distinct()


@R.query("SELECT category, n, round(n / max(n) OVER (), 6) AS share, floor(100.0 * n / sum(n) OVER () + 0.5)::BIGINT || '%' AS percent FROM (SELECT category, count(*) AS n FROM rag_sources GROUP BY 1)")
def category_bars(spark: SparkSession, root: str) -> DataFrame:
    """Categories as bars of a chart."""
    sources = table(spark, root, "rag_sources")
    counts = browse.bars(sources.groupBy("category").agg(F.count("*").alias("n")), "n")
    total = F.broadcast(sources.agg(F.count("*").alias("total")))
    return counts.join(total).select("category", "n", F.round("share", 6).alias("share"), browse.percent(F.col("n") / F.col("total")).alias("percent"))


@R.query("SELECT run_id, list_page, min(post_no) AS lowest, max(post_no) AS highest FROM notice_posts GROUP BY ALL")
def page_bounds(spark: SparkSession, root: str) -> DataFrame:
    """The lowest and highest number on every list page."""
    return table(spark, root, "notice_posts").groupBy("run_id", "list_page").agg(F.min("post_no").alias("lowest"), F.max("post_no").alias("highest"))


@R.query("SELECT c.id, c.source_id, length(c.content) AS n_chars FROM rag_chunks c JOIN rag_sources s ON s.id = c.source_id WHERE s.status = 'active' AND length(c.content) > 60 ORDER BY n_chars DESC, c.id LIMIT 20")
def longest_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The longest chunks over a limit."""
    plan = store.oversized_plan(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), 60)
    return store.longest_first(plan, 20).select("id", "source_id", "n_chars")


@R.query("WITH p AS (SELECT c.id, c.source_id, length(c.content) AS n FROM rag_chunks c JOIN rag_sources s ON s.id = c.source_id WHERE s.status = 'active' AND length(c.content) > 60) SELECT count(DISTINCT source_id) AS sources, count(*) AS deleted, sum(ceil(n / 70.0))::BIGINT AS inserted FROM p")
def change_totals(spark: SparkSession, root: str) -> DataFrame:
    """What a rechunking at a smaller size touches."""
    chunks = table(spark, root, "rag_chunks")
    plan = store.oversized_plan(chunks, table(spark, root, "rag_sources"), 60)
    pieces = chunks.join(plan.select("id"), "id", "left_semi").select("id", F.posexplode(chunking.stride_slices(F.col("content"), 100, 30)).alias("piece_no", "content"))
    return store.change_totals(plan, pieces)


@R.query("SELECT capture_id AS id, len(attachments) AS n_attachments FROM notice_posts WHERE contains(replace(lower(coalesce(title, '')), ' ', ''), '안내') AND len(attachments) > 0 AND strftime(crawled_at::timestamptz AT TIME ZONE 'UTC', '%Y-%m-%d') >= '2024-01-01'")
def posts_view(spark: SparkSession, root: str) -> DataFrame:
    """Posts with attachments in the document browser."""
    posts = table(spark, root, "notice_posts").select(F.col("capture_id").alias("id"), "title", "category", F.date_format("crawled_at", "yyyy-MM-dd").alias("date"), F.coalesce(F.when(F.col("attachments").isNotNull(), F.size("attachments")), F.lit(0)).cast("long").alias("n_attachments"))
    return browse.documents_view(posts, None, "안 내", dt.date(2024, 1, 1), None, True).select("id", "n_attachments")


@R.query()
def section_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks packed into chunks that name their sections."""
    docs = table(spark, root, "preprocessed").select("prep_id", F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["style"].alias("section"))).alias("blocks"))
    return chunking.with_sectioned_chunks(docs).select("prep_id", "chunks")


QUERIES, ORACLES = R.queries, R.oracles
