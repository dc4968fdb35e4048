"""Search, ranking, audits and upkeep of the sources and chunks tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.ids import chunk_key, content_hash
from corpusmill.functions.text import snippet, token_count
from corpusmill.operators import features, scoring, search, store
from corpusmill.plans.registry import Registry
from corpusmill.sources.tables import table

R = Registry()
TODAY = dt.date(2025, 7, 1)
#: The question that the search queries stand for.
QUESTION = "장학금 신청서 양식 안내"


def _query_vector(spark: SparkSession, root: str) -> list[float]:
    """The vector of the usable chunk with the smallest id: one row, as a question would have."""
    usable = table(spark, root, "rag_chunks").where((F.size("embedding") == 384) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("embedding", lambda x: x != 0))
    return list(usable.orderBy("id").select("embedding").first()[0])


def _priority(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, priority_score): the quality of every source by its title and address."""
    s = table(spark, root, "rag_sources")
    return s.select(F.col("id").alias("source_id"), F.round(scoring.source_quality(F.col("metadata"), F.col("title")), 6).alias("priority_score"))


_USABLE = "len(embedding) = 384 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_BASE = f"""
WITH q AS (SELECT embedding::DOUBLE[384] AS v FROM rag_chunks WHERE {_USABLE} ORDER BY id LIMIT 1),
usable AS (SELECT * FROM rag_chunks WHERE {_USABLE}),
scored AS (
  SELECT c.id, c.source_id, s.source_slug, s.source_type, s.title, s.url, map_from_entries(list_concat(list_filter(map_entries(coalesce(s.metadata, MAP {{}})), lambda e: NOT list_contains(map_keys(coalesce(c.metadata, MAP {{}})), e.key)), map_entries(coalesce(c.metadata, MAP {{}})))) AS metadata, c.chunk_id, c.chunk_index, c.content,
         coalesce(c.metadata['category'], s.metadata['category']) AS category, s.metadata['doc_title'] AS doc_title, s.metadata['source_file'] AS source_file,
         list_cosine_similarity(c.embedding::DOUBLE[384], q.v) AS similarity
  FROM usable c JOIN rag_sources s ON s.id = c.source_id AND s.status = 'active', q
)"""
_PRIORITY = """priority AS (
  SELECT id AS source_id, round(least(1.0, 0.65 * least(1.0, log10(greatest(length(coalesce(title, '')), 10)) / 4.0)
    + 0.35 * (0.5 + CASE WHEN trim(coalesce(nullif(metadata['doc_title'], ''), metadata['source_file'], '')) <> '' THEN 0.25 ELSE 0 END
                  + CASE WHEN trim(coalesce(nullif(metadata['doc_url'], ''), metadata['source_page_url'], '')) <> '' THEN 0.25 ELSE 0 END)), 6) AS priority_score
  FROM rag_sources)"""


@R.query("SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[64], (SELECT embedding::DOUBLE[64] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten vectors most similar to the first."""
    vectors = table(spark, root, "embeddings")
    query = list(vectors.where("vec_id = 0").first()["embedding"])
    return vectors.select("vec_id", "label", F.round(search.cosine(F.col("embedding"), query), 6).alias("similarity")).orderBy(F.col("similarity").desc(), "vec_id").limit(10)


@R.query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[64], (SELECT embedding::DOUBLE[64] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[64], (SELECT embedding::DOUBLE[64] FROM embeddings WHERE vec_id = 0)) >= 0.2")
def vector_threshold(spark: SparkSession, root: str) -> DataFrame:
    """All vectors above a similarity."""
    vectors = table(spark, root, "embeddings")
    query = list(vectors.where("vec_id = 0").first()["embedding"])
    return vectors.withColumn("s", search.cosine(F.col("embedding"), query)).where("s >= 0.2").select("vec_id", F.round("s", 6).alias("similarity"))


@R.query(f"{_BASE} SELECT id, source_slug, chunk_index, category, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.05 ORDER BY scored.similarity DESC, id LIMIT 10")
def chunk_match(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of active sources by similarity, with merged metadata."""
    found = search.match(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _query_vector(spark, root), 10, 0.05)
    return found.select("id", "source_slug", "chunk_index", F.col("metadata")["category"].alias("category"), F.round("similarity", 6).alias("similarity"))


@R.query(f"{_BASE} SELECT id, source_slug, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.0 AND category = '채용' ORDER BY scored.similarity DESC, id LIMIT 10")
def chunk_match_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The same among chunks whose metadata contain an entry."""
    found = search.match(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _query_vector(spark, root), 10, 0.0, {"category": "채용"})
    return found.select("id", "source_slug", F.round("similarity", 6).alias("similarity"))


@R.query(f"{_BASE}, b AS (SELECT id, source_type, similarity, row_number() OVER (PARTITION BY source_type ORDER BY similarity DESC, id) AS r FROM scored WHERE similarity >= 0.0 AND source_type IN ('hwp', 'pdf')) SELECT id, source_type, round(similarity, 6) AS similarity FROM b WHERE r <= 10 ORDER BY b.similarity DESC, CASE source_type WHEN 'hwp' THEN 0 ELSE 1 END, r LIMIT 10")
def multi_branch_topk(spark: SparkSession, root: str) -> DataFrame:
    """The best of several searches."""
    chunks, sources, query = table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _query_vector(spark, root)
    branches = [search.match(chunks, sources.where(F.col("source_type") == kind), query, 10, 0.0).select("id", "source_type", "similarity") for kind in ("hwp", "pdf")]
    return search.fan_out(branches, 10).select("id", "source_type", F.round("similarity", 6).alias("similarity"))


@R.query(f"{_BASE}, {_PRIORITY}, r AS (SELECT s.id, s.similarity, p.priority_score, CASE WHEN regexp_matches(coalesce(s.source_file, ''), '별지|서식') THEN 0.14 ELSE 0.0 END AS boost FROM scored s JOIN priority p USING (source_id) WHERE s.similarity >= 0.0) SELECT id, round(similarity, 6) AS similarity, round(similarity * 0.85 + priority_score * 0.15 + boost, 6) AS final_score FROM r ORDER BY r.similarity * 0.85 + priority_score * 0.15 + boost DESC, r.similarity DESC, id LIMIT 10")
def hybrid_rank(spark: SparkSession, root: str) -> DataFrame:
    """Similarity mixed with priority, plus what the question asks for."""
    found = search.ranked(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _query_vector(spark, root), _priority(spark, root), search.Intent.of(QUESTION, "student_life"), 10, 0.0)
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.round("final_score", 6).alias("final_score"))


@R.query(f"{_BASE}, {_PRIORITY} SELECT s.id, round(similarity, 6) AS similarity, priority_score FROM scored s JOIN priority p USING (source_id) WHERE similarity >= 0.0 ORDER BY s.similarity DESC, s.id LIMIT 10")
def similarity_rank(spark: SparkSession, root: str) -> DataFrame:
    """By similarity alone, with the priority beside it."""
    found = search.ranked(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _query_vector(spark, root), _priority(spark, root), search.Intent(), 10, 0.0, by="similarity")
    return found.select("id", F.round("similarity", 6).alias("similarity"), "priority_score")


@R.query(f"WITH {_PRIORITY} SELECT s.id AS source_id, s.title, p.priority_score, left(coalesce((SELECT string_agg(coalesce(c.content, ''), chr(10) || chr(10) ORDER BY c.chunk_index, c.id) FROM rag_chunks c WHERE c.source_id = s.id), ''), 1200) AS content FROM rag_sources s JOIN priority p ON p.source_id = s.id WHERE s.status = 'active' ORDER BY p.priority_score DESC, s.updated_at DESC, s.id LIMIT 10")
def priority_listing(spark: SparkSession, root: str) -> DataFrame:
    """Sources by priority, with the beginning of their text."""
    found = search.by_priority(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), _priority(spark, root), search.Intent(), 10)
    return found.select("source_id", "title", "priority_score", "content")


@R.query("SELECT 'status' AS facet, status AS value, count(*) AS n FROM rag_sources GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM rag_sources GROUP BY 2 UNION ALL SELECT 'file_ext', file_ext, count(*) FROM rag_sources GROUP BY 2 UNION ALL SELECT 'embedding_dim', embedding_dim::varchar, count(*) FROM rag_chunks GROUP BY 2")
def audit_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts by status, category, extension and dimension."""
    sources, chunks = table(spark, root, "rag_sources"), table(spark, root, "rag_chunks")
    facet = lambda df, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return facet(sources, "status").union(facet(sources, "category")).union(facet(sources, "file_ext")).union(facet(chunks, "embedding_dim"))


@R.query("SELECT count(*) AS total, count(*) FILTER (WHERE file_ext IN ('json', '.json')) AS from_json, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE title IS NULL OR length(trim(title)) = 0) AS untitled, count(*) FILTER (WHERE url LIKE 'https://%') AS secure, count(*) FILTER (WHERE title ILIKE '%notice%') AS notices FROM rag_sources")
def audit_filtered_counts(spark: SparkSession, root: str) -> DataFrame:
    """Several counts in one pass."""
    n = lambda test: F.count(F.when(test, 1))
    title = F.col("title")
    return table(spark, root, "rag_sources").agg(
        F.count("*").alias("total"), n(F.col("file_ext").isin("json", ".json")).alias("from_json"), n(F.col("status") == "active").alias("active"), n(title.isNull() | (F.length(F.trim(title)) == 0)).alias("untitled"),
        n(F.col("url").like("https://%")).alias("secure"), n(title.ilike("%notice%")).alias("notices"),
    )


@R.query("SELECT content_hash, count(*) AS n FROM rag_chunks WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, content_hash LIMIT 20")
def audit_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Contents that are stored more than once."""
    counts = table(spark, root, "rag_chunks").where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("n"))
    return counts.where("n > 1").orderBy(F.col("n").desc(), "content_hash").limit(20)


@R.query("SELECT id, source_slug, title FROM rag_sources ORDER BY updated_at DESC NULLS LAST, id LIMIT 10")
def audit_recent(spark: SparkSession, root: str) -> DataFrame:
    """The sources touched last."""
    return table(spark, root, "rag_sources").orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(10).select("id", "source_slug", "title")


@R.query("SELECT c.id, s.source_slug, length(c.content) AS n_chars FROM rag_chunks c JOIN rag_sources s ON s.id = c.source_id WHERE length(c.content) < 60")
def short_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of hardly any text."""
    s = table(spark, root, "rag_sources").select(F.col("id").alias("source_id"), "source_slug")
    return table(spark, root, "rag_chunks").where(F.length("content") < 60).join(s, "source_id").select("id", "source_slug", F.length("content").cast("long").alias("n_chars"))


@R.query("SELECT s.id AS source_id, count(c.id) AS n_chunks, coalesce(max(c.chunk_index), -1) AS max_index FROM rag_sources s LEFT JOIN rag_chunks c ON c.source_id = s.id GROUP BY 1")
def source_chunk_counts(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every source, sources without any included."""
    chunks = table(spark, root, "rag_chunks").groupBy("source_id").agg(F.count("id").alias("n_chunks"), F.max("chunk_index").alias("max_index"))
    return table(spark, root, "rag_sources").select(F.col("id").alias("source_id")).join(chunks, "source_id", "left").select("source_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("max_index", F.lit(-1)).alias("max_index"))


@R.query("SELECT source_id, md5(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index, id)) AS digest FROM rag_chunks GROUP BY 1")
def source_text_agg(spark: SparkSession, root: str) -> DataFrame:
    """The text of every source, joined in order (as a digest)."""
    return search.source_texts(table(spark, root, "rag_chunks")).select("source_id", F.md5("text").alias("digest"))


@R.query("SELECT source_id, min_by(metadata['category'], chunk_index) AS category, max(chunk_index) AS last_index FROM rag_chunks GROUP BY 1")
def first_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The metadata of a source's first chunk."""
    return table(spark, root, "rag_chunks").groupBy("source_id").agg(F.min_by(F.col("metadata")["category"], "chunk_index").alias("category"), F.max("chunk_index").alias("last_index"))


@R.query("WITH w AS (SELECT source_id, id, min(created_at) OVER (PARTITION BY source_id) AS a, max(updated_at) OVER (PARTITION BY source_id) AS b, row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id) AS place FROM rag_chunks) SELECT source_id, epoch_us(a) AS created_us, epoch_us(b) AS updated_us FROM w WHERE place = 1")
def split_sources(spark: SparkSession, root: str) -> DataFrame:
    """A flat table of chunks taken apart: its sources with their times."""
    sources, _ = store.split_flat(table(spark, root, "rag_chunks").withColumn("source_slug", F.col("source_id")))
    return sources.select(F.col("id").alias("source_id"), F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


@R.query("SELECT id, sha256(content) AS digest, substr(sha256(source_id || '::' || chunk_index), 1, 16) AS expected_id FROM rag_chunks")
def chunk_ids(spark: SparkSession, root: str) -> DataFrame:
    """Hashes of contents and the ids that chunks should have."""
    return table(spark, root, "rag_chunks").select("id", content_hash(F.col("content")).alias("digest"), chunk_key(F.col("source_id"), F.col("chunk_index")).alias("expected_id"))


_SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+"
_TIDY = f"trim(regexp_replace(content, '{_SPACE}', ' ', 'g'))"


@R.query(f"SELECT id, CASE WHEN {_TIDY} = '' THEN 0 ELSE len(string_split({_TIDY}, ' ')) END AS tokens, CASE WHEN length({_TIDY}) > 100 THEN left({_TIDY}, 100) || '...' ELSE {_TIDY} END AS snippet FROM rag_chunks WHERE content IS NOT NULL")
def token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Tokens and a snippet of every chunk."""
    plain = table(spark, root, "rag_chunks").where("content IS NOT NULL")
    return plain.select("id", token_count(F.col("content")).cast("long").alias("tokens"), snippet(F.col("content"), 100).alias("snippet"))


@R.query("SELECT id, CASE WHEN len(embedding) IS NULL THEN 'no vector' WHEN len(embedding) <> 384 THEN 'wrong dimension' WHEN len(embedding) <> embedding_dim THEN 'declared otherwise' ELSE 'text' END AS fault FROM rag_chunks WHERE len(embedding) IS NULL OR len(embedding) <> 384 OR len(embedding) <> embedding_dim OR length(trim(coalesce(content, ''))) = 0")
def invalid_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that a loader has to refuse, with the first reason."""
    v, n = F.col("embedding"), F.size("embedding")
    chunks = table(spark, root, "rag_chunks").withColumn("fault", scoring.first_case([(v.isNull(), "no vector"), (n != 384, "wrong dimension"), (n != F.col("embedding_dim"), "declared otherwise"), (F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "text")], None))
    return chunks.where("fault IS NOT NULL").select("id", "fault")


@R.query("WITH n AS (SELECT id, title, updated_at, 1 AS rank FROM rag_sources UNION ALL SELECT id, title || ' (2)', updated_at + INTERVAL 1 DAY, 2 FROM rag_sources WHERE status = 'active' UNION ALL SELECT id || '-new', title, updated_at, 3 FROM rag_sources WHERE status = 'deleted') SELECT id, arg_max(coalesce(title, ''), rank) AS title FROM n GROUP BY id")
def upsert_last_wins(spark: SparkSession, root: str) -> DataFrame:
    """Sources after an upsert that changes the active ones, twice in one batch, and adds some."""
    current = table(spark, root, "rag_sources").select("id", F.coalesce("title", F.lit("")).alias("title"), F.lit(0).alias("turn"), "status", F.col("title").isNull().alias("none"))
    changed = current.where("status = 'active'").withColumn("title", F.when(F.col("none"), "").otherwise(F.concat("title", F.lit(" (2)")))).withColumn("turn", F.lit(2))
    early = changed.withColumn("title", F.lit("early")).withColumn("turn", F.lit(1))
    added = current.where("status = 'deleted'").withColumn("id", F.concat("id", F.lit("-new")))
    return store.upsert(current, changed.union(early).union(added), ["id"], ["turn"]).select("id", "title")


@R.query("SELECT c.id FROM rag_chunks c WHERE c.source_id NOT IN (SELECT id FROM rag_sources WHERE status = 'deleted')")
def cascade_delete(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that stay when the sources marked as deleted go."""
    sources = table(spark, root, "rag_sources")
    return store.cascade_delete(sources, table(spark, root, "rag_chunks"), sources.where("status = 'deleted'"), "id", "source_id")[1].select("id")


_PLAN = "WITH t AS (SELECT source_id, max(chunk_index) AS top FROM rag_chunks GROUP BY 1), p AS (SELECT c.id, c.source_id, c.chunk_index, length(c.content) AS n_chars, t.top + 1 AS next_index, c.content FROM rag_chunks c JOIN rag_sources s ON s.id = c.source_id AND s.status = 'active' JOIN t ON t.source_id = c.source_id WHERE length(c.content) > 250)"


@R.query(f"{_PLAN} SELECT id, source_id, n_chars, next_index FROM p")
def oversized_plan(spark: SparkSession, root: str) -> DataFrame:
    """Chunks over a limit with the next free index of their source."""
    plan = store.oversized_plan(table(spark, root, "rag_chunks"), table(spark, root, "rag_sources"), 250)
    return plan.select("id", "source_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("next_index").cast("long").alias("next_index"))


def _rechunked(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from corpusmill.operators.chunking import stride_slices

    chunks = table(spark, root, "rag_chunks")
    plan = store.oversized_plan(chunks, table(spark, root, "rag_sources"), 250)
    cut = chunks.join(plan.select("id"), "id", "left_semi").select("id", F.posexplode(stride_slices(F.col("content"), 150, 50)).alias("piece_no", "content"))
    return chunks, plan, cut


@R.query(f"{_PLAN}, x AS (SELECT p.*, g.g AS piece_no, substr(p.content, 1 + g.g * 100, 150) AS piece FROM p, range(0, 1000) g(g) WHERE g.g * 100 < length(p.content)), n AS (SELECT source_id, piece AS content, next_index - 1 + row_number() OVER (PARTITION BY source_id ORDER BY chunk_index, id, piece_no) AS chunk_index FROM x) SELECT source_id, chunk_index::bigint AS chunk_index, md5(content) AS digest FROM n UNION ALL SELECT source_id, chunk_index::bigint, md5(content) FROM rag_chunks WHERE id NOT IN (SELECT id FROM p)")
def rechunked(spark: SparkSession, root: str) -> DataFrame:
    """The chunks table after the large ones are replaced by their pieces."""
    return store.rechunked(*_rechunked(spark, root)).select("source_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("digest"))


@R.query(f"{_PLAN}, x AS (SELECT p.id, length(substr(p.content, 1 + g.g * 100, 150)) AS n FROM p, range(0, 1000) g(g) WHERE g.g * 100 < length(p.content)) SELECT id, count(*) AS pieces, min(n) AS least, max(n) AS most, (sum(n) // count(*))::bigint AS mean FROM x GROUP BY 1")
def piece_stats(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of the pieces of every large chunk."""
    n = F.length("content").cast("long")
    return _rechunked(spark, root)[2].groupBy("id").agg(F.count("*").alias("pieces"), F.min(n).alias("least"), F.max(n).alias("most"), F.expr("sum(length(content)) div count(*)").alias("mean"))


@R.query("SELECT CASE WHEN count(DISTINCT embedding_model) = 1 THEN regexp_replace(min(embedding_model), '^[^:]*:', '') ELSE 'default' END AS model, count(*) AS n FROM rag_chunks WHERE embedding_model <> 'hash'")
def embedding_model(spark: SparkSession, root: str) -> DataFrame:
    """The one model of the chunks, without its prefix."""
    names = F.collect_set("embedding_model")
    kept = table(spark, root, "rag_chunks").where("embedding_model <> 'hash'")
    return kept.agg(F.when(F.size(names) == 1, F.regexp_replace(F.element_at(names, 1), "^[^:]*:", "")).otherwise("default").alias("model"), F.count("*").alias("n"))


@R.query("SELECT id, 'chunk' AS origin FROM rag_chunks UNION ALL SELECT id, 'source' FROM rag_sources")
def union_all(spark: SparkSession, root: str) -> DataFrame:
    """Two corpora as one."""
    part = lambda name, origin: table(spark, root, name).select("id", F.lit(origin).alias("origin"))
    return part("rag_chunks", "chunk").unionByName(part("rag_sources", "source"))


@R.query("SELECT id, coalesce(nullif(ltrim(lower(trim(coalesce(file_ext, ''))), '.'), ''), CASE WHEN trim(coalesce(url, '')) <> '' THEN 'web' ELSE 'unknown' END) AS kind FROM rag_sources")
def inferred_type(spark: SparkSession, root: str) -> DataFrame:
    """What every source is, by extension, attachment or address."""
    return table(spark, root, "rag_sources").select("id", scoring.SourceType().of(F.col("file_ext"), F.lit(None).cast("string"), F.col("url")).alias("kind"))


_FEATURES = r"""
WITH d AS (SELECT id, lower(trim(regexp_replace(replace(content, chr(160), ' '), '\s+', ' ', 'g'))) AS t FROM rag_chunks),
tok AS (SELECT id, unnest(regexp_extract_all(t, '[0-9a-zA-Z\x{AC00}-\x{D7A3}]+')) AS w FROM d),
f AS (SELECT id, 'tok:' || w AS feature FROM tok UNION ALL SELECT id, 'tri:' || substr(w, i::int, 3) FROM tok, range(1, 200) r(i) WHERE length(w) >= 4 AND i <= length(w) - 2)
"""


@R.query(f"{_FEATURES} SELECT id, count(*) AS n_features, count(DISTINCT feature) AS n_distinct FROM f GROUP BY 1")
def feature_counts(spark: SparkSession, root: str) -> DataFrame:
    """Features of every chunk."""
    counts = features.feature_counts(table(spark, root, "rag_chunks"), "id", "content")
    return counts.groupBy("id").agg(F.sum("n").alias("n_features"), F.count("*").alias("n_distinct"))


@R.query(f"{_FEATURES}, ref AS (SELECT DISTINCT feature FROM f JOIN rag_chunks c USING (id) WHERE c.metadata['category'] = '학사안내'), g AS (SELECT id, feature, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT g.id, sum(n)::bigint AS total, sum(CASE WHEN ref.feature IS NOT NULL THEN n ELSE 0 END)::bigint AS matched FROM g LEFT JOIN ref USING (feature) GROUP BY 1) SELECT c.id, coalesce(total, 0) AS total, coalesce(matched, 0) AS matched, round(coalesce(matched / total, 0.0), 6) AS ratio FROM rag_chunks c LEFT JOIN s USING (id)")
def overlap_ratio(spark: SparkSession, root: str) -> DataFrame:
    """The share of a chunk's features that one category has."""
    chunks = table(spark, root, "rag_chunks")
    reference = features.feature_set(chunks.where(F.col("metadata")["category"] == "학사안내"), "content")
    return features.overlap_ratio(chunks, "id", "content", reference).withColumn("ratio", F.round("ratio", 6))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """Sources with the parts of their scores."""
    s = table(spark, root, "rag_sources")
    day = F.to_date("processed_at")
    return s.select(
        "id", "title", "metadata", F.col("title").alias("content"), day.alias("day"), scoring.recency(day, TODAY).alias("recency"), scoring.recency(day, TODAY, "department").alias("recency_d"), scoring.recency(day, TODAY, "rule").alias("recency_r"),
        scoring.source_quality(F.col("metadata"), F.col("title")).alias("quality"), scoring.document_kind(F.col("title"), F.col("metadata")).alias("kind"),
    )


_DAY = "processed_at::timestamptz AT TIME ZONE 'UTC'"
_AGE = "greatest(date_diff('day', day, DATE '2025-07-01'), 0) / 365.25"
_PARTS = rf"""
WITH b AS (SELECT id, title, metadata, ({_DAY})::date AS day, lower(coalesce(title, '') || chr(10) || coalesce(metadata['doc_title'], '')) AS names FROM rag_sources),
p AS (SELECT *,
  CASE WHEN day IS NULL THEN 0.35 WHEN {_AGE} <= 0.5 THEN 1.0 WHEN {_AGE} <= 1 THEN 0.88 WHEN {_AGE} <= 2 THEN 0.72 WHEN {_AGE} <= 3 THEN 0.55 WHEN {_AGE} <= 5 THEN 0.30 ELSE 0.15 END AS recency,
  CASE WHEN day IS NULL THEN 0.35 WHEN {_AGE} <= 0.5 THEN 1.0 WHEN {_AGE} <= 1 THEN 0.90 WHEN {_AGE} <= 2 THEN 0.75 WHEN {_AGE} <= 3 THEN 0.55 WHEN {_AGE} <= 5 THEN 0.30 ELSE 0.15 END AS recency_d,
  CASE WHEN day IS NULL THEN 0.45 WHEN {_AGE} <= 1 THEN 1.0 WHEN {_AGE} <= 3 THEN 0.8 WHEN {_AGE} <= 7 THEN 0.55 ELSE 0.3 END AS recency_r,
  least(1.0, log10(greatest(length(coalesce(title, '')), 10)) / 4.0) AS len_part,
  0.5 + CASE WHEN trim(coalesce(metadata['doc_title'], '')) <> '' THEN 0.25 ELSE 0 END AS name_part,
  CASE WHEN regexp_matches(names, '별표\s*(?:제)?\s*\d+') THEN 'appendix_table' WHEN regexp_matches(names, '서식|양식|신청서|별지\s*(?:제)?\s*\d+') THEN 'form' ELSE 'post' END AS kind
  FROM b),
k AS (SELECT *, least(1.0, 0.65 * len_part + 0.35 * name_part) AS quality, CASE kind WHEN 'form' THEN -0.12 WHEN 'appendix_table' THEN -0.06 ELSE 0.0 END AS adj,
  CASE WHEN regexp_matches(names, '학부안내|학사안내|학부소개|전공소개|대학원소개|졸업요건|교육과정') THEN 1.0 WHEN regexp_matches(names, '공지사항|학과공지|대학원공지|취업|채용') THEN 0.45 ELSE 0.65 END AS page FROM p)
"""


@R.query(f"{_PARTS} SELECT id, kind, recency::double AS recency, round(quality, 6) AS quality, page::double AS page FROM k")
def score_parts(spark: SparkSession, root: str) -> DataFrame:
    """Kind, recency, quality and page role of every source."""
    page = scoring.page_role(F.col("title"), F.col("metadata"))["score"].cast("double")
    return _scored(spark, root).select("id", "kind", F.col("recency").cast("double").alias("recency"), F.round("quality", 6).alias("quality"), page.alias("page"))


@R.query(f"{_PARTS} SELECT id, round(greatest(0.0, least(1.0, 0.35 + 0.24 * greatest(0.0, least(1.0, 0.45 * 0.5 + 0.35 * recency + 0.20 * quality + adj)))), 6) AS score FROM k")
def main_score(spark: SparkSession, root: str) -> DataFrame:
    """The score of notices at a fixed overlap of one half."""
    s = _scored(spark, root)
    return s.select("id", F.round(scoring.main_score("notice", F.lit(0.5), F.col("recency"), F.col("quality"), scoring.kind_adjustment(F.col("kind"))), 6).alias("score"))


@R.query(f"{_PARTS} SELECT id, round(greatest(0.0, least(1.0, 0.38 * 0.5 + 0.27 * recency_d + 0.30 * page + 0.05 * least(1.0, 0.5 + 0.25) + adj)), 6) AS score FROM k")
def department_score(spark: SparkSession, root: str) -> DataFrame:
    """The score of a department's pages at fixed overlaps."""
    s = _scored(spark, root)
    page = scoring.page_role(F.col("title"), F.col("metadata"))["score"]
    return s.select("id", F.round(scoring.department_score(F.lit(10), F.lit(0.5), F.lit(0.25), F.col("recency_d"), page, scoring.kind_adjustment(F.col("kind"))), 6).alias("score"))


@R.query(f"{_PARTS} SELECT id, round(greatest(0.0, least(1.0, 0.35 + 0.149 * (0.50 * recency_r + 0.35 * 0.35 + 0.15 * least(1.0, 0.45 * len_part + 0.35 * CASE WHEN lower(metadata['source_ext']) IN ('.hwp', '.hwpx', '.pdf', '.docx', '.doc') THEN 0.95 ELSE 0.75 END + 0.20 * name_part)) + CASE WHEN regexp_matches(names, '별표\\s*(?:제)?\\s*\\d+') THEN -0.035 WHEN regexp_matches(names, '별지\\s*(?:제)?\\s*\\d+|서식\\s*(?:제)?\\s*\\d+') THEN -0.07 ELSE 0.0 END)), 6) AS score FROM k")
def rule_score(spark: SparkSession, root: str) -> DataFrame:
    """The score of rules of unknown authority that stand in no tree."""
    s, title, metadata = _scored(spark, root), F.col("title"), F.col("metadata")
    authority = scoring.authority(metadata, F.lit(""))
    tree = scoring.tree_score(authority, F.lit(False), F.lit(None).cast("string"))
    kind = scoring.document_kind(title, metadata, rules=True)
    return s.select("id", F.round(scoring.rule_score(authority, F.col("recency_r"), tree, scoring.rule_quality(metadata, title), scoring.kind_adjustment(kind, rules=True)), 6).alias("score"))


@R.query(f"{_PARTS} SELECT s.id, s.source_slug, round(greatest(0.0, least(1.0, 0.35 + 0.24 * greatest(0.0, least(1.0, 0.45 * 0.5 + 0.35 * recency + 0.20 * quality + adj)))), 6) AS priority_score FROM k JOIN rag_sources s USING (id)")
def written_back(spark: SparkSession, root: str) -> DataFrame:
    """Sources with their scores written back by id."""
    sources = table(spark, root, "rag_sources").select("id", "source_slug", F.lit(0.0).alias("priority_score"))
    scores = main_score(spark, root).select("id", F.col("score").alias("priority_score"))
    return store.written_back(sources, scores, "id", ["priority_score"])


@R.query()
def hashed_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The hashing embedding of every chunk."""
    return features.with_hashed_vector(table(spark, root, "rag_chunks").select("id", "content"), "content", 384, "vector").select("id", "vector")


_OVERLAPS = f"""{_FEATURES},
rules AS (SELECT DISTINCT feature FROM f JOIN rag_chunks c USING (id) WHERE c.metadata['category'] = '학사안내'),
main AS (SELECT DISTINCT feature FROM f JOIN rag_chunks c USING (id) WHERE c.metadata['category'] = '비교과'),
g AS (SELECT c.source_id AS id, feature, count(*) AS n FROM f JOIN rag_chunks c USING (id) GROUP BY ALL),
o AS (SELECT g.id, sum(n) AS total, sum(CASE WHEN rules.feature IS NOT NULL THEN n ELSE 0 END) / sum(n) AS by_rules, sum(CASE WHEN main.feature IS NOT NULL THEN n ELSE 0 END) / sum(n) AS by_main FROM g LEFT JOIN rules USING (feature) LEFT JOIN main USING (feature) GROUP BY 1),
{_PARTS.strip().removeprefix('WITH ')}
"""


def _overlaps(spark: SparkSession, root: str) -> DataFrame:
    """The sources with the shares of their chunks' features that two categories have."""
    chunks = table(spark, root, "rag_chunks")
    parts = _scored(spark, root)
    for name, category in (("by_rules", "학사안내"), ("by_main", "비교과")):
        reference = features.feature_set(chunks.where(F.col("metadata")["category"] == category), "content")
        found = features.overlap_ratio(chunks, "source_id", "content", reference).select(F.col("source_id").alias("id"), F.col("ratio").alias(name), F.col("total").alias(f"{name}_total"))
        parts = parts.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return parts.withColumn("total", F.coalesce("by_rules_total", F.lit(0)))


@R.query(f"{_OVERLAPS} SELECT id, round(greatest(0.0, least(1.0, 0.35 + 0.24 * greatest(0.0, least(1.0, 0.45 * coalesce(by_rules, 0.0) + 0.35 * recency::DOUBLE + 0.20 * quality + adj)))), 6) AS score FROM k LEFT JOIN o USING (id)")
def main_score_by_overlap(spark: SparkSession, root: str) -> DataFrame:
    """The score of notices with the overlap of their own chunks."""
    s = _overlaps(spark, root)
    return s.select("id", F.round(scoring.main_score("notice", F.col("by_rules"), F.col("recency"), F.col("quality"), scoring.kind_adjustment(F.col("kind"))), 6).alias("score"))


@R.query(f"{_OVERLAPS} SELECT id, CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.38 * greatest(by_rules, by_main) + 0.27 * recency_d::DOUBLE + 0.30 * page + 0.05 * least(1.0, by_rules + by_main) + adj)), 6) END AS score FROM k LEFT JOIN o USING (id)")
def department_score_by_overlap(spark: SparkSession, root: str) -> DataFrame:
    """The score of a department's pages with the overlaps of their own chunks."""
    s = _overlaps(spark, root)
    page = scoring.page_role(F.col("title"), F.col("metadata"))["score"]
    return s.select("id", F.round(scoring.department_score(F.col("total"), F.col("by_rules"), F.col("by_main"), F.col("recency_d"), page, scoring.kind_adjustment(F.col("kind"))), 6).alias("score"))


_RANK = "CASE WHEN metadata['category'] = '학사안내' THEN 'hak' WHEN metadata['category'] = '채용' THEN 'gyu' WHEN metadata['category'] = '비교과' THEN 'se' ELSE '' END"
_HEIGHT = "length(title) % 5"


@R.query(f"""{_PARTS}, t AS (SELECT k.*, {_RANK} AS tree_kind, {_HEIGHT} AS depth FROM k),
u AS (SELECT *, CASE tree_kind WHEN 'hak' THEN 0.90 WHEN 'gyu' THEN 0.70 WHEN 'se' THEN 0.50 ELSE 0.35 END AS base, CASE tree_kind WHEN 'hak' THEN 0.099 WHEN 'gyu' THEN 0.199 WHEN 'se' THEN 0.199 ELSE 0.149 END AS span,
  CASE WHEN tree_kind = '' THEN 0.35 WHEN tree_kind = 'hak' AND coalesce(depth, 3) <= 1 THEN 1.0 WHEN tree_kind = 'hak' THEN 0.90 WHEN tree_kind = 'gyu' AND coalesce(depth, 3) <= 2 THEN 1.0 WHEN tree_kind = 'gyu' AND coalesce(depth, 3) = 3 THEN 0.80 WHEN tree_kind = 'gyu' THEN 0.65
    WHEN coalesce(depth, 3) <= 2 THEN 0.85 WHEN coalesce(depth, 3) = 3 THEN 0.70 ELSE 0.55 END AS tree FROM t)
SELECT id, round(greatest(0.0, least(1.0, base + span * (0.50 * recency_r + 0.35 * tree + 0.15 * least(1.0, 0.45 * len_part + 0.35 * CASE WHEN lower(metadata['source_ext']) IN ('.hwp', '.hwpx', '.pdf', '.docx', '.doc') THEN 0.95 ELSE 0.75 END + 0.20 * name_part)) + CASE WHEN regexp_matches(names, '별표\\s*(?:제)?\\s*\\d+') THEN -0.035 WHEN regexp_matches(names, '별지\\s*(?:제)?\\s*\\d+|서식\\s*(?:제)?\\s*\\d+') THEN -0.07 ELSE 0.0 END))::DOUBLE, 6) AS score FROM u""")
def rule_score_by_tree(spark: SparkSession, root: str) -> DataFrame:
    """The score of rules whose authority and depth a tree gives; the others stand in no tree."""
    s, metadata = _scored(spark, root), F.col("metadata")
    category = F.coalesce(metadata["category"], F.lit(""))
    tree_kind = F.when(category == "학사안내", "hak").when(category == "채용", "gyu").when(category == "비교과", "se").otherwise("")
    authority = scoring.authority(metadata, tree_kind)
    tree = scoring.tree_score(authority, tree_kind != "", (F.length("title") % 5).cast("string"))
    kind = scoring.document_kind(F.col("title"), metadata, rules=True)
    return s.select("id", F.round(scoring.rule_score(authority, F.col("recency_r"), tree, scoring.rule_quality(metadata, F.col("title")), scoring.kind_adjustment(kind, rules=True)), 6).alias("score"))


QUERIES, ORACLES = R.queries, R.oracles
