"""Records of chunks with the metadata of their document, and rows for the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.ids import content_hash
from corpusmill.functions.text import token_count, without_nul
from corpusmill.operators import scoring

# What every record says of its document; the first from the document, the others from its provenance.
FROM_DOCUMENT = ("source_slug", "source_file", "source_path", "source_relative_to_input", "source_ext", "preprocessed_path")
FROM_PROVENANCE = (
    "doc_title", "doc_url", "category", "subcategory", "doc_type", "source_kind", "date", "is_notice", "crawled_at", "attachment_name", "attachment_url", "attachment_kind", "document_kind", "is_form",
    "is_appendix_table", "form_number", "appendix_number", "notice_topic", "source_page_url", "source_site", "source_json_path", "source_html_path", "source_attachment_path",
)
FLAGS = ("is_notice", "is_form", "is_appendix_table")


def base_metadata(document: dict[str, Column], provenance: Column) -> Column:
    """The metadata that every chunk of a document carries: '' for what is missing, ``false`` for flags.

    ``document`` has the columns of :data:`FROM_DOCUMENT`, and may have ``source_kind``, which goes
    before that of the provenance.
    """
    said = lambda key: F.try_element_at(provenance, F.lit(key))
    values = [(k, F.coalesce(document.get(k, F.lit(None)), F.lit(""))) for k in FROM_DOCUMENT]
    for key in FROM_PROVENANCE:
        first = [document[key]] if key == "source_kind" and key in document else []
        values.append((key, F.coalesce(*first, said(key), F.lit("false" if key in FLAGS else ""))))
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in values]), F.array(*[v for _, v in values]))


def enriched(provenance: Column, is_attachment: Column, names: list[Column], dataset: str) -> Column:
    """The provenance of a document with its kind.

    Attachments are classed by their names (:func:`corpusmill.operators.scoring.attachment_kind`), which replaces what was
    said before; posts keep what they say and get defaults.  Notices get a topic where one is found.
    """
    found = scoring.attachment_kind(*names)
    kind = found["kind"]
    said = [("document_kind", kind), ("attachment_kind", kind), ("is_form", (kind == "form").cast("string")), ("is_appendix_table", (kind == "appendix_table").cast("string")), ("form_number", F.when(kind == "form", found["number"])), ("appendix_number", F.when(kind == "appendix_table", found["number"]))]
    of_file = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in said]), F.array(*[v for _, v in said])), lambda k, v: v.isNotNull())
    of_post = F.map_from_arrays(F.array(*[F.lit(k) for k in ("document_kind", "attachment_kind", "is_form", "is_appendix_table")]), F.array(*[F.lit(v) for v in ("post", "", "false", "false")]))
    before = F.coalesce(provenance, F.create_map().cast("map<string,string>"))
    over = lambda below, above: F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)
    out = F.when(is_attachment, over(before, of_file)).otherwise(over(of_post, before))
    if dataset != "notice":
        return out
    topic = scoring.notice_topic(before)
    return F.when(topic != "", over(out, F.create_map(F.lit("notice_topic"), topic))).otherwise(out)


def store_rows(records: DataFrame, embedding_model: str, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """(rows for the sources, rows for the chunks) of records (id, source_slug, chunk_id, chunk_index, text, metadata, embedding).

    What is '' becomes null; a title falls back on the file's name, an address on the attachment's.
    The rows of a source are as many as its records: :func:`store.upsert` with an order picks one.
    """
    said = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit("")) for k in keys])
    sources = records.select(
        F.col("source_slug").alias("id"), "source_slug", scoring.SourceType().of(said("source_ext"), said("attachment_url"), said("doc_url")).alias("source_type"), said("doc_title", "source_file").alias("title"), said("doc_url", "attachment_url").alias("url"),
        said("source_page_url").alias("parent_url"), said("source_path").alias("file_path"), said("source_ext").alias("file_ext"), said("category").alias("category"), said("subcategory").alias("subcategory"), "metadata",
    )
    text = without_nul(F.col("text"))
    chunks = records.select(
        F.col("id").cast("string").alias("id"), F.col("source_slug").alias("source_id"), F.col("chunk_id").cast("int").alias("chunk_id"), F.col("chunk_index").cast("int").alias("chunk_index"), text.alias("content"),
        content_hash(text).alias("content_hash"), token_count(text).alias("token_count"), "metadata", "embedding", F.lit(embedding_model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"),
    )
    return sources, chunks


def clean_of_nul(rows: DataFrame) -> DataFrame:
    """``rows`` without NUL characters in any string, at any depth: in lists, structs, and keys and values of maps.

    Of two keys of a map that become one the last stays.
    """

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return without_nul(value)
        if isinstance(kind, T.ArrayType) and _has_strings(kind):
            return F.transform(value, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType) and _has_strings(kind):
            entries = F.transform(F.map_entries(value), lambda e: F.struct(clean(e["key"], kind.keyType).alias("key"), clean(e["value"], kind.valueType).alias("value")))
            last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
            return F.map_from_entries(last)
        if isinstance(kind, T.StructType) and _has_strings(kind):
            return F.when(value.isNotNull(), F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return rows.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_strings(kind.keyType) or _has_strings(kind.valueType)
    return isinstance(kind, T.StringType)
