"""Rule data: the tree of rules, previews of bylaws, and their joins."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import one_blank
from corpusmill.operators.tree import tree_paths
from corpusmill.sources.extract import parsed, tidy

# The kinds of node that are rules to be fetched.
TARGET_KINDS = ("hak", "gyu")
NODE = "id string, parent_id string, title string, kind_type string, lid string, issue string, effective string, law_path string"


def _nodes(payload: str | None) -> list[dict]:
    """The nodes of a tree payload; the tree may be JSON in a string in JSON, with entities."""
    try:
        data = json.loads(payload) if payload else {}
        wrapped = data.get("datas")
        tree = wrapped.get("treeData", data) if isinstance(wrapped, dict) else data
        tree = json.loads(html.unescape(tree)) if isinstance(tree, str) else tree
        nodes = tree.get("mixedNodes", tree.get("ruleTree")) or []
    except (ValueError, AttributeError):
        return []
    found = []
    for node in nodes if isinstance(nodes, list) else []:
        if isinstance(node, dict) and node.get("id"):
            own = node.get("data") or {}
            said = lambda key, other="": str(own.get(key) or other or "")  # noqa: E731,B023
            found.append({"id": str(node["id"]), "parent_id": str(node.get("parent") or "") or None, "title": tidy(said("name", node.get("text"))), "kind_type": said("kindType", node.get("type")), "lid": said("lid"), "issue": said("issue"), "effective": said("eff"), "law_path": html.unescape(said("url"))})
    return found


def tree_nodes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each node of the trees in ``column``; null and malformed payloads have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in NODE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([n for payload in batch[column] for n in _nodes(payload)], columns=names)

    return payloads.select(column).mapInPandas(run, NODE)


def rule_tree(nodes: DataFrame) -> DataFrame:
    """The nodes with their depth, the ids, rule numbers and titles of their path, and what their parent is."""
    paths = tree_paths(nodes.select("id", "parent_id")).select("id", "depth", "path_ids")
    steps = paths.select("id", F.posexplode("path_ids").alias("place", "step")).join(nodes.select(F.col("id").alias("step"), "title", "lid"), "step")
    along = F.array_sort(F.collect_list(F.struct("place", "title", "lid")))
    some = lambda field: F.filter(F.transform("along", lambda s: s[field]), lambda x: x != "")
    said = steps.groupBy("id").agg(along.alias("along")).select("id", some("lid").alias("path_lids"), some("title").alias("path_titles"))
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("lid").alias("parent_lid"), F.col("title").alias("parent_title"))
    return nodes.join(paths, "id", "left").join(said, "id", "left").join(parents, "parent_id", "left").withColumn("is_target", F.col("kind_type").isin(*TARGET_KINDS))


def tree_totals(nodes: DataFrame) -> DataFrame:
    """``(num_nodes, num_targets)``."""
    return nodes.agg(F.count("*").alias("num_nodes"), F.count(F.when(F.col("kind_type").isin(*TARGET_KINDS), 1)).alias("num_targets"))


def bylaw_previews(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``(board_seq, title, content, content_html, opened_at, point_text)`` of every preview row with a sequence number.

    Of rows with the same number the last counts; malformed payloads have none.
    """
    row = "array<struct<boardSeq: string, title: string, cont: string, opnAt: string, pointText: string>>"
    rows = payloads.select(F.posexplode(F.from_json(column, f"datas {row}")["datas"]).alias("place", "r")).select("place", "r.*").withColumn("board_seq", F.trim("boardSeq")).where("board_seq != ''")
    last = rows.groupBy("board_seq").agg(F.max_by(F.struct("title", "cont", "opnAt", "pointText"), "place").alias("r")).select("board_seq", "r.*")

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: parsed(h).text())

    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    return last.select("board_seq", one_blank(plain("title")).alias("title"), text(plain("cont")).alias("content"), plain("cont").alias("content_html"), plain("opnAt").alias("opened_at"), one_blank(plain("pointText")).alias("point_text"))


def with_previews(items: DataFrame, previews: DataFrame, key: str = "board_seq") -> DataFrame:
    """Bylaws with their preview where there is one."""
    return items.join(previews.select(F.col("board_seq").alias(key), F.struct("title", "content", "opened_at", "point_text").alias("preview")), key, "left")


def with_documents(pages: DataFrame, documents: DataFrame, keys: tuple[str, str] = ("category", "slug")) -> DataFrame:
    """Rule pages with the document of the same category and slug, as ``document``; of several the last by ``crawled_at``."""
    others = [c for c in documents.columns if c not in keys]
    kept = documents.groupBy(*keys).agg(F.max_by(F.struct(*others), F.coalesce(F.col("crawled_at").cast("string"), F.lit(""))).alias("document"))
    return pages.join(kept, list(keys), "left")
