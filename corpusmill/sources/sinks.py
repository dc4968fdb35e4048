"""Writers: laid out documents, an index of records, manifests, backups, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def output_path(relative: Column, layout: str = "by_ext") -> Column:
    """Where the result of a file goes: beside the others as ``.json``, by default in a folder of its kind."""
    bare = F.regexp_replace(relative, r"(?<=[^/])\.[^./]*$", "")
    if layout == "flat":
        return F.concat(bare, F.lit(".json"))
    if layout == "by_ext":
        kind = F.lower(F.regexp_extract(relative, r"[^/]\.([^./]+)$", 1))
        return F.concat(F.when(kind == "", "unknown").otherwise(kind), F.lit("/"), bare, F.lit(".json"))
    raise ValueError(f"unsupported layout: {layout}")


def project_path(path: Column, root: str) -> Column:
    """A path relative to ``root``, with forward slashes; one outside of it as it is."""
    posix, base = F.replace(path, F.lit("\\"), F.lit("/")), root.rstrip("/") + "/"
    return F.when(posix.startswith(base), F.substr(posix, F.lit(len(base) + 1))).otherwise(posix)


def write_documents(documents: DataFrame, path: str, dataset: str, layout: str = "by_ext", files: int | None = None) -> None:
    """Preprocessed documents as JSON lines, by dataset and, in the layout ``by_ext``, by kind of file.

    Each folder is written by every task that has rows of it; ``files`` bounds the number of tasks.
    Writing a dataset again replaces its folders and no others.
    """
    kind = F.lower(F.regexp_replace(F.coalesce("source_ext", F.lit("")), r"^\.", ""))
    rows = documents.withColumn("dataset", F.lit(dataset)).withColumn("ext", F.when(kind == "", "unknown").otherwise(kind))
    rows = rows.coalesce(files) if files else rows
    folders = ["dataset", "ext"] if layout == "by_ext" else ["dataset"]
    if layout not in ("by_ext", "flat"):
        raise ValueError(f"unsupported layout: {layout}")
    rows.drop(*({"ext"} - set(folders))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).json(path)


def write_index(records: DataFrame, path: str) -> None:
    """Vector records: one folder for each source and all of them as one index of JSON lines, from one computation."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    kept = records.sparkSession.read.parquet(f"{path}/records")
    kept.write.mode("overwrite").json(f"{path}/index")


def manifest(results: DataFrame, most_listed: int = 1000) -> DataFrame:
    """One row: how many files went well, were skipped and failed, their chunks, and lists of the skipped and the failed.

    ``results`` has (path, status, reason, num_chunks) with the status ok, skipped or failed.  The lists
    hold the first ``most_listed`` by path, for a manifest is read by people; the counts are of all.
    """
    count = lambda status: F.count(F.when(F.col("status") == status, 1))
    totals = results.agg(F.count("*").alias("num_files"), count("ok").alias("num_ok"), count("skipped").alias("num_skipped"), count("failed").alias("num_failed"), F.coalesce(F.sum("num_chunks"), F.lit(0)).cast("long").alias("num_chunks"))
    for status, name in (("skipped", "skipped_files"), ("failed", "failures")):
        first = results.where(F.col("status") == status).orderBy("path", "reason").limit(most_listed)
        listed = first.agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias(name))
        totals = totals.join(F.broadcast(listed))
    return totals


def backup(rows: DataFrame, folder: str, dataset: str, stamp: str) -> str:
    """The rows that are about to be changed, as JSON lines in a folder of their own; never overwrites.  Returns the path."""
    path = f"{folder.rstrip('/')}/{dataset}_oversized_{stamp}"
    rows.write.mode("errorifexists").json(path)
    return path


def missing_columns(spark: SparkSession, tables: dict[str, list[str]]) -> dict[str, list[str]]:
    """What is missing of the tables of the catalog and their columns, by table; an empty result means ready.

    A table that is not there has the entry ``*``.
    """
    missing: dict[str, list[str]] = {}
    for name, columns in tables.items():
        if not spark.catalog.tableExists(name):
            missing[name] = ["*"]
        elif lost := [c for c in columns if c.lower() not in {f.lower() for f in spark.table(name).columns}]:
            missing[name] = lost
    return missing


def ensure_ready(spark: SparkSession, tables: dict[str, list[str]]) -> None:
    """Raises an error that names what is missing."""
    if missing := missing_columns(spark, tables):
        raise RuntimeError("the store is not ready: " + "; ".join(f"{t} lacks {', '.join(c)}" for t, c in sorted(missing.items())))


def saved_posts(current: DataFrame, seen: DataFrame, gone: DataFrame, key: str = "slug", now: Column | None = None) -> DataFrame:
    """The store of posts after a run: seen ones replaced or added, ``gone`` ones kept as deleted without their page.

    Posts have (key, html, status, deleted_at, ...).  A post that is seen again comes back to life;
    one in ``gone`` that is seen as well is not deleted.
    """
    fresh = seen.withColumn("status", F.lit("active")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    rest = current.join(seen.select(key), key, "left_anti").join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    dead = F.col("_gone") & (F.col("status") != "deleted")
    stamped = {"status": F.when(dead, "deleted").otherwise(F.col("status")), "deleted_at": F.when(dead, F.current_timestamp() if now is None else now).otherwise(F.col("deleted_at")), "html": F.when(~dead | dead.isNull(), F.col("html"))}
    moved = rest.select(*[stamped.get(c, F.col(c)).alias(c) for c in current.columns])
    return moved.unionByName(fresh.select(*current.columns))


def write_tree(payloads: DataFrame, tree: DataFrame, path: str, fetched_at: str, source_url: str) -> None:
    """The tree of rules as it came and normalised, with its totals, each as JSON lines."""
    stamped = lambda rows: rows.withColumn("fetched_at", F.lit(fetched_at)).withColumn("source_url", F.lit(source_url))
    stamped(payloads).write.mode("overwrite").json(f"{path}/raw")
    stamped(tree).write.mode("overwrite").json(f"{path}/nodes")
    totals = tree.agg(F.count("*").alias("num_nodes"), F.count(F.when(F.col("is_target"), 1)).alias("num_targets"))
    stamped(totals).write.mode("overwrite").json(f"{path}/totals")
