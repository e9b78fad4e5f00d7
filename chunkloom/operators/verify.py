"""Integrity: missing chunks, reports, reachability and what a sweep would remove."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.model import plain_id, plain_ids, usable_id


def stored_ids(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk_id) present: with a row that is not deleted, in plain form."""
    live = store.where(F.col("deleted_at").isNull()).select("chunk_id").unionByName(seeds.select("chunk_id"))
    return live.select(plain_id("chunk_id").alias("chunk_id")).where(usable_id("chunk_id")).distinct()


def missing_chunks(items: DataFrame, present: DataFrame) -> DataFrame:
    """(archive_name, item_id, chunk_id) of references to chunks that are not present."""
    refs = items.select("archive_name", "item_id", F.explode("chunks").alias("raw")).select("archive_name", "item_id", plain_id("raw").alias("chunk_id"))
    return refs.where(F.col("chunk_id").isNotNull()).join(present, "chunk_id", "left_anti").select("archive_name", "item_id", "chunk_id").distinct()


def archive_report(items: DataFrame, missing: DataFrame) -> DataFrame:
    """Per archive: items, items with a missing chunk, distinct missing chunks, and whether all is there."""
    bad = missing.groupBy("archive_name").agg(F.countDistinct("item_id").alias("n_invalid"), F.countDistinct("chunk_id").alias("n_missing"))
    n = items.groupBy("archive_name").agg(F.count(F.lit(1)).alias("n_items")).join(bad, "archive_name", "left").fillna(0, ["n_invalid", "n_missing"])
    return n.withColumn("is_ok", F.col("n_invalid") == 0)


def report_metrics(reports: DataFrame) -> DataFrame:
    """Per report: count of errors, success rate in percent (100 if nothing was checked), bytes per second (0 without time), and the bad ids.

    Each element of the two lists that is an id is an error, also if it is repeated; ``corrupted`` and
    ``missing`` list each id once, in order, joined by commas.
    """
    own = reports.dropDuplicates(["report_id"])
    ids = [plain_ids(c) for c in ("corrupted_chunks", "missing_chunks")]
    n = [F.size(c) for c in ids]
    rate = F.when(F.col("total_chunks") > 0, F.col("verified_chunks") / F.col("total_chunks") * 100).otherwise(100.0)
    speed = F.when(F.col("duration_s") > 0, F.col("bytes_verified") / F.col("duration_s")).otherwise(0.0)
    return own.select("report_id", "repo_path", (n[0] + n[1]).cast("bigint").alias("error_count"), rate.alias("success_rate"), speed.alias("throughput"), *(F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(k) for c, k in zip(ids, ("corrupted", "missing"), strict=True)))


def integrity(archive_reports: DataFrame) -> DataFrame:
    """One row: whether all archives are whole, errors in total, archives with errors."""
    return archive_reports.agg(F.coalesce(F.bool_and("is_ok"), F.lit(True)).alias("is_ok"), F.coalesce(F.sum("n_invalid"), F.lit(0)).alias("total_errors"), F.count_if(~F.col("is_ok")).alias("archives_with_errors"))


def corrupted(chunks: DataFrame) -> DataFrame:
    """(chunk_id) of (chunk_id, data) whose payload does not hash to the id; a null payload is corrupt."""
    return chunks.where(~F.coalesce(F.sha2("data", 256) == F.col("chunk_id"), F.lit(False))).select("chunk_id")


def reachable_ids(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(chunk_id) that a committed archive or one of its items refers to."""
    roots = archives.select(plain_id("id").alias("chunk_id"))
    held = items.join(archives.select("archive_name").distinct(), "archive_name", "left_semi").select(F.explode("chunks").alias("raw")).select(plain_id("raw").alias("chunk_id"))
    return roots.unionByName(held).where(usable_id("chunk_id")).distinct()


def sweep(present: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks to remove, and chunks that stay."""
    return present.join(reachable, "chunk_id", "left_anti"), present.join(reachable, "chunk_id", "left_semi")


def folder_edges(items: DataFrame) -> DataFrame:
    """(archive_name, parent, child) of the folder tree that the items' plain paths imply; the root is ''."""
    from chunkloom.model import plain_path

    parts = F.split(plain_path("path"), "/", -1)
    deep = items.where(F.col("path").isNotNull()).select("archive_name", parts.alias("parts")).where(F.size("parts") > 0)
    steps = deep.select("archive_name", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    path = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")
    parent = F.when(F.col("n") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "/")).otherwise("")
    return steps.select("archive_name", parent.alias("parent"), path.alias("child")).distinct()


def reachable_nodes(edges: DataFrame) -> DataFrame:
    """(archive_name, node, depth) reachable from the root of each archive, breadth first.

    A node is visited once, at its least depth; ends when a round finds nothing new. Each round
    joins the frontier to the edges, so the work follows the depth and not the size.
    """
    from chunkloom.session import cut

    edges = cut(edges)
    seen = frontier = cut(edges.select("archive_name").distinct().select("archive_name", F.lit("").alias("node"), F.lit(0).alias("depth")))
    for depth in count(1):
        step = frontier.select("archive_name", F.col("node").alias("parent")).join(edges, ["archive_name", "parent"]).select("archive_name", F.col("child").alias("node")).distinct()
        frontier = cut(step.join(seen, ["archive_name", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
