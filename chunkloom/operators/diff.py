"""Differences of two archives by path, in one aggregation over both."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import chunk_fingerprint, distinct_archives, plain_path
from chunkloom.operators.catalog import under
from chunkloom.operators.ranking import numbered
from chunkloom.session import small_side

#: Columns whose change makes a path modified: of the command line, and of the catalog.
FULL = ("item_type", "size", "mtime", "chunks", "mode")
CATALOG = ("size", "mtime", "mode", "chunks")


def archive_pairs(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(repo_path, before_name, after_name): the oldest and the newest archive with items of each repository that has two."""
    held = distinct_archives(archives).join(items.select("archive_name").distinct(), "archive_name", "left_semi")
    ends = held.groupBy("repo_path").agg(F.min(F.struct("archive_time", "archive_name")).alias("a"), F.max(F.struct("archive_time", "archive_name")).alias("b"))
    return ends.select("repo_path", F.col("a.archive_name").alias("before_name"), F.col("b.archive_name").alias("after_name")).where(F.col("before_name") != F.col("after_name"))


def successive_pairs(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(repo_path, before_name, after_name): each archive with items and the one before it in its repository, by time and name."""
    held = distinct_archives(archives).join(items.select("archive_name").distinct(), "archive_name", "left_semi")
    before = F.lag("archive_name").over(Window.partitionBy("repo_path").orderBy("archive_time", "archive_name"))
    return held.select("repo_path", before.alias("before_name"), F.col("archive_name").alias("after_name")).where(F.col("before_name").isNotNull())


def entries(items: DataFrame, pairs: DataFrame, columns: tuple[str, ...] = FULL, roots: tuple[str, ...] = (), *, by_pair: bool = False) -> DataFrame:
    """(repo_path, path, status, size_before, size_after, mtime_before, mtime_after) per path of each pair, with ``after_name`` if ``by_pair``.

    ``status`` is added, removed, modified or unchanged. Nulls equal nulls. Of a path listed twice in an
    archive the last row holds. Chunk lists are compared by a 64-bit hash: one pair in 2^64 would be missed.
    Only items of the archives in pairs are read on, once for each pair, and both sides meet in
    one aggregation by path, which is combined map side: no join of trees.
    """
    sides = pairs.select(F.col("before_name").alias("archive_name"), "repo_path", "after_name", F.lit(False).alias("is_after"))
    sides = sides.unionByName(pairs.select(F.col("after_name").alias("archive_name"), "repo_path", "after_name", F.lit(True).alias("is_after")))
    row = F.struct("item_id", "item_type", "size", F.col("attrs.mtime").alias("mtime"), F.col("attrs.mode").alias("mode"), chunk_fingerprint("chunks").alias("chunks"))
    held = items.where(F.col("path").isNotNull()).select("archive_name", plain_path("path").alias("path"), row.alias("v"))
    if roots:
        held = held.where(under("path", *roots))
    met = held.join(small_side(sides), "archive_name")
    key = ["repo_path", "after_name"] if by_pair else ["repo_path"]
    both = met.groupBy(*key, "path").agg(F.max(F.when(~F.col("is_after"), F.col("v"))).alias("a"), F.max(F.when(F.col("is_after"), F.col("v"))).alias("b"))
    changed = reduce(or_, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    return both.select(*key, "path", status.alias("status"), F.col("a.size").alias("size_before"), F.col("b.size").alias("size_after"), F.col("a.mtime").alias("mtime_before"), F.col("b.mtime").alias("mtime_after"))


def summary(found: DataFrame) -> DataFrame:
    """Per repository, and pair if there is one: counts by status, and bytes added, removed, changed by and net."""

    def total(status: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, value)), F.lit(0)).alias(f"{status}_bytes")

    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("added", "removed", "modified", "unchanged")]
    out = found.groupBy("repo_path", *(c for c in ("after_name",) if c in found.columns)).agg(*counts, F.count(F.lit(1)).alias("n_paths"), total("added", F.col("size_after")), total("removed", F.col("size_before")), total("modified", F.col("size_after") - F.col("size_before")))
    return out.withColumn("net_bytes", F.col("added_bytes") - F.col("removed_bytes") + F.col("modified_bytes"))


def ranked(found: DataFrame, by: str = "size") -> DataFrame:
    """Changes with ``n_in_status``: largest or latest first within added, removed and modified; ties by path."""
    before, after = F.col(f"{'size' if by == 'size' else 'mtime'}_before"), F.col(f"{'size' if by == 'size' else 'mtime'}_after")
    modified = F.abs(after - before) if by == "size" else after
    key = F.when(F.col("status") == "added", after).when(F.col("status") == "removed", before).otherwise(modified)
    changes = found.where(F.col("status") != "unchanged").withColumn("_key", key)
    ranked_rows = numbered(changes, ["repo_path", "status"], [("_key", True), ("path", False)], "n_in_status")
    return ranked_rows.withColumn("n_in_status", F.col("n_in_status").cast("int")).drop("_key")
