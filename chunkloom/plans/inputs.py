"""Inputs of the catalog queries: whole tables without second deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.model import plain_path, table
from chunkloom.operators.catalog import distinct_items
from chunkloom.operators.snapshot_changes import snapshots

#: The same inputs for SQL.
SQL = r"""
WITH items AS (SELECT DISTINCT * FROM archive_items),
arcs AS (SELECT DISTINCT archive_name, id, archive_time, repo_path, hostname, username, comment_text, tags, original_paths FROM archives),
refs AS (
  SELECT i.archive_name, a.archive_time, i.item_id, regexp_replace(lower(trim(u.raw, E' \t\n\r')), '^(sha256:|0x)', '') AS chunk_id, u.n AS n
  FROM items i LEFT JOIN arcs a USING (archive_name), LATERAL (SELECT unnest(i.chunks) AS raw, unnest(range(len(i.chunks))) AS n) u
  WHERE trim(u.raw, E' \t\n\r') <> ''),
store AS (
  SELECT regexp_replace(lower(trim(chunk_id, E' \t\n\r')), '^(sha256:|0x)', '') AS chunk_id, original_size, stored_at, deleted_at FROM chunk_store
  UNION ALL SELECT regexp_replace(lower(trim(chunk_id, E' \t\n\r')), '^(sha256:|0x)', ''), original_size, stored_at, NULL FROM seed_chunks)
"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_items(table(spark, sf, "archive_items"))


def archives(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "archives").dropDuplicates(["archive_name"])


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_path, seq, path, size, mtime, inode): each snapshot of a tree as a scan; of a path listed twice the last row holds.

    The data has no inodes: ctime stands in for them.
    """
    raw = table(spark, sf, "archive_items")
    snaps = snapshots(raw, table(spark, sf, "archives"))
    row = F.struct("item_id", "size", F.col("attrs.mtime").alias("mtime"), F.col("attrs.ctime").alias("inode"))
    held = raw.where(F.col("path").isNotNull()).groupBy("archive_name", plain_path("path").alias("path")).agg(F.max_by(row, "item_id").alias("v"))
    return held.join(snaps.select("repo_path", "archive_name", "seq", "n_snapshots"), "archive_name").select("repo_path", "seq", "n_snapshots", "path", "v.size", "v.mtime", "v.inode")


SCANS_SQL = """,
snaps AS (
  SELECT repo_path, archive_name, row_number() OVER (PARTITION BY repo_path ORDER BY archive_time, archive_name) - 1 AS seq, count(*) OVER (PARTITION BY repo_path) AS n_snapshots
  FROM arcs WHERE archive_name IN (SELECT archive_name FROM items)),
scans AS (
  SELECT repo_path, seq, n_snapshots, path, v.size AS size, v.mtime AS mtime, v.inode AS inode FROM (
    SELECT s.repo_path, s.seq, s.n_snapshots, array_to_string(list_filter(string_split(i.path, '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
           arg_max({'size': i.size, 'mtime': i.attrs.mtime, 'inode': i.attrs.ctime}, i.item_id) AS v
    FROM items i JOIN snaps s USING (archive_name) GROUP BY 1, 2, 3, 4))
"""
