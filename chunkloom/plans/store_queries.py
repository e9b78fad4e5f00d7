"""Queries of stores, names, content views and guards over whole tables, and their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import chunking, parity
from chunkloom.functions import scalars as s
from chunkloom.model import plain_id, table, usable_id
from chunkloom.operators import catalog, dedup, tables
from chunkloom.plans import inputs
from chunkloom.session import shared_dir
from chunkloom.sources import documents, files
from chunkloom.sources.places import with_credentials_column

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with the SQL that gives the same result."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, data) of all texts that are not empty: payloads with their ids."""
    data = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").where(F.length("text") > 0).select(F.sha2(data, 256).alias("chunk_id"), data.alias("data"))


# --- content views ---------------------------------------------------------------------------


@query(
    inputs.SQL
    + """ SELECT i.archive_name, i.item_id, i.path FROM items i JOIN arcs a USING (archive_name)
WHERE a.original_paths IS NULL OR len(list_filter(a.original_paths, lambda r: i.path = r OR starts_with(i.path, rtrim(r, '/') || '/'))) > 0"""
)
def restore_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Items at or below the paths their archive was made from."""
    return catalog.at_defaults(inputs.items(spark, sf), inputs.archives(spark, sf).select("archive_name", "original_paths")).select("archive_name", "item_id", "path")


@query(inputs.SQL + ", shared AS (SELECT max(path) AS path FROM items) SELECT archive_name, item_id, i.path FROM items i JOIN shared s ON i.path = s.path")
def content_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose path is exactly the greatest of all paths."""
    rows = inputs.items(spark, sf)
    return catalog.with_exact_path(rows, rows.agg(F.max("path").alias("p")).first()["p"] or "").select("archive_name", "item_id", "path")


@query(inputs.SQL + " SELECT * FROM (SELECT archive_name, item_id, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY item_id) AS INTEGER) AS n FROM items) WHERE n <= 4096")
def content_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a content view loads of each archive at first."""
    return catalog.first_shown(inputs.items(spark, sf).select("archive_name", "item_id")).select("archive_name", "item_id", "n")


@query(inputs.SQL + " SELECT * FROM (SELECT archive_name, item_id, path, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY item_id DESC) AS INTEGER) AS n FROM items WHERE item_type = 'File') WHERE n <= 50")
def recent_files(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 files of each archive that were processed last."""
    return catalog.recent_files(inputs.items(spark, sf).select("archive_name", "item_id", "path", "item_type")).select("archive_name", "item_id", "path", "n")


_NEWEST = ", newest AS (SELECT arg_max(archive_name, (archive_time, archive_name)) AS archive_name FROM arcs WHERE archive_time IS NOT NULL AND archive_name IN (SELECT archive_name FROM items))"


def _newest(spark: SparkSession, sf: str) -> str:
    rows = inputs.archives(spark, sf).where("archive_time is not null").join(table(spark, sf, "archive_items").select("archive_name").distinct(), "archive_name", "left_semi")
    newest = rows.agg(F.max(F.struct("archive_time", "archive_name")).alias("a")).first()["a"]
    return newest["archive_name"] if newest else ""


@query(inputs.SQL + _NEWEST + " SELECT archive_name, item_id, path, size FROM items WHERE archive_name IN (SELECT archive_name FROM newest) AND contains(lower(path), 'a')")
def search_in_archive(spark: SparkSession, sf: str) -> DataFrame:
    """A search within the newest archive that has items."""
    found = catalog.search(table(spark, sf, "archive_items"), table(spark, sf, "archives"), catalog.SearchQuery(substring="A", archive=_newest(spark, sf)))
    return found.select("archive_name", "item_id", "path", "size")


@query(inputs.SQL + _NEWEST + " SELECT archive_name, item_id, path, item_type, size FROM items WHERE archive_name IN (SELECT archive_name FROM newest)")
def load_newest_archive(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.load_archive(table(spark, sf, "archive_items"), table(spark, sf, "archives"), _newest(spark, sf)).select("archive_name", "item_id", "path", "item_type", "size")


# --- stores ----------------------------------------------------------------------------------


@query("SELECT DISTINCT sha256(text) AS chunk_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS is_whole FROM documents WHERE length(text) > 0")
def object_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All texts put into an object store, half of them twice, compressed and with parity; listed and read back."""
    folder = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    chunks = _texts(spark, sf)
    files.put_objects(chunks.where(F.substring("chunk_id", 1, 1) < "8"), folder, "zstd", "low")
    files.put_objects(chunks, folder, "zstd", "low")
    found = files.get_objects(spark, folder, files.list_objects(spark, folder))
    return found.select("chunk_id", F.octet_length("data").cast("bigint").alias("n_bytes"), (F.sha2("data", 256) == F.col("chunk_id")).alias("is_whole"))


@query("SELECT regexp_replace(p, '^objects/', '') AS place, regexp_replace(p, '^objects/(..)/', '\\1') AS chunk_id FROM (SELECT DISTINCT 'objects/' || substr(id, 1, 2) || '/' || substr(id, 3) AS p FROM (SELECT regexp_replace(lower(trim(chunk_id, E' \\t\\n\\r')), '^(sha256:|0x)', '') AS id FROM chunk_store) WHERE regexp_full_match(id, '[0-9a-f]{64}'))")
def object_places(spark: SparkSession, sf: str) -> DataFrame:
    """Ids read off the places of stored objects."""
    ids = table(spark, sf, "chunk_store").select(plain_id("chunk_id").alias("chunk_id")).where(usable_id("chunk_id")).distinct()
    places = ids.select(dedup.object_path().alias("path"))
    return files.object_ids(places).select(F.concat(F.substring("chunk_id", 1, 2), F.lit("/"), F.substring("chunk_id", 3, 62)).alias("place"), "chunk_id")


@query("SELECT DISTINCT sha256(text) AS chunk_id, CAST(80 + 2 * ceil(octet_length(encode(text)) / 16.0) AS BIGINT) AS n_bytes, '50415252011002' AS head FROM documents WHERE length(text) > 0")
def parity_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Parity of all texts: the size of each blob and its first bytes."""
    blobs = parity.with_parity(_texts(spark, sf).dropDuplicates(["chunk_id"]), 2)
    return blobs.select("chunk_id", F.octet_length("parity").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("parity", 1, 7))).alias("head"))


@query("SELECT a AS algorithm, count(*) AS n_payloads, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes_in, count(*) AS n_restored FROM documents, (SELECT unnest(['none', 'lz4', 'zstd', 'zlib', 'lzma', 'xz']) AS a) WHERE length(text) > 0 GROUP BY 1")
def compression_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All texts through each algorithm and back."""
    out = None
    for name in s.ALGORITHMS.values():
        done = chunking.round_trip(_texts(spark, sf), name).agg(F.count(F.lit(1)).alias("n_payloads"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_in"), F.count_if("is_equal").alias("n_restored")).where("n_payloads > 0").withColumn("algorithm", F.lit(name))
        out = done if out is None else out.unionByName(done)
    return out


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS is_tiled FROM documents WHERE length(text) > 0")
def cdc_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the chunks of each text lie side by side from its start, and how many bytes they cover."""
    chunks = chunking.chunk(table(spark, sf, "documents"), "doc_id", "text", 256, 1024, 4096)
    ends = F.array_sort(F.collect_list(F.struct("pos", "start", "size")))
    rows = chunks.groupBy("doc_id").agg(ends.alias("c"))
    reach = F.aggregate("c", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("ok")), lambda acc, x: F.struct((x["start"] + x["size"]).alias("at"), (acc["ok"] & (x["start"] == acc["at"]) & x["size"].between(1, 4096)).alias("ok")))
    return rows.select("doc_id", reach.alias("r")).select("doc_id", F.col("r.at").alias("n_bytes"), F.col("r.ok").alias("is_tiled"))


@query("SELECT DISTINCT archive_name, id, archive_time, hostname, username, comment_text FROM archives WHERE archive_name IS NOT NULL")
def snapshot_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The archives as snapshot documents, projected to a manifest."""
    rows = inputs.archives(spark, sf).where("archive_name is not null").select("id", F.col("archive_name").alias("name"), F.col("archive_time").alias("time"), "hostname", "username", F.col("comment_text").alias("comment"), "tags")
    return documents.manifest(rows).select("archive_name", "id", "archive_time", "hostname", "username", "comment_text")


# --- guards ----------------------------------------------------------------------------------


@query("SELECT DISTINCT archive_name, archive_name IN (SELECT archive_name FROM archive_items WHERE archive_name IS NOT NULL) AS is_taken FROM archives WHERE archive_name IS NOT NULL")
def name_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Of each archive name whether items are kept under it already."""
    return tables.taken(inputs.archives(spark, sf).where("archive_name is not null").select("archive_name"), table(spark, sf, "archive_items").select("archive_name"), "archive_name")


@query(inputs.SQL + ", newest AS (SELECT repo_path, arg_max(archive_name, (archive_time, archive_name)) AS archive_name FROM arcs WHERE archive_name IN (SELECT archive_name FROM items) GROUP BY 1) SELECT archive_name, count(*) AS n_items, CAST(count(*) FILTER (archive_name IN (SELECT archive_name FROM newest)) AS BIGINT) AS n_fresh FROM items GROUP BY 1")
def catalog_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the catalog after the newest archive of each repository is indexed again."""
    held = inputs.items(spark, sf).select("archive_name", "item_id").withColumn("is_fresh", F.lit(False))
    arcs = inputs.archives(spark, sf).join(held.select("archive_name").distinct(), "archive_name", "left_semi")
    again = held.join(catalog.latest_archive(arcs).select("archive_name"), "archive_name", "left_semi").withColumn("is_fresh", F.lit(True))
    return tables.reindex(held, again, "archive_name").groupBy("archive_name").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("is_fresh").alias("n_fresh"))


# --- names, texts ----------------------------------------------------------------------------


@query("SELECT DISTINCT report_id, CASE WHEN duration_s < 60 THEN printf('%.1fs', duration_s) WHEN duration_s < 3600 THEN printf('%.1fm', duration_s / 60) ELSE printf('%.1fh', duration_s / 3600) END AS shown FROM verify_reports WHERE duration_s >= 0")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "verify_reports").where("duration_s >= 0").select("report_id", s.duration("duration_s").alias("shown")).distinct()


@query("SELECT DISTINCT strftime(archive_time, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('day', archive_time)) AS BIGINT) AS epoch FROM archives WHERE archive_time IS NOT NULL")
def parse_days(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "archives").where("archive_time is not null").select(F.date_format("archive_time", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("day", s.parse_day("day").alias("epoch"))


@query("SELECT DISTINCT item_type, item_type AS by_name, CASE item_type WHEN 'File' THEN 'File' WHEN 'Directory' THEN 'Directory' WHEN 'Symlink' THEN 'Symlink' WHEN 'Hardlink' THEN 'Hardlink' END AS by_letter FROM archive_items WHERE item_type IN ('File', 'Directory', 'Symlink', 'Hardlink')")
def type_names(spark: SparkSession, sf: str) -> DataFrame:
    """Types read from their names and from their letters."""
    kinds = table(spark, sf, "archive_items").select("item_type").distinct().where(F.col("item_type").isin("File", "Directory", "Symlink", "Hardlink"))
    return kinds.select("item_type", s.type_name(F.upper("item_type")).alias("by_name"), s.type_name(s.type_letter("item_type")).alias("by_letter"))


@query("SELECT DISTINCT hostname, username, 'backup_archive_ptintime_' || hostname || '_' || username || '_2024-06-01T10:20:30.456Z' AS archive_name FROM archives WHERE hostname IS NOT NULL AND username IS NOT NULL")
def default_archive_names(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(dt.datetime(2024, 6, 1, 10, 20, 30, 456000)).cast("timestamp_ntz")
    rows = table(spark, sf, "archives").where("hostname is not null and username is not null").select("hostname", "username").distinct()
    return rows.select("hostname", "username", s.unique_archive_name(F.col("hostname"), F.col("username"), now).alias("archive_name"))


@query(
    """
WITH v AS (SELECT DISTINCT username || '@' || hostname || ':' || repo_path AS address, username, hostname, repo_path FROM archives WHERE username IS NOT NULL AND hostname IS NOT NULL AND NOT contains(repo_path, ':'))
SELECT address, 'ssh' AS kind, username AS user, hostname AS host, CAST(22 AS INTEGER) AS port, repo_path AS path FROM v"""
)
def remote_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the repositories on their hosts, taken apart again."""
    rows = table(spark, sf, "archives").where("username is not null and hostname is not null").where(~F.col("repo_path").contains(":"))
    rows = rows.select(F.concat("username", F.lit("@"), "hostname", F.lit(":"), "repo_path").alias("address")).distinct()
    return rows.select("address", s.location("address").alias("p")).select("address", "p.kind", "p.user", "p.host", "p.port", "p.path")


@query("WITH v AS (SELECT DISTINCT repo_path AS p FROM archive_bookmarks) SELECT p AS repo_path, CASE WHEN p LIKE 's3://%' THEN p WHEN p LIKE '%://%@%' THEN p WHEN p LIKE '%://%' THEN regexp_replace(p, '://', '://me:word@') ELSE 'https://me:word@' || p END AS address FROM v")
def credential_addresses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "archive_bookmarks").select("repo_path").distinct()
    return rows.select("repo_path", with_credentials_column("repo_path", "me", "word").alias("address"))


@query("SELECT DISTINCT symlink_target AS raw, CASE WHEN length(t) > 1 AND t LIKE '%/' THEN substr(t, 1, length(t) - 1) ELSE t END AS path FROM (SELECT symlink_target, CASE WHEN trim(symlink_target) LIKE '/%' THEN trim(symlink_target) ELSE '/' || trim(symlink_target) END AS t FROM archive_items WHERE symlink_target IS NOT NULL)")
def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "archive_items").where("symlink_target is not null").select(F.col("symlink_target").alias("raw")).distinct()
    return rows.select("raw", s.normal_path("raw").alias("path"))
