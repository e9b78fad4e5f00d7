"""Queries of the catalog operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.patterns import preset
from chunkloom.model import plain_id, table
from chunkloom.operators import catalog, dedup, diff, jobs, paths, sync, tables, verify
from chunkloom.plans import inputs
from chunkloom.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, base: bool = True) -> Callable:
    """Register a query under its name, with the SQL that gives the same result."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (inputs.SQL if base else "") + sql
        return f

    return keep


# --- deduplication ---------------------------------------------------------------------------

_FIRST = """,
sizes AS (SELECT chunk_id, max(original_size) AS original_size FROM store WHERE length(chunk_id) = 64 GROUP BY 1),
owned AS (
  SELECT chunk_id, arg_min({'archive_name': archive_name, 'item_id': item_id, 'pos': pos}, (archive_time, archive_name, item_id, pos)) AS o, count(*) AS n_references
  FROM (SELECT *, n AS pos FROM refs) GROUP BY 1)
"""


@query(
    _FIRST
    + """,
kinds AS (
  SELECT archive_name, count(*) FILTER (item_type IN ('File', 'Hardlink')) AS nfiles, count(*) FILTER (item_type = 'Directory') AS ndirs,
         CAST(coalesce(sum(size) FILTER (item_type = 'File'), 0) AS BIGINT) AS original_size
  FROM items GROUP BY 1),
held AS (SELECT archive_name, count(*) AS nchunks FROM refs GROUP BY 1),
new AS (SELECT o.archive_name AS archive_name, count(*) AS n, CAST(coalesce(sum(original_size), 0) AS BIGINT) AS bytes FROM owned LEFT JOIN sizes USING (chunk_id) GROUP BY 1)
SELECT archive_name, nfiles, ndirs, original_size, coalesce(nchunks, 0) AS nchunks, coalesce(n, 0) AS nchunks_unique, coalesce(bytes, 0) AS deduplicated_size, coalesce(bytes, 0) AS compressed_size
FROM kinds LEFT JOIN held USING (archive_name) LEFT JOIN new USING (archive_name)"""
)
def dedup_stats_by_archive(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.archive_stats(inputs.items(spark, sf), inputs.archives(spark, sf), table(spark, sf, "chunk_store"), table(spark, sf, "seed_chunks"))


@query(_FIRST + "SELECT chunk_id, o.archive_name AS archive_name, o.item_id AS item_id, CAST(o.pos AS INTEGER) AS pos, n_references FROM owned")
def chunk_first_owner(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_owners(dedup.chunk_references(inputs.items(spark, sf), inputs.archives(spark, sf)))


@query("SELECT chunk_id, count(*) AS refcount FROM refs GROUP BY 1")
def chunk_refcount(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.reference_counts(dedup.chunk_references(inputs.items(spark, sf), inputs.archives(spark, sf)))


@query(
    r"""
SELECT chunk_id, min(arrival_id) AS first_arrival, count(*) AS n_arrivals
FROM (SELECT DISTINCT arrival_id, regexp_replace(lower(trim(chunk_id, E' \t\n\r')), '^(sha256:|0x)', '') AS chunk_id FROM chunk_arrivals WHERE trim(chunk_id, E' \t\n\r') <> '')
WHERE chunk_id NOT IN (SELECT chunk_id FROM seed_chunks) GROUP BY 1""",
    base=False,
)
def dedup_new_chunks_anti(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.new_chunks(table(spark, sf, "chunk_arrivals"), table(spark, sf, "seed_chunks"))


@query("SELECT DISTINCT chunk_id, left(chunk_id, 2) AS prefix, left(chunk_id, 16) AS short_id, 'objects/' || left(chunk_id, 2) || '/' || substr(chunk_id, 3) AS object_path FROM store WHERE length(chunk_id) = 64")
def chunk_store_layout(spark: SparkSession, sf: str) -> DataFrame:
    ids = dedup.chunk_sizes(table(spark, sf, "chunk_store"), table(spark, sf, "seed_chunks"))
    return ids.select("chunk_id", F.substring("chunk_id", 1, 2).alias("prefix"), F.substring("chunk_id", 1, 16).alias("short_id"), dedup.object_path().alias("object_path"))


@query(", sizes AS (SELECT chunk_id, max(original_size) AS s FROM store WHERE length(chunk_id) = 64 GROUP BY 1) SELECT count(*) AS n_chunks, CAST(sum(s) AS BIGINT) AS n_bytes, avg(s) AS mean_size FROM sizes")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.chunk_stats(dedup.chunk_sizes(table(spark, sf, "chunk_store"), table(spark, sf, "seed_chunks")))


@query(
    """
SELECT arrival_id, CAST(sum(s) OVER w - s AS BIGINT) AS byte_offset,
       CASE WHEN sum(s) OVER f > 0 THEN CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(s) OVER f AS DOUBLE) ELSE 1.0 END AS progress
FROM (SELECT DISTINCT arrival_id, archive_name, path, chunk_pos, coalesce(original_size, 0) AS s FROM chunk_arrivals WHERE arrival_id IS NOT NULL)
WINDOW w AS (PARTITION BY archive_name, path ORDER BY chunk_pos, arrival_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY archive_name, path)""",
    base=False,
)
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.chunk_offsets(table(spark, sf, "chunk_arrivals"))


@query("SELECT CASE WHEN size // 1048576 < 20 THEN '1M' WHEN size // 1048576 < 40 THEN '4M' WHEN size // 1048576 < 80 THEN '8M' WHEN size // 1048576 < 160 THEN '16M' WHEN size // 1048576 < 320 THEN '32M' ELSE '64M' END AS profile, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM items WHERE item_type = 'File' GROUP BY 1")
def chunk_profile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    from chunkloom.functions.scalars import profile

    files = inputs.items(spark, sf).where(F.col("item_type") == "File")
    return files.groupBy(profile("size").alias("profile")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


@query("SELECT doc_id, coalesce(sha256(text), sha256('')) AS content_hash FROM documents WHERE length(text) > 0", base=False)
def reassemble_content(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut into pieces of 100 characters, shuffled and joined again."""
    n = F.ceil(F.length("text") / F.lit(100)).cast("int")
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    pieces = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 100 + 1, F.lit(100)))).alias("pos", "data"))
    return dedup.reassemble(pieces.repartition("pos"), "doc_id").select("doc_id", F.sha2("content", 256).alias("content_hash"))


# --- search and lists ------------------------------------------------------------------------

_HITS = "SELECT i.archive_name, a.archive_time, i.item_id, i.path, i.item_type, i.size, i.attrs.mtime AS mtime FROM items i JOIN arcs a USING (archive_name) WHERE "


def _search(spark: SparkSession, sf: str, **conditions: object) -> DataFrame:
    return catalog.search(table(spark, sf, "archive_items"), table(spark, sf, "archives"), catalog.SearchQuery(**conditions))


@query(_HITS + "contains(lower(i.path), 'ledger')")
def search_substring(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, substring="Ledger")


@query(_HITS + "lower(i.path) = 'lab/chart.csv'")
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, exact="lab/Chart.csv", glob="*")


@query(_HITS + r"regexp_full_match(lower(i.path), '(?s).*/photo.*\....')")
def search_glob(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, glob="*/photo*.???")


@query(_HITS + "i.item_type = 'File' AND i.size >= 4096 AND i.size <= 1048576 AND i.attrs.mtime >= 1704067200 AND i.attrs.mtime <= 1719792000")
def search_filters(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, item_type="File", min_size=4096, max_size=1048576, modified_after=1704067200, modified_before=1719792000)


@query(_HITS + "contains(lower(i.path), 'music') ORDER BY a.archive_time DESC, i.archive_name, i.path, i.item_id LIMIT 100")
def search_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, substring="music", limit=100)


@query(_HITS + "contains(lower(i.path), 'music') ORDER BY a.archive_time DESC, i.archive_name, i.path, i.item_id LIMIT 1")
def search_limit_zero(spark: SparkSession, sf: str) -> DataFrame:
    """A limit of 0 gives one row."""
    return _search(spark, sf, substring="music", limit=0)


@query("SELECT archive_name, item_id, path FROM items WHERE contains(path, 'Über')")
def browse_items(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse(inputs.items(spark, sf), "Über").select("archive_name", "item_id", "path")


@query("SELECT archive_name, item_id, path FROM items WHERE regexp_matches('root/' || path, '^root/(docs|maps)/.*[0-9]{4}')")
def browse_items_regex(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse(inputs.items(spark, sf), "^root/(docs|maps)/.*[0-9]{4}", regex=True, root="root").select("archive_name", "item_id", "path")


_ARCS = "SELECT archive_name, repo_path, archive_time FROM arcs "


@query(_ARCS)
def list_archives_default(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_archives(table(spark, sf, "archives"))


@query(_ARCS + "WHERE contains(archive_name, 'photos')")
def list_archives_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_archives(table(spark, sf, "archives"), sort="name", contains="photos")


@query("SELECT * FROM (SELECT * FROM (" + _ARCS + "ORDER BY archive_time DESC, archive_name LIMIT 200) ORDER BY archive_time, archive_name DESC LIMIT 50)")
def list_archives_first_last(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200, and of these the last 50: a limit is the feature."""
    return catalog.list_archives(table(spark, sf, "archives"), first=200, last=50)


@query("SELECT archive_name, item_id, path, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY string_split(path, '/'), item_id) AS INTEGER) AS n_in_order FROM items")
def list_items_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ranked_items(inputs.items(spark, sf).select("archive_name", "item_id", "path"), "path").select("archive_name", "item_id", "path", "n_in_order")


@query("SELECT archive_name, item_id, size, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY size DESC, item_id) AS INTEGER) AS n_in_order FROM items")
def list_items_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ranked_items(inputs.items(spark, sf).select("archive_name", "item_id", "size"), "size").select("archive_name", "item_id", "size", "n_in_order")


@query("SELECT archive_name, item_id, attrs.mtime AS mtime, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY attrs.mtime DESC, item_id) AS INTEGER) AS n_in_order FROM items")
def list_items_by_mtime(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ranked_items(inputs.items(spark, sf).select("archive_name", "item_id", "attrs"), "mtime").select("archive_name", "item_id", F.col("attrs.mtime").alias("mtime"), "n_in_order")


@query("SELECT archive_name, item_id, path FROM items WHERE (path IN ('old', 'docs') OR starts_with(path, 'old/') OR starts_with(path, 'docs/')) AND contains(lower(path), 'e') AND NOT contains(lower(path), '.log') AND NOT contains(lower(path), 'music')")
def list_items_prefix_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_items(table(spark, sf, "archive_items"), ("old/", "docs"), "E", (".log", "music")).select("archive_name", "item_id", "path")


@query("SELECT archive_name, count(*) FILTER (item_type = 'File') AS n_files, count(*) FILTER (item_type = 'Directory') AS n_directories, CAST(sum(size) AS BIGINT) AS total_size FROM items GROUP BY 1")
def list_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.item_totals(inputs.items(spark, sf))


@query("SELECT (SELECT count(DISTINCT archive_name) FROM arcs) AS n_archives, count(*) FILTER (item_type = 'File') AS n_files, count(*) FILTER (item_type = 'Directory') AS n_directories, CAST(sum(size) AS BIGINT) AS total_size FROM items")
def catalog_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_totals(inputs.items(spark, sf), table(spark, sf, "archives"))


@query("SELECT a.archive_name, a.archive_time, a.hostname, a.username, a.comment_text, array_to_string(a.tags, ',') AS tags, coalesce(t.n, 0) AS n_items, CAST(coalesce(t.s, 0) AS BIGINT) AS total_size FROM arcs a LEFT JOIN (SELECT archive_name, count(*) AS n, sum(size) AS s FROM items GROUP BY 1) t USING (archive_name)")
def archive_info(spark: SparkSession, sf: str) -> DataFrame:
    totals = inputs.items(spark, sf).groupBy("archive_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("total_size"))
    rows = inputs.archives(spark, sf).join(totals, "archive_name", "left").fillna(0, ["n_items", "total_size"])
    return rows.select("archive_name", "archive_time", "hostname", "username", "comment_text", F.array_join("tags", ",").alias("tags"), "n_items", "total_size")


@query("SELECT repo_path, arg_max(archive_name, (archive_time, archive_name)) AS archive_name, max(archive_time) AS archive_time FROM arcs GROUP BY 1")
def latest_archive(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_archive(table(spark, sf, "archives"))


_KEPT = ", kept AS (SELECT archive_name, item_id, path, CASE WHEN item_type = 'Hardlink' THEN 2 ELSE 1 END AS restore_pass FROM items WHERE item_type IN ('File', 'Directory', 'Symlink', 'Hardlink'))"


@query(_KEPT + " SELECT *, CAST(row_number() OVER (PARTITION BY archive_name ORDER BY restore_pass, string_split(path, '/'), item_id) AS INTEGER) AS restore_rank FROM kept")
def restore_order(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.restore_order(inputs.items(spark, sf))


@query("SELECT archive_name, count(*) FILTER (item_type = 'File') AS n_files, CAST(coalesce(sum(size) FILTER (item_type = 'File'), 0) AS BIGINT) AS n_bytes FROM items GROUP BY 1")
def restore_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.restore_totals(inputs.items(spark, sf))


@query(
    """, newest AS (SELECT repo_path, arg_max(archive_name, (archive_time, archive_name)) AS archive_name FROM arcs WHERE archive_name IN (SELECT archive_name FROM items) GROUP BY 1)
SELECT * FROM (SELECT n.repo_path, i.archive_name, i.item_id, i.path, i.size, CAST(row_number() OVER (PARTITION BY n.repo_path ORDER BY i.item_id) AS INTEGER) AS n FROM items i JOIN newest n USING (archive_name) WHERE i.item_type = 'File') WHERE n <= 10"""
)
def restore_sample(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.restore_sample(inputs.items(spark, sf), table(spark, sf, "archives"))


# --- differences -----------------------------------------------------------------------------

_DIFF = r""",
ends AS (
  SELECT repo_path, arg_min(archive_name, (archive_time, archive_name)) AS a, arg_max(archive_name, (archive_time, archive_name)) AS b
  FROM arcs WHERE archive_name IN (SELECT archive_name FROM items) GROUP BY 1 HAVING a <> b),
tree AS (
  SELECT archive_name, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
         arg_max({'item_type': item_type, 'size': size, 'mtime': attrs.mtime, 'mode': attrs.mode,
                  'chunks': list_filter(list_transform(coalesce(chunks, []), lambda x: regexp_replace(lower(trim(x, E' \t\n\r')), '^(sha256:|0x)', '')), lambda x: x <> '')}, item_id) AS v
  FROM items GROUP BY 1, 2),
old AS (SELECT repo_path, path, v FROM tree JOIN ends ON archive_name = a),
new AS (SELECT repo_path, path, v FROM tree JOIN ends ON archive_name = b),
entries AS (
  SELECT repo_path, path,
         CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN %s THEN 'modified' ELSE 'unchanged' END AS status,
         o.v.size AS size_before, n.v.size AS size_after, o.v.mtime AS mtime_before, n.v.mtime AS mtime_after
  FROM old o FULL JOIN new n USING (repo_path, path))
"""
_CHANGED = "o.v IS DISTINCT FROM n.v"
_CHANGED_CATALOG = "o.v.size IS DISTINCT FROM n.v.size OR o.v.mtime IS DISTINCT FROM n.v.mtime OR o.v.mode IS DISTINCT FROM n.v.mode OR o.v.chunks IS DISTINCT FROM n.v.chunks"


def _diff(spark: SparkSession, sf: str, columns: tuple[str, ...] = diff.FULL, roots: tuple[str, ...] = ()) -> DataFrame:
    raw = table(spark, sf, "archive_items")
    return diff.entries(raw, diff.archive_pairs(raw, table(spark, sf, "archives")), columns, roots)


@query(_DIFF % _CHANGED + "SELECT * FROM entries")
def diff_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query(_DIFF % _CHANGED_CATALOG + "SELECT * FROM entries WHERE status <> 'unchanged'")
def diff_catalog_semantics(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, diff.CATALOG).where(F.col("status") != "unchanged")


@query(
    _DIFF % _CHANGED
    + """, sums AS (
SELECT repo_path, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'modified') AS n_modified, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) AS n_paths,
       CAST(coalesce(sum(size_after) FILTER (status = 'added'), 0) AS BIGINT) AS added_bytes, CAST(coalesce(sum(size_before) FILTER (status = 'removed'), 0) AS BIGINT) AS removed_bytes, CAST(coalesce(sum(size_after - size_before) FILTER (status = 'modified'), 0) AS BIGINT) AS modified_bytes
FROM entries GROUP BY 1) SELECT *, added_bytes - removed_bytes + modified_bytes AS net_bytes FROM sums"""
)
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff.summary(_diff(spark, sf))


@query(
    _DIFF.split("ends AS")[0]
    + "tree AS"
    + _DIFF.split("tree AS")[1].split("old AS")[0]
    + """steps AS (SELECT repo_path, archive_name AS b, lag(archive_name) OVER (PARTITION BY repo_path ORDER BY archive_time, archive_name) AS a FROM arcs WHERE archive_name IN (SELECT archive_name FROM items)),
old AS (SELECT b AS after_name, repo_path, path, v FROM tree JOIN steps ON archive_name = a),
new AS (SELECT b AS after_name, repo_path, path, v FROM tree JOIN steps ON archive_name = b WHERE a IS NOT NULL),
entries AS (
  SELECT repo_path, after_name, o.v.size AS before, n.v.size AS after, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'modified' ELSE 'unchanged' END AS status
  FROM old o FULL JOIN new n USING (repo_path, after_name, path)),
sums AS (
  SELECT repo_path, after_name, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'modified') AS n_modified, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) AS n_paths,
    CAST(coalesce(sum(after) FILTER (status = 'added'), 0) AS BIGINT) AS added_bytes, CAST(coalesce(sum(before) FILTER (status = 'removed'), 0) AS BIGINT) AS removed_bytes, CAST(coalesce(sum(after - before) FILTER (status = 'modified'), 0) AS BIGINT) AS modified_bytes
  FROM entries GROUP BY 1, 2)
SELECT *, added_bytes - removed_bytes + modified_bytes AS net_bytes FROM sums"""
)
def diff_successive(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of every archive against the one before it in its repository."""
    raw = table(spark, sf, "archive_items")
    return diff.summary(diff.entries(raw, diff.successive_pairs(raw, table(spark, sf, "archives")), by_pair=True))


@query(_DIFF % _CHANGED + "SELECT repo_path, path, status, CAST(row_number() OVER (PARTITION BY repo_path, status ORDER BY CASE status WHEN 'added' THEN size_after WHEN 'removed' THEN size_before ELSE abs(size_after - size_before) END DESC NULLS LAST, path) AS INTEGER) AS n_in_status FROM entries WHERE status <> 'unchanged'")
def diff_by_delta(spark: SparkSession, sf: str) -> DataFrame:
    return diff.ranked(_diff(spark, sf)).select("repo_path", "path", "status", "n_in_status")


@query(_DIFF % _CHANGED + "SELECT * FROM entries WHERE path IN ('docs', 'old/2023') OR starts_with(path, 'docs/') OR starts_with(path, 'old/2023/')")
def diff_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, roots=("docs", "old/2023/"))


# --- integrity -------------------------------------------------------------------------------

_PRESENT = ", present AS (SELECT DISTINCT chunk_id FROM store WHERE deleted_at IS NULL AND length(chunk_id) = 64), missing AS (SELECT DISTINCT archive_name, item_id, chunk_id FROM refs WHERE chunk_id NOT IN (SELECT chunk_id FROM present))"


def _present(spark: SparkSession, sf: str) -> DataFrame:
    return verify.stored_ids(table(spark, sf, "chunk_store"), table(spark, sf, "seed_chunks"))


@query(_PRESENT + "SELECT * FROM missing")
def verify_missing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return verify.missing_chunks(inputs.items(spark, sf), _present(spark, sf))


_REPORT = _PRESENT + ", report AS (SELECT i.archive_name, i.n_items, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_missing, 0) AS n_missing, coalesce(n_invalid, 0) = 0 AS is_ok FROM (SELECT archive_name, count(*) AS n_items FROM items GROUP BY 1) i LEFT JOIN (SELECT archive_name, count(DISTINCT item_id) AS n_invalid, count(DISTINCT chunk_id) AS n_missing FROM missing GROUP BY 1) m USING (archive_name))"


def _report(spark: SparkSession, sf: str) -> DataFrame:
    own = inputs.items(spark, sf)
    return verify.archive_report(own, verify.missing_chunks(own, _present(spark, sf)))


@query(_REPORT + "SELECT * FROM report")
def verify_archive_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query(_REPORT + "SELECT bool_and(is_ok) AS is_ok, CAST(sum(n_invalid) AS BIGINT) AS total_errors, count(*) FILTER (NOT is_ok) AS archives_with_errors FROM report")
def verify_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return verify.integrity(_report(spark, sf))


_IDS = r"list_filter(list_transform(coalesce({}, []), lambda x: regexp_replace(lower(trim(x, E' \t\n\r')), '^(sha256:|0x)', '')), lambda x: x <> '')"


@query(
    f"""
SELECT DISTINCT report_id, repo_path, CAST(len({_IDS.format("corrupted_chunks")}) + len({_IDS.format("missing_chunks")}) AS BIGINT) AS error_count,
       array_to_string(list_sort(list_distinct({_IDS.format("corrupted_chunks")})), ',') AS corrupted, array_to_string(list_sort(list_distinct({_IDS.format("missing_chunks")})), ',') AS missing,
       CASE WHEN total_chunks > 0 THEN CAST(verified_chunks AS DOUBLE) / total_chunks * 100 ELSE 100.0 END AS success_rate,
       CASE WHEN duration_s > 0 THEN bytes_verified / duration_s ELSE 0.0 END AS throughput
FROM verify_reports""",
    base=False,
)
def verify_report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return verify.report_metrics(table(spark, sf, "verify_reports"))


@query("SELECT sha256(text) AS chunk_id FROM documents WHERE contains(text, '&amp;') GROUP BY 1", base=False)
def verify_hash_report(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads whose entities were decoded on the way no longer hash to their ids."""
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return verify.corrupted(docs.select(F.sha2("text", 256).alias("chunk_id"), F.regexp_replace("text", "&amp;", "&").alias("data"))).distinct()


_REACH = ", present AS (SELECT DISTINCT chunk_id FROM store WHERE deleted_at IS NULL AND length(chunk_id) = 64), reach AS (SELECT DISTINCT chunk_id FROM (SELECT chunk_id FROM refs WHERE archive_time IS NOT NULL UNION ALL SELECT regexp_replace(lower(trim(id, E' \\t\\n\\r')), '^(sha256:|0x)', '') FROM arcs) WHERE length(chunk_id) = 64)"


def _sweep(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return verify.sweep(_present(spark, sf), verify.reachable_ids(table(spark, sf, "archive_items"), table(spark, sf, "archives")))


@query(_REACH + "SELECT chunk_id FROM present WHERE chunk_id NOT IN (SELECT chunk_id FROM reach)")
def gc_unreachable(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf)[0]


@query(_REACH + "SELECT count(*) AS n_remaining FROM present WHERE chunk_id IN (SELECT chunk_id FROM reach)")
def gc_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf)[1].agg(F.count(F.lit(1)).alias("n_remaining"))


@query(_PRESENT + ", used AS (SELECT DISTINCT chunk_id FROM refs) SELECT chunk_id FROM present WHERE chunk_id NOT IN (SELECT chunk_id FROM used)")
def ext_orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: stored chunks that no item refers to."""
    used = table(spark, sf, "archive_items").select(F.explode("chunks").alias("c")).select(plain_id("c").alias("chunk_id")).distinct()
    return _present(spark, sf).join(used, "chunk_id", "left_anti")


_EDGES = """, plain AS (SELECT DISTINCT archive_name, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM items),
nodes AS (SELECT DISTINCT archive_name, array_to_string(parts[1:n], '/') AS node, CAST(n AS INTEGER) AS depth FROM plain, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS n))"""


@query(_EDGES + " SELECT archive_name, '' AS node, 0 AS depth FROM (SELECT DISTINCT archive_name FROM nodes) UNION ALL SELECT archive_name, node, depth FROM nodes")
def tree_reachability(spark: SparkSession, sf: str) -> DataFrame:
    return verify.reachable_nodes(verify.folder_edges(table(spark, sf, "archive_items")))


# --- incremental scans -----------------------------------------------------------------------

_KEYS = ["repo_path", "path"]
#: Each sighting of a path with what the cache held of it, when it was seen before and when it will be again.
_SIGHT = (
    inputs.SCANS_SQL
    + """,
sight AS (
  SELECT repo_path, path, seq, size, mtime, last_value(size IGNORE NULLS) OVER past AS cached_size, last_value(mtime IGNORE NULLS) OVER past AS cached_mtime,
         lag(seq) OVER own AS seen, coalesce(lead(seq) OVER own, n_snapshots) AS next
  FROM scans
  WINDOW own AS (PARTITION BY repo_path, path ORDER BY seq), past AS (PARTITION BY repo_path, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT repo_path, path, seq, next, seen, coalesce(size, cached_size) AS size, coalesce(mtime, cached_mtime) AS mtime,
         size IS NOT DISTINCT FROM cached_size AND mtime IS NOT DISTINCT FROM cached_mtime AS same FROM sight)
"""
)
_PROBED = ", c AS (SELECT * REPLACE (seq + 1 AS seq) FROM scans), p AS (SELECT repo_path, CAST(seq AS INTEGER) AS seq, path, CASE WHEN c.n_snapshots IS NULL THEN 'miss' WHEN w.size = c.size AND w.mtime = c.mtime AND w.inode = c.inode THEN 'hit' ELSE 'stale' END AS outcome FROM (SELECT * FROM scans WHERE seq > 0) w LEFT JOIN c USING (repo_path, seq, path)) "


@query(
    _SIGHT
    + """SELECT repo_path, path, CAST(seq AS INTEGER) AS seq, size, mtime, CASE WHEN seen = seq - 1 AND same THEN 'unchanged' ELSE 'changed' END AS change FROM held WHERE seq > 0
UNION ALL SELECT repo_path, path, CAST(seq + 1 AS INTEGER), size, mtime, 'deleted' FROM held WHERE next > seq + 1"""
)
def scan_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every scan after the first of each tree against the cache of all before it, by ``seq``."""
    return sync.scan_diffs(inputs.scans(spark, sf), _KEYS)


@query(_SIGHT + "SELECT repo_path, path, CAST(t AS INTEGER) AS seq, size, mtime, CAST(seq + CASE WHEN t > seq THEN 2 ELSE 1 END AS INTEGER) AS cached_at, t > seq AS deleted FROM (SELECT *, unnest(range(seq, next)) AS t FROM held) WHERE t > 0")
def scan_cache_next(spark: SparkSession, sf: str) -> DataFrame:
    """The cache after every scan but the first of each tree, by ``seq``."""
    return sync.caches(inputs.scans(spark, sf), _KEYS)


@query(inputs.SCANS_SQL + _PROBED + "SELECT * FROM p")
def cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Every scan after the first against the one before."""
    scans = cut(inputs.scans(spark, sf))
    return sync.probe(scans.where("seq > 0"), scans.withColumn("seq", F.col("seq") + 1), ["repo_path", "seq", "path"])


@query(inputs.SCANS_SQL + _PROBED + "SELECT count(*) FILTER (outcome = 'hit') AS n_hits, count(*) FILTER (outcome <> 'hit') AS n_misses, CAST(count(*) FILTER (outcome = 'hit') AS DOUBLE) / count(*) AS hit_rate FROM p")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return sync.probe_rates(cache_probe(spark, sf))


@query("SELECT archive_name, item_id, attrs.atime AS cached_at FROM items WHERE attrs.atime >= 1735689600 - 31536000")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    """Entries cached at their access time, a year old at most at the start of 2025."""
    rows = inputs.items(spark, sf).select("archive_name", "item_id", F.col("attrs.atime").alias("cached_at"))
    return sync.evict(rows, 1735689600, 31_536_000)


# --- paths -----------------------------------------------------------------------------------

_ROOTED = """, rooted AS (SELECT archive_name, array_to_string(list_filter(string_split(u.r, '/'), lambda x: x NOT IN ('', '.')), '/') AS root, max(u.n) AS root_n
FROM arcs, LATERAL (SELECT unnest(original_paths) AS r, unnest(range(len(original_paths))) AS n) u WHERE u.r IS NOT NULL GROUP BY ALL),
plain AS (SELECT archive_name, item_id, path, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM items)
SELECT p.archive_name, p.item_id, max(length(r.root)) AS root_length, arg_max(r.root, length(r.root)) AS root, CAST(arg_max(r.root_n, length(r.root)) AS INTEGER) AS root_n
FROM plain p LEFT JOIN rooted r ON r.archive_name = p.archive_name AND (p.p = r.root OR starts_with(p.p, r.root || '/') OR r.root = '') GROUP BY 1, 2"""


@query(_ROOTED)
def root_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's deepest root among its archive's original paths."""
    roots = inputs.archives(spark, sf).select("archive_name", F.posexplode("original_paths").alias("n", "root")).where(F.col("root").isNotNull())
    found = paths.assign_roots(inputs.items(spark, sf).select("archive_name", "item_id", "path"), roots, ["archive_name"])
    return found.select("archive_name", "item_id", F.length("root").cast("bigint").alias("root_length"), "root", "root_n")


_RULES = preset("defaults", "logs")
#: The preset rules as one pattern: a folder of a fixed name above, an ending, or an absolute place.
_OUT = r"regexp_full_match(path, '(?s)(?:.*/)?(?:\.cache|cache|__pycache__|node_modules|\.npm|\.cargo/registry|target/debug|target/release|logs)/.+|(?:.*/)?(?:.*\.tmp|.*\.temp|.*\.swp|.*\.swo|.*~|\..*\.swp|.*\.log)|/(?:tmp|var/tmp|proc|sys|dev|run|var/run|lost\+found|var/log)/.+')"


@query(f"SELECT archive_name, item_id, {_OUT} AS is_excluded FROM items")
def exclusion_apply(spark: SparkSession, sf: str) -> DataFrame:
    return paths.exclude_flat(inputs.items(spark, sf), _RULES).select("archive_name", "item_id", "is_excluded")


@query(f"SELECT archive_name, count(*) AS n_checked, count(*) FILTER ({_OUT}) AS n_excluded, count(*) FILTER (NOT {_OUT}) AS n_included, CAST(count(*) FILTER ({_OUT}) AS DOUBLE) / count(*) AS exclusion_rate FROM items GROUP BY 1")
def exclusion_stats(spark: SparkSession, sf: str) -> DataFrame:
    return paths.exclusion_stats(paths.exclude_flat(inputs.items(spark, sf), _RULES), ["archive_name"])


@query(
    r""", plain AS (SELECT archive_name, item_id, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM items),
ups AS (SELECT archive_name, item_id, array_to_string(parts[1:n], '/') AS path FROM plain, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS n))
"""
    + f"SELECT archive_name, item_id, bool_or({_OUT}) AS is_excluded FROM ups GROUP BY 1, 2"
)
def exclusion_with_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return paths.exclude_with_ancestors(inputs.items(spark, sf), _RULES).select("archive_name", "item_id", "is_excluded")


# --- names -----------------------------------------------------------------------------------


@query("SELECT id AS row_id, task_kind AS name, CASE WHEN n = 0 THEN task_kind ELSE task_kind || '_' || n END AS unique_name FROM (SELECT id, repo_type || '-' || schedule_type AS task_kind, row_number() OVER (PARTITION BY repo_type || '-' || schedule_type ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id, repo_type, schedule_type FROM scheduled_tasks))", base=False)
def free_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "scheduled_tasks").dropDuplicates(["id"])
    return tables.free_names(rows.select(F.col("id").alias("row_id"), F.concat_ws("-", "repo_type", "schedule_type").alias("name")))


_RETAINED = """, ranked AS (SELECT archive_name, repo_path, archive_time, %s FROM arcs)
SELECT archive_name, repo_path, archive_time, (hn = 1 AND hr <= 24) OR (dn = 1 AND dr <= 7) OR (wn = 1 AND wr <= 4) OR (mn = 1 AND mr <= 6) AS is_kept FROM ranked""" % ", ".join(
    f"row_number() OVER (PARTITION BY repo_path, date_trunc('{u}', archive_time) ORDER BY archive_time DESC, archive_name DESC) AS {u[0]}n, dense_rank() OVER (PARTITION BY repo_path ORDER BY date_trunc('{u}', archive_time) DESC) AS {u[0]}r" for u in ("hour", "day", "week", "month")
)


@query(_RETAINED)
def ext_retention_gfs(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: which archives a policy of 24 hourly, 7 daily, 4 weekly and 6 monthly ones keeps."""
    rows = inputs.archives(spark, sf).select("archive_name", "repo_path", "archive_time")
    return jobs.retained(rows, {"hour": 24, "day": 7, "week": 4, "month": 6})
