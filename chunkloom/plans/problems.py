"""Queries of the general data-processing problems, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.model import table
from chunkloom.operators import intervals, orphans, packed_fields, rolling, seen_filter, snapshot_changes

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_fields.packed_entries(table(spark, sf, "archive_bookmarks"), table(spark, sf, "scheduled_tasks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(table(spark, sf, "archive_items"), table(spark, sf, "archives"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    records, seeds = seen_filter.arrivals_and_seeds(table(spark, sf, "chunk_arrivals"), table(spark, sf, "seed_chunks"))
    return seen_filter.seen_records(records, seeds).withColumnRenamed("record", "arrival_id")


def p3_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Derived and measured rates at three small widths and at the one p3_found uses."""
    records, seeds = seen_filter.arrivals_and_seeds(table(spark, sf, "chunk_arrivals"), table(spark, sf, "seed_chunks"))
    return seen_filter.seen_error_report(records, seeds, (20, 28, 36, None))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.job_periods(table(spark, sf, "job_execution_history"))


_REFERRING = ("archive_items", "archives", "verify_reports", "chunk_store", "seed_chunks")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, sf, t) for t in _REFERRING))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(*(table(spark, sf, t) for t in _REFERRING))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.job_rolling_totals(table(spark, sf, "job_execution_history"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_error_rates, p4_found, p5_found, p5_counts, p6_found)}

_ID = r"regexp_replace(lower(trim({}, E' \t\n\r')), '^(sha256:|0x)', '')"
_RUNS = """picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try_cast(end_time AS TIMESTAMPTZ) IS NOT NULL DESC, length(coalesce(end_time, '')) > 0 DESC, job_name DESC, start_time DESC, end_time DESC) AS rn
  FROM (SELECT DISTINCT * FROM job_execution_history)) WHERE rn = 1)"""

SQL: dict[str, str] = {
    "p2_found": f"""
WITH ids AS (SELECT DISTINCT archive_name, archive_time, repo_path FROM archives),
snaps AS (
  SELECT repo_path, archive_name, row_number() OVER (PARTITION BY repo_path ORDER BY archive_time, archive_name) AS seq
  FROM ids WHERE archive_name IN (SELECT archive_name FROM archive_items)),
listed AS (
  SELECT s.repo_path, s.seq, i.item_id, i.size, i.attrs.mtime AS mtime,
         array_to_string(list_filter(string_split(i.path, '/'), lambda x: x NOT IN ('', '.')), '/') AS path,
         list_filter(list_transform(coalesce(i.chunks, []), lambda x: {_ID.format("x")}), lambda x: x <> '') AS ids
  FROM archive_items i JOIN snaps s USING (archive_name)),
tree AS (SELECT repo_path, seq, path, arg_max(row(size, mtime, ids), item_id) AS v FROM listed GROUP BY ALL),
pairs AS (
  SELECT coalesce(a.repo_path, b.repo_path) AS repo_path, coalesce(b.seq, a.seq + 1) AS seq,
         coalesce(a.path, b.path) AS path, a.v AS av, b.v AS bv, a.seq AS aseq, b.seq AS bseq
  FROM tree a FULL JOIN tree b ON a.repo_path = b.repo_path AND a.path = b.path AND b.seq = a.seq + 1)
SELECT p.repo_path, s.archive_name, p.path,
       CASE WHEN aseq IS NULL THEN 'added' WHEN bseq IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs p JOIN snaps s ON s.repo_path = p.repo_path AND s.seq = p.seq
WHERE p.seq > 1 AND (aseq IS NULL OR bseq IS NULL OR av IS DISTINCT FROM bv)""",
    "p3_found": f"""
WITH a AS (
  SELECT DISTINCT arrival_id, {_ID.format("chunk_id")} AS k
  FROM chunk_arrivals WHERE arrival_id IS NOT NULL AND trim(chunk_id, E' \\t\\n\\r') <> ''),
f AS (SELECT k, min(arrival_id) AS first FROM a GROUP BY k),
s AS (SELECT DISTINCT {_ID.format("chunk_id")} AS k FROM seed_chunks)
SELECT a.arrival_id FROM a JOIN f USING (k) WHERE a.arrival_id > f.first OR k IN (SELECT k FROM s)""",
    "p4_found": f"""
WITH {_RUNS},
runs AS (SELECT job_name, epoch_us(try_cast(start_time AS TIMESTAMPTZ)) AS s, epoch_us(try_cast(end_time AS TIMESTAMPTZ)) AS e FROM picked),
ok AS (SELECT * FROM runs WHERE job_name IS NOT NULL AND s <= e),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY job_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM ok),
labelled AS (SELECT *, sum(opens) OVER (PARTITION BY job_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT job_name, min(s) AS start_us, max(e) AS end_us FROM labelled GROUP BY job_name, island)
SELECT job_name, 'period' AS kind, start_us, end_us FROM periods
UNION ALL
SELECT job_name, 'gap', prev, start_us FROM (SELECT *, lag(end_us) OVER (PARTITION BY job_name ORDER BY start_us) AS prev FROM periods) WHERE prev IS NOT NULL""",
    "p6_found": f"""
WITH {_RUNS},
runs AS (
  SELECT job_name, CAST(floor(epoch_us(try_cast(start_time AS TIMESTAMPTZ)) / 86400000000) AS BIGINT) AS d,
         greatest(coalesce(files_processed, 0), 0) AS f, greatest(coalesce(bytes_processed, 0), 0) AS b FROM picked),
daily AS (SELECT job_name, d, sum(f) AS f, sum(b) AS b FROM runs WHERE d IS NOT NULL AND job_name IS NOT NULL GROUP BY ALL),
days AS (SELECT job_name, unnest(generate_series(min(d), max(d))) AS d FROM daily GROUP BY job_name)
SELECT g.job_name, strftime(DATE '1970-01-01' + CAST(g.d AS INTEGER), '%Y-%m-%d') AS run_day,
       CAST(coalesce(sum(f) OVER w7, 0) AS BIGINT) AS files_7d, CAST(coalesce(sum(f) OVER w30, 0) AS BIGINT) AS files_30d,
       CAST(coalesce(sum(b) OVER w7, 0) AS BIGINT) AS bytes_7d, CAST(coalesce(sum(b) OVER w30, 0) AS BIGINT) AS bytes_30d
FROM days g LEFT JOIN daily d ON d.job_name = g.job_name AND d.d = g.d
WINDOW w7 AS (PARTITION BY g.job_name ORDER BY g.d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY g.job_name ORDER BY g.d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
}

_FOUND = f"""
WITH refs AS (
  SELECT 'archive_items.chunks' AS ref_field, CAST(item_id AS VARCHAR) AS ref_key, archive_time AS t, unnest(chunks) AS raw
  FROM archive_items LEFT JOIN (SELECT DISTINCT archive_name, archive_time FROM archives) USING (archive_name)
  UNION ALL SELECT 'archives.id', archive_name, archive_time, id FROM archives
  UNION ALL SELECT 'verify_reports.missing_chunks', CAST(report_id AS VARCHAR), report_time, unnest(missing_chunks) FROM verify_reports
  UNION ALL SELECT 'verify_reports.orphaned_chunks', CAST(report_id AS VARCHAR), report_time, unnest(orphaned_chunks) FROM verify_reports),
plain AS (
  SELECT DISTINCT ref_field, ref_key, t, {_ID.format("raw")} AS chunk_id FROM refs WHERE trim(raw, E' \\t\\n\\r') <> ''),
register AS (
  SELECT {_ID.format("chunk_id")} AS chunk_id, bool_or(deleted_at IS NULL) AS live, min(stored_at) AS earliest
  FROM (SELECT chunk_id, stored_at, deleted_at FROM chunk_store UNION ALL SELECT chunk_id, stored_at, NULL FROM seed_chunks) GROUP BY 1),
judged AS (
  SELECT p.*, CASE WHEN r.live IS NULL OR length(p.chunk_id) <> 64 THEN 'absent' WHEN NOT live THEN 'deleted' WHEN earliest > t THEN 'later' END AS reason
  FROM plain p LEFT JOIN register r USING (chunk_id)),
found AS (SELECT ref_field, ref_key, chunk_id, reason, strftime(t, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL)"""
SQL["p5_found"] = _FOUND + " SELECT * FROM found"
SQL["p5_counts"] = _FOUND + " SELECT ref_field, period, reason, count(*) AS n_references, count(DISTINCT chunk_id) AS n_ids FROM found GROUP BY ALL"
