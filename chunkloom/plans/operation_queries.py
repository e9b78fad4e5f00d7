"""Queries of jobs, tables, scalar functions, sources, chunking and streams over whole tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import chunking, cron
from chunkloom.functions import scalars as s
from chunkloom.model import table
from chunkloom.operators import jobs, tables
from chunkloom.plans import inputs
from chunkloom.session import cut
from chunkloom.sources import operational
from chunkloom.sources.places import place_columns
from chunkloom.streaming.folds import job_state_stream, scan_cache_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_RUNS = """
WITH picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try_cast(end_time AS TIMESTAMPTZ) IS NOT NULL DESC, length(coalesce(end_time, '')) > 0 DESC, job_name DESC, start_time DESC, end_time DESC, status DESC) AS rn
  FROM (SELECT DISTINCT * FROM job_execution_history)) WHERE rn = 1),
runs AS (
  SELECT id, job_name, epoch_us(try_cast(start_time AS TIMESTAMPTZ)) AS start_us, status, status = 'success' AS ok, error_message
  FROM picked WHERE try_cast(start_time AS TIMESTAMPTZ) IS NOT NULL AND status IN ('success', 'failed') AND job_name IS NOT NULL),
islands AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY job_name ORDER BY start_us, id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
streaks AS (SELECT id, job_name, start_us, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY job_name, island ORDER BY start_us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM islands),
states AS (
  SELECT r.job_name, max(r.start_us) AS last_run_us, max(r.start_us) FILTER (ok) AS last_success_us, max(r.start_us) FILTER (NOT ok) AS failed_us, arg_max(streak, (r.start_us, r.id)) AS consecutive_failures, arg_max({'e': error_message}, (r.start_us, r.id)) FILTER (NOT ok) AS err
  FROM runs r JOIN streaks USING (id) GROUP BY 1)
"""
_STATE = _RUNS + "SELECT job_name, last_run_us, last_success_us, CASE WHEN consecutive_failures > 0 THEN failed_us END AS last_failure_us, consecutive_failures, CASE WHEN consecutive_failures > 0 THEN err.e END AS last_error FROM states"
_TASKS = "WITH t AS (SELECT DISTINCT * FROM scheduled_tasks) "


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with the SQL that gives the same result."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job_execution_history")


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scheduled_tasks").dropDuplicates(["id"])


# --- jobs ------------------------------------------------------------------------------------


@query(_RUNS + "SELECT job_name, last_run_us, last_success_us, failed_us AS last_failure_us FROM states")
def job_last_state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.last_states(jobs.runs(_history(spark, sf)))


@query(_RUNS + "SELECT * FROM streaks")
def failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.failure_streaks(jobs.runs(_history(spark, sf)))


@query(_STATE)
def job_state(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_states(jobs.runs(_history(spark, sf)))


@query(_STATE)
def stream_job_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same state, folded from a stream of the history files."""
    return job_state_stream(spark, f"{sf}/job_execution_history.parquet")


@query(_RUNS + "SELECT * FROM (SELECT job_name, id, start_time, status, CAST(row_number() OVER (PARTITION BY job_name ORDER BY start_time DESC, id DESC) AS INTEGER) AS n FROM picked WHERE trim(start_time) <> '') WHERE n <= 20")
def history_recent(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.recent_history(_history(spark, sf), 20)


@query(
    _RUNS
    + """, span AS (SELECT job_name, (min(start_us) // 3600000000 + 1) AS a, max(start_us) // 3600000000 AS b FROM runs GROUP BY 1),
slots AS (SELECT job_name, unnest(generate_series(a, b)) AS h FROM span)
SELECT job_name, CAST(h * 3600000000 AS BIGINT) AS slot_us FROM slots s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.job_name = s.job_name AND r.start_us // 3600000000 = s.h)"""
)
def missed_runs(spark: SparkSession, sf: str) -> DataFrame:
    ended = jobs.runs(_history(spark, sf))
    return jobs.missed_runs(ended, jobs.expected_hours(ended))


@query(
    _RUNS
    + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY start_us, id) AS n FROM streaks WHERE streak >= 2),
fold AS (
  WITH RECURSIVE f AS (
    SELECT id, job_name, start_us, streak, n, true AS fired, start_us AS last FROM ordered WHERE n = 1
    UNION ALL
    SELECT o.id, o.job_name, o.start_us, o.streak, o.n, o.start_us - f.last >= 86400000000, CASE WHEN o.start_us - f.last >= 86400000000 THEN o.start_us ELSE f.last END
    FROM f JOIN ordered o ON o.job_name = f.job_name AND o.n = f.n + 1)
  SELECT * FROM f)
SELECT id, job_name, start_us, streak FROM fold WHERE fired"""
)
def alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts from the second failure in a row on, not twice within a day."""
    return jobs.alerts(jobs.failure_streaks(jobs.runs(_history(spark, sf))), threshold=2, cooldown_s=86_400)


@query(_TASKS + "SELECT id, CAST(n + 1 AS INTEGER) AS attempt, CASE n WHEN 0 THEN 30.0 ELSE least(30.0 * power(2.0, n), 200.0) END AS delay_s FROM t, LATERAL (SELECT unnest(range(5)) AS n)")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Delays of five retries of each task: 30 s, doubled up to 200 s."""
    rows = _tasks(spark, sf).select("id", F.posexplode(jobs.retry_delays(30.0, 2.0, 200.0, 5)).alias("n", "delay_s"))
    return rows.select("id", (F.col("n") + 1).alias("attempt"), "delay_s")


@query(_TASKS + "SELECT id, task_name, schedule_type FROM t WHERE active AND schedule_type <> 'Manual'")
def active_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).where(F.col("active") & (F.col("schedule_type") != "Manual")).select("id", "task_name", "schedule_type")


_ZONE = "Europe/Berlin"
_SHIFT = """, l AS (
  SELECT *, CASE schedule_type
    WHEN 'Weekly' THEN make_timestamp(2024, 6, 12, run_hour, run_minute, 0) + to_days(CAST((weekday - 2 + 7) % 7 AS INTEGER))
    WHEN 'Monthly' THEN make_timestamp(2024, 6, least(greatest(day_of_month, 1), 30), run_hour, run_minute, 0)
    ELSE make_timestamp(2024, 6, 12, run_hour, run_minute, 0) END AS local_time FROM t),
u AS (SELECT *, timezone('UTC', timezone('Europe/Berlin', local_time)) AS utc FROM l)
SELECT id, CASE schedule_type WHEN 'Hourly' THEN '0 ' || run_minute || ' * * * *' WHEN 'Daily' THEN '0 ' || minute(utc) || ' ' || hour(utc) || ' * * *'
  WHEN 'Weekly' THEN '0 ' || minute(utc) || ' ' || hour(utc) || ' * * ' || dayofweek(utc) WHEN 'Monthly' THEN '0 ' || minute(utc) || ' ' || hour(utc) || ' ' || day(utc) || ' * *' WHEN 'Manual' THEN '0 0 0 1 1 ? 2099' END AS cron FROM u"""


def _cron(today: dt.date, zone: str) -> Column:
    return cron.schedule_cron("schedule_type", F.col("run_minute"), F.col("run_hour"), F.col("weekday"), F.col("day_of_month"), F.lit(today), zone)


@query(_TASKS + _SHIFT)
def schedule_cron(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules in UTC of tasks set in local time, as of a Wednesday in summer."""
    return _tasks(spark, sf).select("id", _cron(dt.date(2024, 6, 12), _ZONE).alias("cron"))


_WEEK = (dt.datetime(2024, 5, 31, 12), dt.datetime(2024, 6, 7, 12))


@query(
    _TASKS
    + """, m AS (SELECT unnest(generate_series(TIMESTAMP '2024-05-31 12:01:00', TIMESTAMP '2024-06-07 12:00:00', INTERVAL 1 MINUTE)) AS slot)
SELECT task_name AS name, slot FROM t JOIN m ON t.run_minute = minute(slot)
  AND (schedule_type = 'Hourly' OR (run_hour = hour(slot) AND (schedule_type = 'Daily' OR (schedule_type = 'Weekly' AND (t.weekday + 1) % 7 = dayofweek(slot)) OR (schedule_type = 'Monthly' AND least(t.day_of_month, 31) = day(slot)))))"""
)
def expected_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All times of a week at which the tasks' schedules fall due."""
    rows = _tasks(spark, sf).select(F.col("task_name").alias("name"), _cron(dt.date(2024, 5, 31), "UTC").alias("cron"))
    return cron.expand(rows, *_WEEK)


_LAST = "coalesce(try_cast(last_run AS TIMESTAMPTZ), try_strptime(last_run, '%H:%M %d.%m.%Y'))"


@query(_TASKS + f"SELECT id, epoch_us(CASE WHEN last_run LIKE '%T%' THEN try_cast(last_run AS TIMESTAMPTZ) ELSE CAST(try_strptime(last_run, '%H:%M %d.%m.%Y') AS TIMESTAMPTZ) END) AS last_run_us FROM t")
def task_last_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Last runs in both of their writings; null where there is none or it can't be read."""
    from chunkloom.model import micros, rfc3339

    parts = F.regexp_replace("last_run", r"\A(\d\d:\d\d) (\d\d)\.(\d\d)\.(\d{4})\z", "$4-$3-$2T$1:00Z")
    return _tasks(spark, sf).select("id", micros(rfc3339(parts)).alias("last_run_us"))


@query(_TASKS + "SELECT repo_type, id, task_name, CAST(row_number() OVER (PARTITION BY repo_type ORDER BY make_timestamp(2024, 6, 1, run_hour, run_minute, 0), execution_count, task_name) AS INTEGER) AS n_in_queue FROM t WHERE active AND schedule_type <> 'Manual'")
def next_job(spark: SparkSession, sf: str) -> DataFrame:
    """Order in which tasks of each kind of place fall due, ties by executions so far."""
    rows = _tasks(spark, sf).where(F.col("active") & (F.col("schedule_type") != "Manual"))
    rows = rows.withColumns({"next_run": F.make_timestamp(F.lit(2024), F.lit(6), F.lit(1), F.col("run_hour"), F.col("run_minute"), F.lit(0)), "priority": F.col("execution_count")})
    return jobs.queue(rows, ["repo_type"]).select("repo_type", "id", "task_name", "n_in_queue")


@query(_TASKS + ", b AS (SELECT DISTINCT id AS bookmark_id, repo_path, redundancy FROM archive_bookmarks) SELECT t.id, t.task_name, b.bookmark_id, b.redundancy FROM t LEFT JOIN b USING (repo_path)")
def job_bookmark_lookup(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "archive_bookmarks").dropDuplicates(["repo_path"]).select("repo_path", F.col("id").alias("bookmark_id"), "redundancy")
    return _tasks(spark, sf).join(marks, "repo_path", "left").select("id", "task_name", "bookmark_id", "redundancy")


@query("WITH h AS (SELECT DISTINCT job_name FROM job_execution_history) SELECT job_name FROM h WHERE job_name IS NOT NULL AND NOT contains(job_name, '/') AND job_name NOT IN (SELECT task_name FROM scheduled_tasks)")
def job_config_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs with runs that no task names."""
    return tables.orphans(_history(spark, sf), "job_name", table(spark, sf, "scheduled_tasks"), "task_name")


@query(_TASKS + "SELECT repo_name, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1")
def job_config_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return tables.duplicates(_tasks(spark, sf), "repo_name")


@query(
    """
WITH old AS (SELECT DISTINCT repo_path, repo_name, compression, tags FROM archive_bookmarks),
new AS (SELECT repo_path, arg_max({'n': repo_name, 'c': compression, 't': tags}, id) AS v FROM (SELECT DISTINCT * FROM scheduled_tasks) GROUP BY 1)
SELECT * FROM old WHERE repo_path NOT IN (SELECT repo_path FROM new) UNION ALL SELECT repo_path, v.n, v.c, v.t FROM new"""
)
def bookmark_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Bookmarks after their repositories' tasks are written over them: all columns are replaced."""
    old = table(spark, sf, "archive_bookmarks").dropDuplicates(["repo_path"]).select("repo_path", "repo_name", "compression", "tags")
    new = _tasks(spark, sf).select("repo_path", "repo_name", "compression", "tags", "id")
    return tables.upsert(old, new, "repo_path", F.col("id"))


@query("WITH t AS (SELECT DISTINCT id, task_name, execution_count FROM scheduled_tasks), n AS (SELECT job_name, count(*) AS n FROM (SELECT DISTINCT id, job_name FROM job_execution_history) GROUP BY 1) SELECT id, task_name, CAST(execution_count + coalesce(n, 0) AS BIGINT) AS execution_count FROM t LEFT JOIN n ON job_name = task_name")
def execution_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks' counts raised by each run of the history."""
    rows = _tasks(spark, sf).select("id", "task_name", F.col("execution_count").cast("bigint").alias("execution_count"))
    done = _history(spark, sf).select("id", "job_name").distinct().select(F.col("job_name").alias("task_name"))
    return tables.increment(rows, done, "task_name", "execution_count").select("id", "task_name", "execution_count")


@query(inputs.SQL + ", newest AS (SELECT repo_path, arg_max(archive_name, (archive_time, archive_name)) AS archive_name FROM arcs GROUP BY 1) SELECT archive_name, repo_path, archive_time FROM arcs WHERE archive_name NOT IN (SELECT archive_name FROM newest)")
def archive_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Archives after the newest of each repository is deleted; items and chunks stay until a sweep."""
    from chunkloom.operators.catalog import latest_archive

    rows = inputs.archives(spark, sf).select("archive_name", "repo_path", "archive_time")
    return tables.delete(rows, latest_archive(rows), "archive_name")


@query("SELECT DISTINCT id, repo_name, repo_path, compression, redundancy, use_custom_name, archive_name, comment_text, tags, paths FROM archive_bookmarks")
def bookmarks_list(spark: SparkSession, sf: str) -> DataFrame:
    return operational.migrated(table(spark, sf, "archive_bookmarks"), "archive_bookmarks").distinct()


@query(_TASKS + "SELECT * FROM t")
def tasks_list(spark: SparkSession, sf: str) -> DataFrame:
    return operational.migrated(table(spark, sf, "scheduled_tasks"), "scheduled_tasks").distinct()


@query(
    _TASKS
    + """, m AS (SELECT unnest(generate_series(TIMESTAMP '2024-06-01 06:01:00', TIMESTAMP '2024-06-01 12:00:00', INTERVAL 1 MINUTE)) AS slot),
r AS (SELECT id, task_name AS name, min(slot) AS slot, any_value(epoch_us(CASE WHEN last_run LIKE '%T%' THEN try_cast(last_run AS TIMESTAMPTZ) ELSE CAST(try_strptime(last_run, '%H:%M %d.%m.%Y') AS TIMESTAMPTZ) END)) AS last_run_us
  FROM t JOIN m ON run_minute = minute(slot) AND (schedule_type = 'Hourly' OR (run_hour = hour(slot) AND (schedule_type = 'Daily' OR (schedule_type = 'Weekly' AND (weekday + 1) % 7 = dayofweek(slot)) OR (schedule_type = 'Monthly' AND least(greatest(day_of_month, 1), 30) = day(slot)))))
  WHERE run_on_boot_if_missed AND execution_count = 0 GROUP BY 1, 2)
SELECT name, epoch_us(slot) AS slot_us FROM r WHERE last_run_us IS NULL OR last_run_us < epoch_us(slot)"""
)
def just_missed(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of all schedules, to be made up for and not run before, whose time within six hours before noon their last run does not reach."""
    noon = dt.datetime(2024, 6, 1, 12)
    asked = _tasks(spark, sf).where("run_on_boot_if_missed").withColumn("name", F.col("task_name"))
    slots = cron.expand(asked.select("name", _cron(noon.date(), "UTC").alias("cron")), noon - dt.timedelta(hours=6), noon).select("name", F.unix_micros(F.col("slot").cast("timestamp")).alias("slot_us"))
    last = task_last_runs(spark, sf).join(asked.select("id", "name"), "id")
    known = asked.where(F.coalesce("execution_count", F.lit(0)) > 0)
    return jobs.just_missed(last, slots, 1717243200_000000, 6 * 3600, known)


@query()
def missed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts for the hours that jobs missed, at most one a job within three hours."""
    ended = jobs.runs(_history(spark, sf))
    return jobs.missed_alerts(jobs.missed_runs(ended, jobs.expected_hours(ended)), 3 * 3600)


# --- scalar functions ------------------------------------------------------------------------

_UNIT = "CASE WHEN {x} >= 1099511627776 AND {top} THEN printf('%.{d}f{T}', {x} / 1099511627776.0) WHEN {x} >= 1073741824 THEN printf('%.{d}f{G}', {x} / 1073741824.0) WHEN {x} >= 1048576 THEN printf('%.{d}f{M}', {x} / 1048576.0) WHEN {x} >= 1024 THEN printf('%.{d}f{K}', {x} / 1024.0) ELSE {x} || '{B}' END"


def _unit(x: str, d: int, letters: str, gap: str, top: bool = True) -> str:
    b = letters
    names = {k: gap + k + b for k in "TGMK"} | {"B": gap + "B"}
    return _UNIT.format(x=x, d=d, top="true" if top else "false", **names)


@query(
    "WITH v AS (SELECT DISTINCT size AS x FROM archive_items UNION SELECT DISTINCT bytes_processed FROM job_execution_history WHERE bytes_processed >= 0 UNION SELECT DISTINCT bytes_verified FROM verify_reports) SELECT x, "
    + ", ".join(f"{_unit('x', *a)} AS {n}" for n, a in (("human", (1, "B", " ")), ("in_list", (1, "", "")), ("in_search", (1, "", "", False)), ("in_diff", (2, "B", " "))))
    + ", '-' || "
    + _unit("x", 2, "B", " ")
    + " AS lost FROM v WHERE x > 0"
)
def format_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "archive_items").select(F.col("size").alias("x"))
    for name, column in (("job_execution_history", "bytes_processed"), ("verify_reports", "bytes_verified")):
        sizes = sizes.unionByName(table(spark, sf, name).select(F.col(column).alias("x")))
    rows = sizes.where(F.col("x") > 0).distinct()
    return rows.select("x", s.human_bytes("x").alias("human"), s.list_size("x").alias("in_list"), s.search_size("x").alias("in_search"), s.diff_size("x").alias("in_diff"), s.signed_size(-F.col("x")).alias("lost"))


_BIT = " || ".join(f"CASE WHEN m & {1 << (8 - i)} <> 0 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9))


@query(f"WITH v AS (SELECT DISTINCT item_type AS t, attrs.mode AS m FROM archive_items) SELECT t AS item_type, m AS mode, CASE t WHEN 'File' THEN '-' WHEN 'Directory' THEN 'd' WHEN 'Symlink' THEN 'l' WHEN 'Hardlink' THEN 'h' WHEN 'Fifo' THEN 'p' WHEN 'Socket' THEN 's' END AS letter, {_BIT} AS mode_text FROM v")
def mode_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "archive_items").select("item_type", F.col("attrs.mode").alias("mode")).distinct()
    return rows.select("item_type", "mode", s.type_letter("item_type", "-").alias("letter"), s.mode_text("mode").alias("mode_text"))


@query("SELECT DISTINCT path, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS relative_path FROM (SELECT path FROM archive_items UNION ALL SELECT symlink_target FROM archive_items) WHERE path IS NOT NULL")
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "archive_items")
    rows = items.select("path").unionByName(items.select(F.col("symlink_target").alias("path"))).where(F.col("path").isNotNull()).distinct()
    return rows.select("path", s.relative_path("path").alias("relative_path"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS entries FROM (SELECT DISTINCT id, tags FROM scheduled_tasks) WHERE trim(tags) <> ''")
def tags_split(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).select("id", F.array_join(s.csv_list("tags"), "|").alias("entries")).where(F.col("entries").isNotNull())


@query("SELECT id, unnest(from_json(paths, '[\"VARCHAR\"]')) AS entry FROM (SELECT DISTINCT id, paths FROM archive_bookmarks) WHERE paths LIKE '[%'")
def bookmark_paths(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "archive_bookmarks").where(F.col("paths").startswith("[")).select("id", "paths").distinct()
    return marks.select("id", F.explode(s.path_list("paths")).alias("entry"))


@query("SELECT DISTINCT attrs.mtime AS mtime, strftime(make_timestamp(attrs.mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS shown FROM archive_items")
def epoch_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "archive_items").select(F.col("attrs.mtime").alias("mtime")).distinct().select("mtime", s.epoch_text("mtime").alias("shown"))


@query("WITH v AS (SELECT DISTINCT attrs.ctime AS ctime FROM archive_items) SELECT ctime, strftime(make_timestamp(ctime * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS header, ctime AS epoch FROM v")
def http_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as HTTP headers and read again."""
    rows = table(spark, sf, "archive_items").select(F.col("attrs.ctime").alias("ctime")).distinct()
    rows = rows.select("ctime", F.date_format(F.timestamp_seconds("ctime"), "E, dd MMM yyyy HH:mm:ss 'GMT'").alias("header"))
    return rows.withColumn("epoch", s.http_date("header"))


@query(
    """
WITH v AS (SELECT DISTINCT compression AS c, redundancy AS r FROM archive_bookmarks)
SELECT c AS compression, r AS redundancy, CASE lower(trim(split_part(c, ',', 1))) WHEN 'none' THEN CASE WHEN c = 'none' THEN 'zstd' ELSE 'none' END WHEN 'deflate' THEN 'zlib' WHEN 'lz4' THEN 'lz4' WHEN 'zlib' THEN 'zlib' WHEN 'lzma' THEN 'lzma' WHEN 'xz' THEN 'xz' ELSE 'zstd' END AS algorithm,
       CAST(CASE WHEN coalesce(c, '') IN ('', 'none') THEN 6 WHEN try_cast(split_part(c, ',', 2) AS UTINYINT) <= 9 THEN try_cast(split_part(c, ',', 2) AS UTINYINT) WHEN try_cast(split_part(c, ',', 2) AS UTINYINT) > 9 THEN 6 ELSE 3 END AS INTEGER) AS level,
       CASE r WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 0 END AS shards,
       CAST(CASE r WHEN 'low' THEN 80 + 62501 WHEN 'medium' THEN 80 + 125002 WHEN 'high' THEN 80 + 250004 ELSE 0 END AS BIGINT) AS parity_of_1000001
FROM v"""
)
def compression_specs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "archive_bookmarks").select("compression", "redundancy").distinct()
    rows = rows.withColumn("spec", s.compression_spec("compression")).withColumn("shards", F.coalesce(s.parity_shards("redundancy"), F.lit(0)))
    return rows.select("compression", "redundancy", "spec.algorithm", "spec.level", "shards", s.parity_bytes(F.lit(1_000_001), F.col("shards")).alias("parity_of_1000001"))


@query(
    r"""
WITH v AS (SELECT DISTINCT repo_path AS p FROM scheduled_tasks UNION SELECT DISTINCT repo_path FROM archive_bookmarks)
SELECT p AS repo_path, CASE WHEN p LIKE 's3://%' THEN 's3' WHEN p LIKE 'dav://%' THEN 'webdav' ELSE 'local' END AS kind,
       CASE WHEN p LIKE '%://%' THEN split_part(split_part(p, '://', 2), '/', 1) ELSE '' END AS host,
       CASE WHEN p LIKE 's3://%' THEN trim(regexp_replace(p, '^s3://[^/]*', ''), '/') WHEN p LIKE 'dav://%' THEN regexp_replace(p, '^dav://[^/]*', '') ELSE p END AS root
FROM v"""
)
def repository_places(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "scheduled_tasks").select("repo_path").unionByName(table(spark, sf, "archive_bookmarks").select("repo_path")).distinct()
    return rows.select("repo_path", place_columns("repo_path").alias("p")).select("repo_path", "p.kind", "p.host", "p.root")


@query(_TASKS + "SELECT id, replace(replace(lower(repo_name || '_' || archive_name || '_' || schedule_type || '_' || printf('%02d', run_hour) || '_' || printf('%02d', run_minute)), ' ', '_'), '\t', '\t') AS task_name, replace(replace(replace(archive_name, '{hostname}', repo_name), '{now}', '2024-06-01_00:00:00'), '{now:%Y}', '2024') AS next_archive FROM t")
def task_names(spark: SparkSession, sf: str) -> DataFrame:
    t = _tasks(spark, sf)
    now = F.lit(dt.datetime(2024, 6, 1)).cast("timestamp_ntz")
    return t.select("id", s.task_name(F.col("repo_name"), F.col("archive_name"), F.col("schedule_type"), F.col("run_hour"), F.col("run_minute")).alias("task_name"), s.archive_name("archive_name", F.col("repo_name"), now).alias("next_archive"))


@query(
    _TASKS
    + """SELECT id, CAST(DATE '2024-02-14' + CAST((weekday - 2 + 7) % 7 AS INTEGER) AS VARCHAR) AS weekly_day,
       CAST(DATE '2024-02-01' + CAST(least(day_of_month, 29) - 1 AS INTEGER) AS VARCHAR) AS monthly_day FROM t"""
)
def schedule_days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit(dt.date(2024, 2, 14))
    return _tasks(spark, sf).select("id", s.next_weekday(day, F.col("weekday")).cast("string").alias("weekly_day"), s.day_in_month(day, F.col("day_of_month")).cast("string").alias("monthly_day"))


@query("SELECT DISTINCT size, CAST(size AS VARCHAR) || 'B' AS written, size AS parsed, CAST(size * 1024 AS BIGINT) AS parsed_k FROM archive_items")
def parse_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "archive_items").select("size").distinct().withColumn("written", F.concat(F.col("size").cast("string"), F.lit("B")))
    return rows.select("size", "written", s.parse_size("written").alias("parsed"), s.parse_size(F.concat(F.lit(" "), F.col("size").cast("string"), F.lit("kb"))).alias("parsed_k"))


@query(
    """SELECT DISTINCT path, CASE WHEN d = '' THEN '/' ELSE d END AS decoded FROM (
  SELECT path, rtrim(array_to_string(list_transform(regexp_extract_all(hex(encode(split_part(path, '?', 1))), '..'), lambda h: chr(CAST('0x' || h AS INTEGER))), ''), '/') AS d FROM archive_items WHERE path IS NOT NULL)"""
)
def percent_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with their blanks and brackets escaped, decoded again: beyond ASCII as Latin-1."""
    rows = table(spark, sf, "archive_items").select("path").where(F.col("path").isNotNull()).distinct()
    return rows.select("path", s.normal_href(F.replace("path", F.lit(" "), F.lit("%20"))).alias("decoded"))


# --- chunking, compression -------------------------------------------------------------------


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(table(spark, sf, "documents"), "doc_id", "text", 256, 1024, 4096)


@query()
def cdc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Content-defined chunks of all texts, with sizes fit for texts."""
    return _chunks(spark, sf)


@query("SELECT doc_id, CAST(0 AS INTEGER) AS pos, CAST(0 AS BIGINT) AS start, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS chunk_id FROM documents WHERE length(text) > 0")
def cdc_small_files(spark: SparkSession, sf: str) -> DataFrame:
    """With the sizes of the smallest profile each text is one chunk, whose id is its hash."""
    return chunking.chunk(table(spark, sf, "documents"), "doc_id", "text", *s.profile_sizes("1M"))


@query()
def cdc_overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.overlap(_chunks(spark, sf))


@query()
def compress_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.compression_stats(chunking.compressed_sizes(table(spark, sf, "documents"), "doc_id", "text", "zstd"))


# --- streams ---------------------------------------------------------------------------------


@query(
    inputs.SQL
    + inputs.SCANS_SQL
    + """, ever AS (SELECT repo_path, path, max(seq) AS seq, arg_max(size, seq) AS size, arg_max(mtime, seq) AS mtime, any_value(n_snapshots) AS n FROM scans GROUP BY 1, 2)
SELECT repo_path, path, size, mtime, CAST(CASE WHEN seq = n - 1 THEN n - 1 ELSE seq + 1 END AS BIGINT) AS cached_at, seq < n - 1 AS deleted FROM ever"""
)
def stream_scan_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache after all snapshots of each tree went through a stream as scans, in order.

    Entries seen in a scan carry its number; a tombstone the number of the scan that missed it.
    """
    scans = cut(inputs.scans(spark, sf).withColumn("scanned_at", F.col("seq").cast("bigint")))
    last = scans.agg(F.max("seq").alias("n")).first()["n"]
    return scan_cache_stream(spark, [scans.where(F.col("seq") == n) for n in range(-1 if last is None else last + 1)])
