"""The operational tables as parquet folders: creation, migration of older files, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chunkloom.sources import storage

#: Columns of each table in order (fixed values); those added later come last and may be missing in older files.
TABLES = {
    "repo_bookmarks": "id bigint, uuid string, name string, path string, repo_type string",
    "archive_bookmarks": "id bigint, repo_name string, repo_path string, compression string, redundancy string, use_custom_name boolean, archive_name string, comment_text string, tags string, paths string",
    "scheduled_tasks": "id bigint, task_name string, repo_name string, repo_path string, archive_name string, paths_to_backup string, compression string, comment_text string, tags string, schedule_type string, weekday int, day_of_month int, run_hour int, run_minute int, run_on_boot_if_missed boolean, execution_count int, active boolean, last_run string, repo_type string",
    "job_execution_history": "id bigint, job_name string, start_time string, end_time string, status string, error_message string, files_processed bigint, bytes_processed bigint, archive_name string",
    "job_state": "job_name string, last_run string, last_success string, last_failure string, consecutive_failures bigint, last_error string, last_failure_alert string, last_missed_alert string",
}
#: Values of columns that older files lack (fixed values).
DEFAULTS = {"run_on_boot_if_missed": False, "execution_count": 0, "active": True, "repo_type": "local", "use_custom_name": False}


def create(spark: SparkSession, folder: str) -> None:
    """Make the tables that are not there yet."""
    for name, schema in TABLES.items():
        if not storage.exists(spark, f"{folder}/{name}"):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")


def migrated(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with exactly the table's columns: missing ones get their default or null, others are left out."""
    schema = StructType.fromDDL(TABLES[name])
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.coalesce(F.col(have[f.name]), F.lit(DEFAULTS.get(f.name))) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return migrated(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), name)


def replace(rows: DataFrame, folder: str, name: str) -> None:
    """Write the table's next state beside the old one and swap them, as the old one may be read for it."""
    place = f"{folder}/{name}"
    migrated(rows, name).write.mode("overwrite").parquet(place + ".next")
    storage.swap_in(rows.sparkSession, place + ".next", place)


def save_job_states(states: DataFrame, folder: str) -> None:
    """Write folded job states to their table: times as RFC 3339 text, alert times kept from the table."""
    spark = states.sparkSession
    old = load(spark, folder, "job_state").select("job_name", "last_failure_alert", "last_missed_alert")

    def text(column: str) -> Column:
        return F.date_format(F.timestamp_micros(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    rows = states.join(old, "job_name", "left").select("job_name", *(text(f"last_{k}_us").alias(f"last_{k}") for k in ("run", "success", "failure")), "consecutive_failures", "last_error", "last_failure_alert", "last_missed_alert")
    replace(rows, folder, "job_state")
