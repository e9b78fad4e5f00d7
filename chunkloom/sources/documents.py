"""Snapshot documents, pattern files, job settings and their checks; JSON and text sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import cron
from chunkloom.functions.patterns import Rule, parse_rules
from chunkloom.functions.scalars import epoch_text, list_size, mode_text, type_letter
from chunkloom.operators.tables import insert_new
from chunkloom.sources import storage

SNAPSHOT = "id string, name string, time timestamp, root_tree string, hostname string, username string, cmdline array<string>, comment string, tags array<string>"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots of all ``*.json`` documents of a folder, one document a file; unreadable ones are left out."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return rows.where(F.col("name").isNotNull())


def manifest(snapshots: DataFrame) -> DataFrame:
    """(archive_name, id, archive_time, hostname, username, comment_text, tags) in order of time and name."""
    return snapshots.select(F.col("name").alias("archive_name"), "id", F.col("time").alias("archive_time"), "hostname", "username", F.col("comment").alias("comment_text"), "tags").orderBy("archive_time", "archive_name")


def valid_manifest(rows: DataFrame, version: str = "version") -> DataFrame:
    """``rows`` with ``is_valid``: a manifest is valid if its version can be read and is not 0."""
    return rows.withColumn("is_valid", F.coalesce(F.col(version) != 0, F.lit(False)))


def commit_archive(items: DataFrame, snapshot: DataFrame, folder: str) -> None:
    """Append an archive: its items first, then its snapshot, whose presence commits it.

    Raises if a snapshot of that name is there. Readers go from snapshots to items, so items
    of a failed commit are never seen.
    """
    spark = items.sparkSession
    if storage.exists(spark, f"{folder}/snapshots"):
        insert_new(spark.read.parquet(f"{folder}/snapshots").select("archive_name"), snapshot.select("archive_name"), "archive_name")
    items.write.mode("append").partitionBy("archive_name").parquet(f"{folder}/items")
    snapshot.write.mode("append").parquet(f"{folder}/snapshots")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Exclusion rules of a pattern file, in the order of its lines."""
    return parse_rules(spark.read.text(path, wholetext=True).first()["value"])


def read_jobs(path: str) -> dict:
    """Job settings of a YAML file."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def job_faults(settings: dict) -> list[str]:
    """What is wrong with job settings: schedules that can't be read, repositories that no name or place gives, names used twice."""
    faults, repos = [], [r.get("name") for r in settings.get("repositories", [])]
    jobs = settings.get("jobs", [])
    for job in jobs:
        try:
            cron.parse(str(job.get("schedule", "")))
        except ValueError as e:
            faults.append(f"job {job.get('name')}: {e}")
        repo = str(job.get("repository", ""))
        if repo not in repos and not repo.startswith((".", "/", "~")) and "://" not in repo and "/" not in repo:
            faults.append(f"job {job.get('name')}: unknown repository {repo}")
    for kind, names in (("job", [j.get("name") for j in jobs]), ("repository", repos)):
        faults += [f"{kind} {n} is named twice" for n in dict.fromkeys(names) if names.count(n) > 1]
    return faults


def to_json_lines(rows: DataFrame) -> DataFrame:
    """(json): one document per row, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def listing(items: DataFrame, layout: str = "long") -> DataFrame:
    """(line): items as lines of a list. ``short`` is the path alone; ``long`` has type, mode, size and time before it, and a link's target behind it."""
    if layout == "short":
        return items.select(F.col("path").alias("line"))
    target = F.coalesce("symlink_target", "hardlink_target")
    head = F.concat(type_letter("item_type", "-"), mode_text(F.coalesce("attrs.mode", F.lit(0))))
    size, time = F.lpad(list_size(F.coalesce("size", F.lit(0))), 10, " "), epoch_text(F.coalesce("attrs.mtime", F.lit(0)), "yyyy-MM-dd HH:mm")
    return items.select(F.concat_ws(" ", head, size, time, "path", F.when(target.isNotNull(), F.concat(F.lit("-> "), target))).alias("line"))


def report(rows: DataFrame, most: int = 20) -> str:
    """The first rows as text; says how many more there are."""
    columns, shown, n = rows.columns, rows.limit(most).collect(), rows.count()
    lines = ["  ".join(columns)] + ["  ".join("" if v is None else str(v) for v in r) for r in shown]
    return "\n".join(lines + ([f"… and {n - most} more"] if n > most else []))
