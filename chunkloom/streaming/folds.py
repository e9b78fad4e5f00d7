"""Micro-batches folded into versioned state tables in the shared folder.

The state of a stream is a parquet table per epoch. An epoch reads the version before it and
writes its own, so a repeated epoch gives the same version and a lost executor costs one task.
Batches are folded with the same set operators as whole tables: no per-key Python state, no
group that has to fit into a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators import jobs, sync
from chunkloom.session import shared_dir
from chunkloom.sources import storage

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class FoldedTable:
    """State of a stream: ``fold(state, batch)`` gives the next version.

    State and progress lie in ``folder``, so a stream goes on there after its driver ended; without one they
    get a folder of their own. The last ``KEPT`` versions stay, as an epoch may be repeated.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, schema: str, fold: Fold, name: str, folder: str | None = None) -> None:
        self.spark, self.schema, self.fold = spark, schema, fold
        self.folder = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def epochs(self) -> list[int]:
        """Epochs whose version was written to its end, in order."""
        found = sorted(int(n) for n in storage.children(self.spark, f"{self.folder}/state") if n.isdigit())
        return [n for n in found if storage.exists(self.spark, f"{self.folder}/state/{n}/_SUCCESS")]

    def version(self, epoch: int) -> DataFrame:
        if epoch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state/{epoch}")

    def take(self, batch: DataFrame, epoch: int) -> None:
        before = [n for n in self.epochs() if n < epoch]
        self.fold(self.version(before[-1] if before else -1), batch).write.mode("overwrite").parquet(f"{self.folder}/state/{epoch}")
        for n in before[: max(len(before) + 1 - self.KEPT, 0)]:
            storage.delete(self.spark, f"{self.folder}/state/{n}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Fold all that is there, and give the state after it. A later call goes on where this one ended."""
        query: StreamingQuery = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.version(self.epochs()[-1] if self.epochs() else -1)


JOB_STATE = "job_name string, last_run_us bigint, last_success_us bigint, last_failure_us bigint, consecutive_failures bigint, last_error string"


def fold_job_state(state: DataFrame, history: DataFrame) -> DataFrame:
    """State per job after a batch of history rows that come after those before.

    A success sets the failures in a row to 0 and clears the last failure; a failure adds one.
    """
    ended = jobs.runs(history)
    success = ended.where("is_success").groupBy("job_name").agg(F.max(F.struct("start_us", "id")).alias("ok"))
    since = ended.where(~F.col("is_success")).join(success, "job_name", "left").where(F.col("ok").isNull() | (F.struct("start_us", "id") > F.col("ok"))).groupBy("job_name").agg(F.count(F.lit(1)).alias("failures"), F.max("start_us").alias("failed_us"), F.max_by("error_message", F.struct("start_us", "id")).alias("error"))
    batch = ended.groupBy("job_name").agg(F.max("start_us").alias("run_us")).join(success.select("job_name", F.col("ok.start_us").alias("ok_us")), "job_name", "left").join(since, "job_name", "left")
    both = state.join(batch, "job_name", "full_outer")
    n = F.coalesce("failures", F.lit(0).cast("bigint"))
    streak = F.when(F.col("ok_us").isNull(), F.coalesce("consecutive_failures", F.lit(0).cast("bigint")) + n).otherwise(n)
    return both.select(
        "job_name",
        F.greatest("last_run_us", "run_us").alias("last_run_us"),
        F.coalesce("ok_us", "last_success_us").alias("last_success_us"),
        F.when(streak > 0, F.coalesce("failed_us", "last_failure_us")).alias("last_failure_us"),
        streak.alias("consecutive_failures"),
        F.when(streak > 0, F.when(F.col("failed_us").isNotNull(), F.col("error")).otherwise(F.col("last_error"))).alias("last_error"),
    )


def job_state_stream(spark: SparkSession, path: str) -> DataFrame:
    """Job states after streaming all history files of a path."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path + "*")
    return FoldedTable(spark, JOB_STATE, fold_job_state, "job-state").run(stream)


SCAN_CACHE = "repo_path string, path string, size bigint, mtime bigint, cached_at bigint, deleted boolean"


def fold_scan(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Cache after a batch that holds one whole scan of each repository in it, made at ``scanned_at``.

    Repositories that were not scanned keep their entries.
    """
    repos = batch.groupBy("repo_path").agg(F.max("scanned_at").alias("now"))
    own = state.join(repos, "repo_path")
    diff = sync.scan_diff(batch, own, ["repo_path", "path"]).join(repos, "repo_path")
    seen = diff.select("repo_path", "path", "size", "mtime", F.col("now").alias("cached_at"), (F.col("change") == "deleted").alias("deleted"))
    tombs = own.where("deleted").join(diff.select("repo_path", "path"), ["repo_path", "path"], "left_anti")
    rest = state.join(repos, "repo_path", "left_anti")
    return seen.unionByName(tombs.drop("now")).unionByName(rest)


def scan_cache_stream(spark: SparkSession, scans: list[DataFrame]) -> DataFrame:
    """Cache after the scans, each delivered as new files to one running stream."""
    folded = FoldedTable(spark, SCAN_CACHE, fold_scan, "scan-cache")
    schema, state = "repo_path string, path string, size bigint, mtime bigint, scanned_at bigint", folded.version(-1)
    for n, scan in enumerate(scans):
        scan.select("repo_path", "path", "size", "mtime", "scanned_at").write.mode("overwrite").parquet(f"{folded.folder}/scans/{n}")
        state = folded.run(spark.readStream.schema(schema).parquet(f"{folded.folder}/scans/*"))
    return state
