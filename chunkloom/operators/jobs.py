"""Job history: last states, failure streaks, missed runs, queues, alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import final_runs, strip

ALERT_COOLDOWN_S = 300


def runs(history: DataFrame) -> DataFrame:
    """(id, job_name, start_us, status, is_success, error_message): one row per run with a readable start that has ended."""
    if "error_message" not in history.columns:
        history = history.withColumn("error_message", F.lit(None).cast("string"))
    own = final_runs(history, ("error_message",))
    ended = own.where(F.col("start_us").isNotNull() & F.col("job_name").isNotNull() & F.col("status").isin("success", "failed"))
    return ended.select("id", "job_name", "start_us", "status", (F.col("status") == "success").alias("is_success"), "error_message")


def last_states(ended: DataFrame) -> DataFrame:
    """Per job the start of its last run, last success and last failure; null where there is none."""
    ok = F.col("is_success")
    return ended.groupBy("job_name").agg(F.max("start_us").alias("last_run_us"), F.max(F.when(ok, F.col("start_us"))).alias("last_success_us"), F.max(F.when(~ok, F.col("start_us"))).alias("last_failure_us"))


def failure_streaks(ended: DataFrame) -> DataFrame:
    """Per run the failures in a row up to it; a success sets it to 0. Runs at one time go by id."""
    order = Window.partitionBy("job_name").orderBy("start_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    island = ended.withColumn("island", F.sum(F.col("is_success").cast("int")).over(order))
    run = Window.partitionBy("job_name", "island").orderBy("start_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    return island.select("id", "job_name", "start_us", F.sum((~F.col("is_success")).cast("int")).over(run).cast("bigint").alias("streak"))


def job_states(ended: DataFrame) -> DataFrame:
    """Folded state per job: last times, failures in a row and their last error; a later success clears ``last_failure_us`` and ``last_error``."""
    streak = failure_streaks(ended).groupBy("job_name").agg(F.max_by("streak", F.struct("start_us", "id")).alias("consecutive_failures"))
    error = ended.groupBy("job_name").agg(F.max(F.when(~F.col("is_success"), F.struct("start_us", "id", "error_message"))).alias("e"))
    state = last_states(ended).join(streak, "job_name").join(error, "job_name")
    failed = F.col("consecutive_failures") > 0
    return state.withColumn("last_failure_us", F.when(failed, F.col("last_failure_us"))).withColumn("last_error", F.when(failed, F.col("e.error_message"))).drop("e")


def recent_history(history: DataFrame, n: int) -> DataFrame:
    """The ``n`` last runs per job by their start text, as the text sorts; ties by id."""
    order = Window.partitionBy("job_name").orderBy(F.col("start_time").desc(), F.col("id").desc())
    own = final_runs(history).where(F.length(strip("start_time")) > 0)
    return own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("job_name", "id", "start_time", "status", "n")


def expected_hours(ended: DataFrame) -> DataFrame:
    """(job_name, slot_us): each full hour after the first run of a job up to its last."""
    hour = 3_600_000_000
    span = ended.groupBy("job_name").agg(F.min("start_us").alias("a"), F.max("start_us").alias("b"))
    first = (F.floor(F.col("a") / F.lit(hour)) + 1).cast("bigint")
    last = F.floor(F.col("b") / F.lit(hour)).cast("bigint")
    return span.where(last >= first).select("job_name", F.explode(F.transform(F.sequence(first, last), lambda h: h * hour)).alias("slot_us"))


def missed_runs(ended: DataFrame, expected: DataFrame, window_s: int = 3600) -> DataFrame:
    """Expected slots after which no run of the job starts within the window.

    A run can only serve the slot of its own window: both sides are cut into windows and joined
    by equality.
    """
    w = window_s * 1_000_000
    taken = ended.select("job_name", F.floor(F.col("start_us") / F.lit(w)).alias("w")).distinct()
    return expected.withColumn("w", F.floor(F.col("slot_us") / F.lit(w))).join(taken, ["job_name", "w"], "left_anti").select("job_name", "slot_us")


def just_missed(tasks: DataFrame, slots: DataFrame, now_us: int, window_s: int = 300, known: DataFrame | None = None) -> DataFrame:
    """(name, slot_us): the first slot of each task within the window before ``now``, if its last run does not reach it.

    ``tasks`` has (name, last_run_us), ``slots`` (name, slot_us); a task that never ran has missed it. Tasks whose
    name stands in ``known`` were there before and are not asked.
    """
    recent = slots.where((F.col("slot_us") <= now_us) & (F.col("slot_us") > now_us - window_s * 1_000_000)).groupBy("name").agg(F.min("slot_us").alias("slot_us"))
    if known is not None:
        recent = recent.join(known.select("name"), "name", "left_anti")
    return recent.join(tasks.select("name", "last_run_us"), "name").where(F.col("last_run_us").isNull() | (F.col("last_run_us") < F.col("slot_us"))).select("name", "slot_us")


def retry_delays(initial: float, factor: float, longest: float, retries: int) -> Column:
    """Delays before the retries: the first as it is, each next one times ``factor`` up to ``longest``."""
    steps = [initial]
    for _ in range(max(retries, 0) - 1):
        steps.append(min(steps[-1] * factor, longest))
    return F.array(*[F.lit(float(s)) for s in steps[: max(retries, 0)]])


def queue(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """``tasks`` with ``n_in_queue`` by next_run, priority and name."""
    order = Window.partitionBy(*keys).orderBy(F.col("next_run").asc_nulls_last(), "priority", "task_name")
    return tasks.withColumn("n_in_queue", F.row_number().over(order))


def _alerts(frames: Iterator[pd.DataFrame], threshold: int, cooldown_us: int) -> Iterator[pd.DataFrame]:
    job, last = None, None
    for pdf in frames:
        keep = []
        for name, start, streak in zip(pdf["job_name"], pdf["start_us"], pdf["streak"], strict=True):
            if name != job:
                job, last = name, None
            fire = streak >= threshold and (last is None or start - last >= cooldown_us)
            if fire:
                last = start
            keep.append(fire)
        yield pdf.loc[keep, ["id", "job_name", "start_us", "streak"]]


def alerts(streaks: DataFrame, threshold: int = 2, cooldown_s: int = ALERT_COOLDOWN_S) -> DataFrame:
    """Runs that raise an alert: a streak of ``threshold`` or more, and none raised within the cooldown before.

    Greedy along each job's runs: the state carried is one time, so the sorted partition is
    streamed and no job is collected.
    """
    spread = streaks.where(F.col("streak") >= threshold)
    ordered = spread.repartition("job_name").sortWithinPartitions("job_name", "start_us", "id").select("id", "job_name", "start_us", "streak")
    return ordered.mapInPandas(lambda frames: _alerts(frames, threshold, cooldown_s * 1_000_000), "id bigint, job_name string, start_us bigint, streak bigint")


def missed_alerts(missed: DataFrame, cooldown_s: int) -> DataFrame:
    """(job_name, slot_us) of the missed slots that raise an alert: none was raised for the job within the cooldown before."""
    rows = missed.select(F.col("slot_us").alias("id"), "job_name", F.col("slot_us").alias("start_us"), F.lit(1).cast("bigint").alias("streak"))
    return alerts(rows, 1, cooldown_s).select("job_name", F.col("start_us").alias("slot_us"))


def retained(archives: DataFrame, keep: dict[str, int]) -> DataFrame:
    """Archives with ``is_kept``: the last one of each of the last n hours, days, weeks, months or years that have any.

    An extension: the meaning of the counts is that of grandfather-father-son schemes.
    """
    test = F.lit(False)
    for unit, n in keep.items():
        bucket = F.date_trunc(unit, F.col("archive_time")).alias("bucket")
        newest = F.row_number().over(Window.partitionBy("repo_path", bucket).orderBy(F.col("archive_time").desc(), F.col("archive_name").desc()))
        rank = F.dense_rank().over(Window.partitionBy("repo_path").orderBy(bucket.desc()))
        archives = archives.withColumn(f"_{unit}", (newest == 1) & (rank <= n))
        test = test | F.col(f"_{unit}")
    return archives.withColumn("is_kept", test & F.col("archive_time").isNotNull()).drop(*[f"_{u}" for u in keep])
