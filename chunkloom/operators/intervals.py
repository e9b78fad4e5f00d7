"""Continuous periods and gaps of overlapping, nested and gapped intervals per entity.

Intervals are sorted globally by entity and start, so an entity that holds a third of all rows
spans as many partitions as it needs. A first scan leaves one summary per partition: its first
interval and its last period. The driver combines these summaries by prefix (their number is
that of the partitions) into the period still open at each partition's start. A second scan
carries that state in and emits every period in the partition where it closes, every gap where
the next period starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.model import final_runs
from chunkloom.session import cut, parallelism

ROWS_PER_TASK = 1_000_000

#: An open period: entity, start and end.
Open = tuple[str, int, int]


def running_maximum(entity: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running maximum of ``end`` within each run of equal ``entity`` codes (ascending from 0)."""
    values, rank = np.unique(end, return_inverse=True)
    return values[np.maximum.accumulate(entity * len(values) + rank) - entity * len(values)]


def scan(names: np.ndarray, start: np.ndarray, end: np.ndarray, carried: Open | None) -> tuple[list[np.ndarray], list[np.ndarray], Open | None]:
    """Closed periods and gaps of sorted intervals, and the period left open.

    ``carried`` is the period open before the first interval; it counts as an interval of its own.
    """
    if carried:
        names, start, end = np.concatenate(([carried[0]], names)), np.concatenate(([carried[1]], start)), np.concatenate(([carried[2]], end))
    if not len(names):
        return [], [], None
    new_entity = np.concatenate(([True], names[1:] != names[:-1]))
    code = np.cumsum(new_entity) - 1
    reach = running_maximum(code, end)
    opens = new_entity.copy()
    opens[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:] - 1, len(names) - 1)
    periods = [names[first], start[first], reach[last]]
    inner = first[~new_entity[first]]
    gaps = [names[inner], reach[inner - 1], start[inner]]
    return [p[:-1] for p in periods], gaps, (periods[0][-1], int(periods[1][-1]), int(periods[2][-1]))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last, whole = None, None, True
    for batch in batches:
        if batch.num_rows:
            names, start, end = _columns(batch)
            first = first or (names[0], int(start[0]))
            whole &= names[-1] == first[0]
            last = scan(names, start, end, last)[2]
    if first:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first_name": first[0], "first_start": first[1], "last_name": last[0], "last_start": last[1], "last_end": last[2], "whole": bool(whole)}])


def _rescan(states: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(kind: str, names: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kind] * len(names), pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["entity", "kind", "start_us", "end_us"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carried, goes_on = states.value
        state, inherited = carried.get(part), part in carried
        for batch in batches:
            if batch.num_rows:
                periods, gaps, state_after = scan(*_columns(batch), state)
                if inherited and len(periods[0]) and not _continues(state, batch):
                    periods = [p[1:] for p in periods]  # the partition before has closed it
                state, inherited = state_after, False
                yield out("period", *periods)
                yield out("gap", *gaps)
        if state and part not in goes_on:
            yield out("period", [state[0]], [state[1]], [state[2]])

    return run


def _continues(state: Open, batch: pa.RecordBatch) -> bool:
    return batch.column(0)[0].as_py() == state[0] and batch.column(1)[0].as_py() <= state[2]


def combine(summaries: list[dict]) -> tuple[dict[int, Open], set[int]]:
    """Period open at each partition's start, if it is of that partition's first entity; partitions whose last period goes on."""
    carried, goes_on, state, before = {}, set(), None, None
    for s in sorted(summaries, key=lambda s: s["part"]):
        if state and state[0] == s["first_name"]:
            carried[s["part"]] = state
            if s["first_start"] <= state[2]:
                goes_on.add(before)
        own = (s["last_name"], s["last_start"], s["last_end"])
        if state and s["whole"] and state[0] == own[0] and own[1] <= state[2]:
            own = (own[0], state[1], max(own[2], state[2]))
        state, before = own, s["part"]
    return carried, goes_on


def periods_and_gaps(intervals: DataFrame, rows: int | None = None) -> DataFrame:
    """(entity, kind, start_us, end_us): ``period`` and ``gap`` rows of (entity, start_us, end_us).

    Intervals that overlap or touch form one period; one of no length counts. Rows with a null
    in any of the three columns, or an end before the start, take no part. ``rows`` is a bound of
    their number, counted if not given.
    """
    usable = intervals.select("entity", "start_us", "end_us").where(F.col("entity").isNotNull() & (F.col("start_us") <= F.col("end_us")))
    usable = cut(usable)  # read twice: for the bounds of the ranges, and to sort
    n = usable.count() if rows is None else rows
    ordered = cut(usable.repartitionByRange(parallelism(intervals.sparkSession, n, ROWS_PER_TASK), "entity", "start_us").sortWithinPartitions("entity", "start_us", "end_us"))
    summaries = ordered.mapInArrow(_summarise, "part bigint, first_name string, first_start bigint, last_name string, last_start bigint, last_end bigint, whole boolean").collect()
    states = intervals.sparkSession.sparkContext.broadcast(combine([s.asDict() for s in summaries]))  # one state per partition, sent to each executor once
    return ordered.mapInArrow(_rescan(states), "entity string, kind string, start_us bigint, end_us bigint")


def job_periods(history: DataFrame) -> DataFrame:
    """Busy periods and idle gaps per job: (job_name, kind, start_us, end_us).

    Of the rows of one id the one with an end holds. Runs whose start or end can't be read, or
    that end before they start, take no part, nor do those without a job_name.
    """
    runs = final_runs(history).select(F.col("job_name").alias("entity"), "start_us", "end_us")
    return periods_and_gaps(runs, history.count()).withColumnRenamed("entity", "job_name")
