"""Totals over trailing periods per entity and day, days without activity included.

Rows are aggregated per entity and day (map side first), the days of an entity are cut into
tiles of ``TILE`` days, and each tile also gets the days before it that its windows reach: its
halo. A tile of any entity is a task-independent unit, so an entity of many days or many rows
loads no single task. Tiles are packed into dense blocks (entity-tiles x days) and multiplied by
banded window operators. Values are split into two halves of which the products are exact in
double precision, so totals are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.model import final_runs

TILE = 128
LOW_BITS = 26
BLOCK_TILES = 2048
DAY_US = 86_400_000_000


def banded(window: int, halo: int) -> np.ndarray:
    """Operator that sums ``window`` days ending at each day of a tile preceded by its halo."""
    day, end = np.arange(halo + TILE)[:, None], halo + np.arange(TILE)[None, :]
    return ((day <= end) & (day > end - window)).astype(np.float64)


def multiply(block: np.ndarray, operator: np.ndarray) -> np.ndarray:
    """Exact integer product of an int64 block of non-negative values with a 0/1 operator."""
    low = (block & ((1 << LOW_BITS) - 1)).astype(np.float64) @ operator
    high = (block >> LOW_BITS).astype(np.float64) @ operator
    return (high.astype(np.int64) << LOW_BITS) + low.astype(np.int64)


def _roll(measures: list[str], windows: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    halo = max(windows) - 1
    operators = {w: banded(w, halo) for w in windows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TILES):
                t = batch.slice(at, BLOCK_TILES)
                tile, first, last = (t.column(c).to_numpy() for c in ("tile", "first_day", "last_day"))
                days = t.column("days")
                row = np.repeat(np.arange(t.num_rows), np.nan_to_num(np.asarray(pa.compute.list_value_length(days).to_numpy(zero_copy_only=False), dtype=float)).astype(int))
                flat = days.flatten()
                day = flat.field("day").to_numpy() - tile[row] * TILE + halo
                calendar = tile[:, None] * TILE + np.arange(TILE)[None, :]
                r, c = np.nonzero((calendar >= first[:, None]) & (calendar <= last[:, None]))
                out = [t.column("entity").take(pa.array(r)), pa.array(calendar[r, c].astype(np.int32))]
                for m in measures:
                    block = np.zeros((t.num_rows, halo + TILE), dtype=np.int64)
                    block[row, day] = flat.field(m).to_numpy()
                    out += [pa.array(multiply(block, operators[w])[r, c]) for w in windows]
                whole = pa.RecordBatch.from_arrays(out, names=["entity", "day", *(f"{m}_{w}d" for m in measures for w in windows)])
                for i in range(0, whole.num_rows, 50_000):
                    yield whole.slice(i, 50_000)

    return run


def rolling_totals(daily: DataFrame, measures: list[str], windows: list[int]) -> DataFrame:
    """(entity, day, <measure>_<window>d...) of (entity, day int, measures bigint), any rows per day.

    One row per entity and day from its first to its last day. Null and negative values count as
    0; rows without entity or day are left out.
    """
    halo = max(windows) - 1
    if halo > TILE:
        raise ValueError(f"windows of more than {TILE + 1} days need longer tiles")
    rows = daily.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
    totals = rows.groupBy("entity", "day").agg(*(F.sum(F.greatest(F.coalesce(m, F.lit(0)), F.lit(0))).cast("bigint").alias(m) for m in measures))
    tile = F.floor(F.col("day") / TILE).cast("int")
    reach = F.when(F.col("day") - tile * TILE >= TILE - halo, F.array(tile, tile + 1)).otherwise(F.array(tile))
    tiles = totals.select("entity", F.explode(reach).alias("tile"), F.struct("day", *measures).alias("d")).groupBy("entity", "tile").agg(F.collect_list("d").alias("days"))
    spans = totals.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    every = spans.select("*", F.explode(F.sequence(F.floor(F.col("first_day") / TILE).cast("int"), F.floor(F.col("last_day") / TILE).cast("int"))).alias("tile"))
    packed = every.join(tiles, ["entity", "tile"], "left").select("entity", "tile", "first_day", "last_day", "days")
    return packed.mapInArrow(_roll(measures, windows), "entity string, day int, " + ", ".join(f"{m}_{w}d bigint" for m in measures for w in windows))


def job_rolling_totals(history: DataFrame) -> DataFrame:
    """Totals of files and bytes per job and day over that day and the 6 or 29 days before.

    Of the rows of one id the one with an end holds; each run with a readable start counts on
    the UTC day of its start.
    """
    runs = final_runs(history).select(
        F.col("job_name").alias("entity"),
        F.floor(F.col("start_us") / F.lit(DAY_US)).cast("int").alias("day"),
        F.col("files_processed").alias("files"),
        F.col("bytes_processed").alias("bytes"),
    )
    rolled = rolling_totals(runs, ["files", "bytes"], [7, 30])
    return rolled.select(F.col("entity").alias("job_name"), F.date_from_unix_date("day").cast("string").alias("run_day"), "files_7d", "files_30d", "bytes_7d", "bytes_30d")
