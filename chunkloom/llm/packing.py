"""Filling containers of several capacities with texts that are split only if they exceed the largest.

Hierarchical multi-length packing: a text is routed to the tier of the smallest capacity that
holds it. Tiers are packed from the longest down; the gaps of longer containers are filled from
shorter tiers. Containers of the lower tiers that stay below ``MIN_FILL`` are dissolved and their
texts packed into the longest windows, where small items leave little space. Containers are then
dealt into step groups of equal cost.

Texts are spread over shards of about ``SHARD_ITEMS`` by a hash of the id; each shard packs for
itself, at the price of one unfilled container at most per shard and tier. Packing works on
the histogram of sizes: a greedy pattern (the largest item left, then the largest that fits the
gap) is applied as often as its sizes last, so the loop runs over patterns, not over texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.tokens import token_counts
from chunkloom.session import cut, spread

SHARD_ITEMS = 50_000
MIN_FILL = 0.97
STEP_GROUP = 8


class _Stock:
    """Counts of items by size, with the sizes left in order."""

    def __init__(self, sizes: np.ndarray) -> None:
        values, counts = np.unique(sizes, return_counts=True)
        self.sizes, self.left = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def largest(self, limit: int, used: Counter) -> int:
        """The largest size up to ``limit`` of which an item is left beside those used; 0 if none."""
        at = bisect_right(self.sizes, limit) - 1
        while at >= 0 and self.left[self.sizes[at]] <= used[self.sizes[at]]:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def take(self, used: Counter, times: int) -> None:
        for size, n in used.items():
            self.left[size] -= n * times
            if not self.left[size]:
                del self.left[size]
                self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def put(self, used: Counter, times: int) -> None:
        for size, n in used.items():
            if size not in self.left:
                self.sizes.insert(bisect_right(self.sizes, size), size)
            self.left[size] = self.left.get(size, 0) + n * times


def _fill(stock: _Stock, capacity: int, above: int) -> list[tuple[int, Counter, int]]:
    """(capacity, pattern, times) until no item larger than ``above`` and up to ``capacity`` is left."""
    out = []
    while stock.sizes:
        used: Counter = Counter()
        first = stock.largest(capacity, used)
        if first <= above:
            break
        gap, size = capacity, first
        while size:
            used[size] += 1
            gap -= size
            size = stock.largest(gap, used) if gap else 0
        times = min(stock.left[s] // n for s, n in used.items())
        stock.take(used, times)
        out.append((capacity, used, times))
    return out


def patterns(sizes: np.ndarray, capacities: list[int], min_fill: float = MIN_FILL) -> list[tuple[int, Counter, int]]:
    """Container patterns that hold every item exactly once; no size exceeds the largest capacity."""
    tiers = sorted(capacities)
    stock, good = _Stock(sizes), []
    loose = _Stock(np.empty(0, dtype=np.int64))
    for i in range(len(tiers) - 1, -1, -1):
        for capacity, used, times in _fill(stock, tiers[i], tiers[i - 1] if i else 0):
            if capacity < tiers[-1] and sum(s * n for s, n in used.items()) < min_fill * capacity:
                loose.put(used, times)
            else:
                good.append((capacity, used, times))
    last = _fill(loose, tiers[-1], 0)
    # what does not fill a longest window goes into the smallest capacity that holds it
    return good + [(next(c for c in tiers if c >= sum(s * n for s, n in used.items())), used, times) for _, used, times in last]


def assign(sizes: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(container, position, offset, capacity) of each item, in the order given."""
    n = len(sizes)
    slot_size, slot_container, slot_position, slot_offset, slot_capacity = (np.empty(n, np.int64) for _ in range(5))
    at = container = 0
    for capacity, used, times in patterns(sizes, capacities):
        row = np.repeat(np.array(sorted(used, reverse=True)), [used[s] for s in sorted(used, reverse=True)])
        s = slice(at, at + len(row) * times)
        slot_size[s] = np.tile(row, times)
        slot_container[s] = container + np.repeat(np.arange(times), len(row))
        slot_position[s] = np.tile(np.arange(len(row)), times)
        slot_offset[s] = np.tile(np.cumsum(row) - row, times)
        slot_capacity[s] = capacity
        at, container = s.stop, container + times
    items, slots = np.argsort(sizes, kind="stable"), np.argsort(slot_size, kind="stable")
    out = []
    for values in (slot_container, slot_position, slot_offset, slot_capacity):
        column = np.empty(n, np.int64)
        column[items] = values[slots]
        out.append(column)
    return tuple(out)


def step_groups(container: np.ndarray, capacity: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Step group of each container: per capacity, dealt back and forth by falling attention cost."""
    cost = np.bincount(container, weights=sizes.astype(float) ** 2)
    of = np.zeros(len(cost), dtype=np.int64)
    of[container] = capacity
    group, base = np.zeros(len(cost), dtype=np.int64), 0
    for c in np.unique(of):
        own = np.flatnonzero(of == c)
        own = own[np.argsort(-cost[own], kind="stable")]
        n = -(-len(own) // STEP_GROUP)
        turn, place = np.divmod(np.arange(len(own)), n)
        group[own] = base + np.where(turn % 2 == 0, place, n - 1 - place)
        base += n
    return group


def _pack(limits: dict[int, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sizes, shard = t["n_tokens"].to_numpy(), t["shard"][0].as_py()
        container, position, offset, capacity = assign(sizes, list(limits))
        group = step_groups(container, capacity, sizes)[container]
        for i in range(0, len(sizes), 50_000):
            s = slice(i, i + 50_000)
            names = [limits[c] for c in capacity[s]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([f"{n}-{shard:06d}-{c:08d}" for n, c in zip(names, container[s], strict=True)], pa.string()),
                    pa.array(position[s].astype(np.int32)),
                    t["doc_id"].combine_chunks()[i : i + 50_000],
                    t["piece"].combine_chunks()[i : i + 50_000],
                    t["n_tokens"].combine_chunks()[i : i + 50_000],
                    pa.array(offset[s].astype(np.int32)),
                    pa.array([f"{n}-{shard:06d}-{g:06d}" for n, g in zip(names, group[s], strict=True)], pa.string()),
                ],
                names=["limit_name", "container_id", "position", "doc_id", "piece", "n_tokens", "start_token", "step_group"],
            )

    return run


_SCHEMA = "limit_name string, container_id string, position int, doc_id bigint, piece int, n_tokens bigint, start_token int, step_group string"


def read_limits(limits: DataFrame) -> dict[int, str]:
    """Capacity to name of the container table: a fixed table, refused beyond 100 rows; may be empty."""
    rows = limits.where(F.col("capacity_tokens") > 0).groupBy("capacity_tokens").agg(F.min("limit_name").alias("limit_name")).orderBy("capacity_tokens").limit(101).collect()
    if len(rows) > 100:
        raise ValueError("more than 100 capacities")
    return {r["capacity_tokens"]: r["limit_name"] for r in rows}


def pack(sized: DataFrame, limits: dict[int, str]) -> DataFrame:
    """Container and position of each text of (doc_id, n_tokens).

    A text above the largest capacity is cut into pieces of that capacity and a rest. Texts
    without tokens take no room and have null in place of container, position and group; without
    any capacity all have.
    """
    top = max(limits, default=1)
    shards = max(1, -(-sized.count() // SHARD_ITEMS))
    pieces = sized.where(F.col("n_tokens") > 0).select(
        "doc_id",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / top).cast("int"))).alias("piece"),
        "n_tokens",
    )
    pieces = pieces.withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("piece").cast("bigint") * top, F.lit(top).cast("bigint"))).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    packed = (pieces if limits else pieces.limit(0)).repartitionById(shards, F.col("shard")).mapInArrow(_pack(limits), _SCHEMA)
    empty = sized.where(F.coalesce("n_tokens", F.lit(0)) == 0) if limits else sized
    none = [F.lit(None).cast(t).alias(c) for c, t in (("limit_name", "string"), ("container_id", "string"), ("position", "int"))]
    return packed.unionByName(empty.select(*none, "doc_id", F.lit(0).alias("piece"), F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens"), F.lit(None).cast("int").alias("start_token"), F.lit(None).cast("string").alias("step_group")))


def sized_posts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_tokens), materialised: the tokenizer runs once."""
    return cut(token_counts(spread(documents.select("doc_id", "text")), ["doc_id"]))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, capacity_tokens, n_containers, n_pieces, used_tokens, fill) per kind of container."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("limit_name", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    total = per.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("tokens").alias("used_tokens"))
    out = limits.select("limit_name", "capacity_tokens").join(total, "limit_name", "left").fillna(0, ["n_containers", "n_pieces", "used_tokens"])
    return out.withColumn("fill", F.when(F.col("n_containers") > 0, F.col("used_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))))
