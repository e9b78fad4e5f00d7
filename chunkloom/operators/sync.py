"""Incremental scans against cached metadata with tombstones, and the file cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a scan: path, size, mtime; of its cache also cached_at and deleted. ``key`` columns come first.


def scan_diff(scan: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): ``changed`` (new, other size or mtime, or back from a tombstone), ``unchanged`` or ``deleted``.

    A path that is only in the cache and already a tombstone gives no row. A path scanned twice
    counts with its latest mtime.
    """
    s = scan.groupBy(*keys).agg(F.max(F.struct("mtime", "size")).alias("s"))
    c = cache.select(*keys, F.struct("mtime", "size", "deleted").alias("c"))
    same = F.col("s.size").eqNullSafe(F.col("c.size")) & F.col("s.mtime").eqNullSafe(F.col("c.mtime")) & ~F.col("c.deleted")
    change = F.when(F.col("s").isNull(), F.when(~F.col("c.deleted"), "deleted")).when(F.col("c").isNotNull() & same, "unchanged").otherwise("changed")
    return s.join(c, keys, "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, F.coalesce("s.size", "c.size").alias("size"), F.coalesce("s.mtime", "c.mtime").alias("mtime"), "change")


def next_cache(scan: DataFrame, cache: DataFrame, keys: list[str], now: int | Column) -> DataFrame:
    """(keys, size, mtime, cached_at, deleted) after a scan: seen paths live, vanished ones tombstones."""
    now = F.lit(now) if isinstance(now, int) else now
    diff = scan_diff(scan, cache, keys)
    seen = diff.select(*keys, "size", "mtime", now.alias("cached_at"), (F.col("change") == "deleted").alias("deleted"))
    old = cache.join(diff.select(*keys), keys, "left_anti")
    return seen.unionByName(old.select(*keys, "size", "mtime", "cached_at", "deleted"))


def _sightings(scans: DataFrame, keys: list[str]) -> DataFrame:
    """Each path of each scan, with what the cache held of it before (``c``), when it was seen last and when next.

    As in ``scan_diff`` a null size or mtime leaves what was cached. One window over a path's scans
    stands for the chain of caches, so no scan waits for the one before.
    """
    own = Window.partitionBy(*keys).orderBy("seq")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.last(c, ignorenulls=True).over(past).alias(f"cached_{c}") for c in ("size", "mtime")]
    rows = scans.select(*keys, "seq", "n_snapshots", "size", "mtime", *kept, F.lag("seq").over(own).alias("seen"), F.coalesce(F.lead("seq").over(own), "n_snapshots").alias("next"))
    same = F.col("size").eqNullSafe(F.col("cached_size")) & F.col("mtime").eqNullSafe(F.col("cached_mtime"))
    change = F.when((F.col("seen") == F.col("seq") - 1) & same, "unchanged").otherwise("changed")
    return rows.select(*keys, "seq", "n_snapshots", "next", F.coalesce("size", "cached_size").alias("size"), F.coalesce("mtime", "cached_mtime").alias("mtime"), change.alias("change"))


def scan_diffs(scans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, size, mtime, change) of every scan after the first against the cache of all before it.

    ``scans`` has one row per path and scan, with ``seq`` from 0 and ``n_snapshots`` of its tree.
    """
    seen = _sightings(scans, keys)
    out = [*keys, "seq", "size", "mtime", "change"]
    gone = seen.where((F.col("next") > F.col("seq") + 1)).withColumn("seq", F.col("seq") + 1).withColumn("change", F.lit("deleted"))
    return seen.where("seq > 0").select(*out).unionByName(gone.select(*out))


def caches(scans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, size, mtime, cached_at, deleted): the cache after every scan but the first; scan ``seq`` is made at ``seq`` + 1."""
    seen = _sightings(scans, keys)
    held = seen.select(*keys, "size", "mtime", F.col("seq").alias("at"), F.explode(F.sequence(F.col("seq"), F.col("next") - 1)).alias("seq"))
    deleted = F.col("seq") > F.col("at")
    return held.where("seq > 0").select(*keys, "seq", "size", "mtime", (F.col("at") + F.when(deleted, 2).otherwise(1)).cast("int").alias("cached_at"), deleted.alias("deleted"))


def probe(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): ``hit`` if size, mtime and inode are those cached, ``stale`` if not, ``miss`` without an entry."""
    c = cache.select(*keys, F.struct("size", "mtime", "inode").alias("c"))
    w = wanted.select(*keys, F.struct("size", "mtime", "inode").alias("w"))
    outcome = F.when(F.col("c").isNull(), "miss").when(F.col("w").eqNullSafe(F.col("c")), "hit").otherwise("stale")
    return w.join(c, keys, "left").select(*keys, outcome.alias("outcome"))


def probe_rates(probed: DataFrame) -> DataFrame:
    """One row: hits, probes that missed, and the rate of hits (0 if none was made)."""
    n = F.count(F.lit(1))
    return probed.agg(F.count_if(F.col("outcome") == "hit").alias("n_hits"), F.count_if(F.col("outcome") != "hit").alias("n_misses"), F.when(n > 0, F.count_if(F.col("outcome") == "hit") / n).otherwise(0.0).alias("hit_rate"))


def evict(cache: DataFrame, now: int, max_age: int) -> DataFrame:
    """Entries not older than ``max_age``: one cached exactly that long ago stays."""
    return cache.where(F.col("cached_at") >= now - max_age)
