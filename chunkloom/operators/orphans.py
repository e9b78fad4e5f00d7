"""References to records that do not exist, counted per referring field and month.

References are first aggregated per key, field and month, map side, so a key that a third of
all rows refer to becomes a few rows. Keys above ``HEAVY_SHARE`` of all references (at most
``1 / HEAVY_SHARE`` keys, whatever the input) are checked by a broadcast join, the others by a
shuffled anti-join against the register; both kinds of orphans are united. A reference is an
orphan if its key is absent, if all rows of the key are deleted, or if the key came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.model import distinct_archives, plain_id, plain_ids, usable_id
from chunkloom.session import cut, fits, small_side

HEAVY_SHARE = 1e-3


def references(items: DataFrame, archives: DataFrame, reports: DataFrame) -> DataFrame:
    """(ref_field, ref_key, ref_time, chunk_id): one row per id in the four referring fields.

    Ids are in plain form, null where an element is no id. Items of an archive that is not
    registered have no time. Second deliveries and repeated ids are still in.
    """
    known = distinct_archives(archives).select("archive_name", F.col("archive_time").alias("ref_time"))
    held = items.select("item_id", "archive_name", "chunks").where(F.size("chunks") > 0).join(small_side(known), "archive_name", "left")
    found = held.select(F.lit("archive_items.chunks").alias("ref_field"), F.col("item_id").cast("string").alias("ref_key"), "ref_time", F.explode("chunks").alias("raw"))
    found = found.unionByName(archives.select(F.lit("archives.id").alias("ref_field"), F.col("archive_name").alias("ref_key"), F.col("archive_time").alias("ref_time"), F.col("id").alias("raw")))
    for field in ("missing_chunks", "orphaned_chunks"):
        found = found.unionByName(reports.select(F.lit(f"verify_reports.{field}").alias("ref_field"), F.col("report_id").cast("string").alias("ref_key"), F.col("report_time").alias("ref_time"), F.explode(field).alias("raw")))
    return found.select("ref_field", "ref_key", "ref_time", plain_id("raw").alias("chunk_id"))


def register_state(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, live, earliest) per stored chunk: whether a row is not deleted, and the first stored_at."""
    rows = store.select("chunk_id", "stored_at", "deleted_at").unionByName(seeds.select("chunk_id", "stored_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at")))
    rows = rows.withColumn("chunk_id", plain_id("chunk_id")).where(usable_id("chunk_id"))
    return rows.groupBy(F.unhex("chunk_id").alias("key")).agg(F.max(F.col("deleted_at").isNull()).alias("live"), F.min("stored_at").alias("earliest"))


def _month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def _reason(live: Column, earliest: Column, time: Column) -> Column:
    """Why a reference at ``time`` finds no usable record; null if it finds one."""
    return F.when(live.isNull(), "absent").when(~live, "deleted").when(earliest > time, "later")


def _checked(pre: DataFrame, state: DataFrame) -> DataFrame:
    """Pre-aggregated references with the state of their key: heavy keys by broadcast, the rest by shuffle."""
    total = pre.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = cut(pre.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > total * HEAVY_SHARE).select("key"))
    found = F.broadcast(state.join(F.broadcast(heavy), "key", "left_semi"))
    return pre.join(F.broadcast(heavy), "key", "left_semi").join(found, "key", "left").unionByName(pre.join(F.broadcast(heavy), "key", "left_anti").join(state, "key", "left"))


def _aggregated(refs: DataFrame) -> DataFrame:
    """(key, ref_field, period, n, first_time) of the references whose id has the digits of a chunk.

    The others fall under the null key and leave after the aggregation: a filter before it would
    bring each id into plain form twice.
    """
    key = F.when(usable_id("chunk_id"), F.unhex("chunk_id"))
    pre = refs.groupBy(key.alias("key"), "ref_field", _month(F.col("ref_time")).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("first_time"))
    return cut(pre).where(F.col("key").isNotNull())


def orphan_references(items: DataFrame, archives: DataFrame, reports: DataFrame, store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref_field, ref_key, chunk_id, reason, period), one row per referring record, field and id.

    A reference without a time has a null period and is never ``later``; nor is one to a key
    whose rows all lack a stored_at.
    """
    refs, state = references(items, archives, reports), cut(register_state(store, seeds))
    pre = _aggregated(refs)
    keys = cut(_checked(pre, state).where(_reason(F.col("live"), F.col("earliest"), F.col("first_time")).isNotNull()).groupBy(F.lower(F.hex("key")).alias("chunk_id")).agg(F.sum("n").alias("n"), F.first("live").alias("live"), F.first("earliest").alias("earliest")))
    if fits(keys):
        # one pass over the references; ids with other digits match no key and are absent
        held = refs.join(F.broadcast(keys.drop("n").withColumn("known", F.lit(True))), "chunk_id", "left").where(F.col("known") | ~usable_id("chunk_id"))
        hits = [held.drop("known")]
    else:
        bound = (keys.agg(F.sum("n").alias("n")).first()["n"] or 0) * HEAVY_SHARE
        heavy, light = keys.where(F.col("n") > bound).drop("n"), keys.where(F.col("n") <= bound).drop("n")
        rest = refs.where(usable_id("chunk_id")).join(F.broadcast(heavy.select("chunk_id")), "chunk_id", "left_anti")
        hits = [refs.join(F.broadcast(heavy), "chunk_id"), rest.join(light, "chunk_id"), refs.where(~usable_id("chunk_id")).withColumns({"live": F.lit(None).cast("boolean"), "earliest": F.lit(None).cast("timestamp_ntz")})]
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return found.select("ref_field", "ref_key", "chunk_id", _reason(F.col("live"), F.col("earliest"), F.col("ref_time")).alias("reason"), _month(F.col("ref_time")).alias("period")).where(F.col("reason").isNotNull()).distinct()


def _with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: how many rows are equal to each, found by a hash of the row alone."""
    rows = rows.withColumn("row_hash", F.xxhash64(*rows.columns))
    repeated = cut(rows.groupBy("row_hash").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1))
    return rows.join(small_side(repeated), "row_hash", "left").drop("row_hash").fillna(1, ["copies"])


def _distinct_ids(c: str) -> Column:
    """The distinct plain ids of a list; lists whose ids are plain already are not transformed."""
    return F.when(F.array_join(c, ",").rlike(r"\A[0-9a-f]{64}(?:,[0-9a-f]{64})*\z"), F.array_distinct(c)).otherwise(F.array_distinct(plain_ids(c)))


def _countable(items: DataFrame, archives: DataFrame, reports: DataFrame) -> DataFrame:
    """(ref_field, ref_time, copies, chunk_id): one row per row of the referring tables and distinct id."""
    known = distinct_archives(archives).select("archive_name", F.col("archive_time").alias("ref_time"))
    held = _with_copies(items.select("item_id", "archive_name", "chunks").where(F.size("chunks") > 0)).join(small_side(known), "archive_name", "left")
    found = held.select(F.lit("archive_items.chunks").alias("ref_field"), "ref_time", "copies", F.explode(_distinct_ids("chunks")).alias("chunk_id"))
    names = archives.select("archive_name", "archive_time", plain_id("id").alias("chunk_id")).distinct()
    found = found.unionByName(names.select(F.lit("archives.id").alias("ref_field"), F.col("archive_time").alias("ref_time"), F.lit(1).cast("bigint").alias("copies"), "chunk_id").where(F.col("chunk_id").isNotNull()))
    for field in ("missing_chunks", "orphaned_chunks"):
        rows = _with_copies(reports.select("report_id", "report_time", field).where(F.size(field) > 0))
        found = found.unionByName(rows.select(F.lit(f"verify_reports.{field}").alias("ref_field"), F.col("report_time").alias("ref_time"), "copies", F.explode(_distinct_ids(field)).alias("chunk_id")))
    return found.where(F.col("chunk_id").isNotNull())  # null elements of lists that are plain otherwise


def orphan_counts(items: DataFrame, archives: DataFrame, reports: DataFrame, store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref_field, period, reason, n_references, n_ids): orphan references, by their counts alone.

    References are counted per id, field and month before anything is joined; rows delivered more
    than once are counted by their copies and divided. Heavy and light keys are then checked as in
    ``orphan_references`` and their counts united. Only where the earliest record of an id falls
    among the references of one month, so that some are ``later`` and some are not, the references
    of that id and month are read again. Rows of one record that differ count as records of their own.
    """
    refs, state = _countable(items, archives, reports), cut(register_state(store, seeds))
    usable = usable_id("chunk_id")
    refs = refs.select(F.when(usable, F.unhex("chunk_id")).alias("key"), F.when(~usable, F.col("chunk_id")).alias("other"), "ref_field", _month(F.col("ref_time")).alias("period"), "copies", "ref_time")
    pre = cut(refs.groupBy("key", "other", "ref_field", "period", "copies").agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("first_time"), F.max("ref_time").alias("last_time")))
    odd = pre.where(F.col("key").isNull()).withColumns({"live": F.lit(None).cast("boolean"), "earliest": F.lit(None).cast("timestamp_ntz")})
    checked = cut(_checked(pre.where(F.col("key").isNotNull()), state).unionByName(odd).withColumn("reason", _reason(F.col("live"), F.col("earliest"), F.col("first_time"))).where(F.col("reason").isNotNull()))
    partly = (F.col("reason") == "later") & (F.col("earliest") <= F.col("last_time"))
    mixed = cut(checked.where(partly).select("key", "ref_field", "period", "earliest").distinct())
    again = refs.join(small_side(mixed), ["key", "ref_field", "period"]).where(F.col("earliest") > F.col("ref_time"))
    again = again.groupBy("key", "other", "ref_field", "period", "copies").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("later"))
    columns = ["key", "other", "ref_field", "period", "reason", "copies", "n"]
    found = checked.where(~partly | F.col("earliest").isNull()).select(columns).unionByName(again.select(columns))
    per_id = found.groupBy("ref_field", "period", "reason", "key", "other").agg(F.sum(F.expr("n div copies")).alias("n"))
    return per_id.groupBy("ref_field", "period", "reason").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_ids"))
