"""Deduplication: who stored a chunk first, what an archive added, chunk counts and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import distinct_archives, plain_id, strip, usable_id


def chunk_references(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(chunk_id, archive_name, archive_time, item_id, pos) of each chunk an item holds, ids in plain form.

    ``pos`` is the place in the list, where elements that are no ids count.

    Items of archives that are not registered come first, as they have no time.
    """
    times = distinct_archives(archives).select("archive_name", "archive_time")
    raw = items.select("archive_name", "item_id", F.posexplode("chunks").alias("pos", "raw"))
    refs = raw.select("archive_name", "item_id", "pos", plain_id("raw").alias("chunk_id")).where(F.col("chunk_id").isNotNull())
    return refs.join(times, "archive_name", "left").select("chunk_id", "archive_name", "archive_time", "item_id", "pos")


def first_owners(refs: DataFrame) -> DataFrame:
    """Per chunk its first reference in processing order: archive time, archive name, item, position.

    A grouped minimum instead of a ranking: it is combined map side, so a chunk that a third of
    all references hold is no hot task.
    """
    order = F.struct("archive_time", "archive_name", "item_id", "pos")
    return refs.groupBy("chunk_id").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n_references")).select("chunk_id", "o.archive_name", "o.item_id", "o.pos", "n_references")


def chunk_sizes(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk_id, original_size) of the register, one row per id in plain form."""
    rows = store.select("chunk_id", "original_size").unionByName(seeds.select("chunk_id", "original_size"))
    return rows.select(plain_id("chunk_id").alias("chunk_id"), "original_size").where(usable_id("chunk_id")).groupBy("chunk_id").agg(F.max("original_size").alias("original_size"))


def archive_stats(items: DataFrame, archives: DataFrame, store: DataFrame, seeds: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Statistics per archive: files (hardlinks too), directories, sizes and chunks.

    ``original_size`` leaves hardlinks out. A chunk is new in the archive of its first reference;
    chunks that the register does not know have no size. ``stored`` has (chunk_id, stored_size) of compressed chunks;
    ``compressed_size`` counts new chunks without one as they are.
    """
    kinds = items.groupBy("archive_name").agg(
        F.count_if(F.col("item_type").isin("File", "Hardlink")).alias("nfiles"),
        F.count_if(F.col("item_type") == "Directory").alias("ndirs"),
        F.coalesce(F.sum(F.when(F.col("item_type") == "File", F.col("size"))), F.lit(0)).alias("original_size"),
        F.sum(F.coalesce(F.size(F.filter("chunks", lambda x: F.length(strip(x)) > 0)), F.lit(0))).alias("nchunks"),
    )
    owned = first_owners(chunk_references(items, archives)).join(chunk_sizes(store, seeds), "chunk_id", "left")
    packed = F.lit(None).cast("bigint")
    if stored is not None:
        owned, packed = owned.join(stored.groupBy("chunk_id").agg(F.max("stored_size").alias("stored_size")), "chunk_id", "left"), F.col("stored_size")
    new = owned.groupBy("archive_name").agg(F.count(F.lit(1)).alias("nchunks_unique"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("deduplicated_size"), F.coalesce(F.sum(F.coalesce(packed, F.col("original_size"))), F.lit(0)).alias("compressed_size"))
    zero = F.lit(0).cast("bigint")
    return kinds.join(new, "archive_name", "left").select("archive_name", "nfiles", "ndirs", "original_size", F.col("nchunks").cast("bigint").alias("nchunks"), F.coalesce("nchunks_unique", zero).alias("nchunks_unique"), F.coalesce("deduplicated_size", zero).alias("deduplicated_size"), F.coalesce("compressed_size", zero).alias("compressed_size"))


def new_chunks(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_id, first_arrival, n_arrivals) of arriving chunks that are not known yet, each once."""
    own = arrivals.select("arrival_id", plain_id("chunk_id").alias("chunk_id")).where(F.col("chunk_id").isNotNull() & F.col("arrival_id").isNotNull()).distinct()
    return own.groupBy("chunk_id").agg(F.min("arrival_id").alias("first_arrival"), F.count(F.lit(1)).alias("n_arrivals")).join(known.select(plain_id("chunk_id").alias("chunk_id")), "chunk_id", "left_anti")


def reference_counts(refs: DataFrame) -> DataFrame:
    """(chunk_id, refcount)."""
    return refs.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("refcount"))


def add_references(index: DataFrame, inserted: DataFrame, incremented: DataFrame) -> DataFrame:
    """The chunk index (chunk_id, size, refcount) after inserts and increments.

    An insert sets the count to 1 even if the chunk is there; an increment of a chunk that isn't
    there does nothing.
    """
    kept = index.join(inserted.select("chunk_id"), "chunk_id", "left_anti")
    base = kept.unionByName(inserted.groupBy("chunk_id").agg(F.max("size").alias("size")).withColumn("refcount", F.lit(1).cast("bigint")))
    more = incremented.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("more"))
    return base.join(more, "chunk_id", "left").select("chunk_id", "size", (F.col("refcount") + F.coalesce("more", F.lit(0))).alias("refcount"))


def chunk_stats(sizes: DataFrame) -> DataFrame:
    """One row: count, bytes and mean size of chunks; the mean of none is 0."""
    return sizes.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("n_bytes"), F.coalesce(F.avg("original_size"), F.lit(0.0)).alias("mean_size"))


def object_path(chunk_id: str = "chunk_id") -> Column:
    """Place of a stored object: ``objects/`` and the id, its first two digits as a folder."""
    c = F.col(chunk_id)
    return F.concat(F.lit("objects/"), F.substring(c, 1, 2), F.lit("/"), F.substring(c, 3, 62))


def chunk_offsets(arrivals: DataFrame) -> DataFrame:
    """(arrival_id, byte_offset, progress): where a chunk starts in its file, and the share of the file done after it.

    A file of no bytes is done. Second deliveries count once.
    """
    own = arrivals.where(F.col("arrival_id").isNotNull()).dropDuplicates(["arrival_id"])
    file = Window.partitionBy("archive_name", "path")
    run = file.orderBy("chunk_pos", "arrival_id").rowsBetween(Window.unboundedPreceding, 0)
    done, total = F.sum(F.coalesce("original_size", F.lit(0))).over(run), F.sum(F.coalesce("original_size", F.lit(0))).over(file)
    return own.select("arrival_id", (done - F.coalesce("original_size", F.lit(0))).alias("byte_offset"), F.when(total > 0, done / total).otherwise(1.0).alias("progress"))


def reassemble(pieces: DataFrame, key: str) -> DataFrame:
    """(key, content) of (key, pos, data): the pieces of each key joined in order of ``pos``."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "data")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["data"]), "").alias("content"))
