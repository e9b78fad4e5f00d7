"""What changed between consecutive full snapshots of a tree.

Every path of a tree gets an ordinal that holds for all its snapshots. A snapshot is then a
compressed bitmap of ordinals; AND-NOT of neighbours gives additions and removals, and vectors
of size, mtime and chunk list aligned by ordinal show the changes among common paths.

Trees are cut into blocks of about ``BLOCK_ROWS`` rows by a hash of the path, so a tree that
holds a third of all rows is spread over as many tasks as it needs, while a small tree is one
block. Each row is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import chunk_fingerprint, distinct_archives, plain_path
from chunkloom.operators.bitmaps import Bitmap
from chunkloom.session import cut, parallelism, small_side

BLOCK_ROWS = 100_000
KINDS = np.array(["added", "removed", "changed"], dtype=object)


def snapshots(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(repo_path, archive_name, seq, n_snapshots, n_blocks) of the archives that have items."""
    held = items.where(F.col("archive_name").isNotNull()).groupBy("archive_name").agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy("repo_path").orderBy(F.col("archive_time").asc_nulls_first(), "archive_name")
    whole = Window.partitionBy("repo_path")
    return (
        held.join(distinct_archives(archives), "archive_name")
        .where(F.col("repo_path").isNotNull())
        .select(
            "repo_path",
            "archive_name",
            (F.row_number().over(order) - 1).alias("seq"),
            F.count(F.lit(1)).over(whole).cast("int").alias("n_snapshots"),
            F.ceil(F.sum("n_rows").over(whole) / F.lit(BLOCK_ROWS)).cast("int").alias("n_blocks"),
        )
    )


def block_changes(repo: np.ndarray, path: np.ndarray, seq: np.ndarray, n_snapshots: np.ndarray, item_id: np.ndarray, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, seq, kind) of each change; ``row`` is one that holds the repo and path of the key.

    ``repo`` and ``path`` are dense codes; all trees of the block advance together, so the
    loop runs over snapshot numbers only.
    """
    if not len(repo):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)
    _, sample, ordinal = np.unique(repo.astype(np.int64) * (int(path.max()) + 1) + path, return_index=True, return_inverse=True)
    order = np.lexsort((item_id, ordinal, seq))
    last = np.ones(len(order), dtype=bool)
    last[:-1] = (seq[order][1:] != seq[order][:-1]) | (ordinal[order][1:] != ordinal[order][:-1])
    order = order[last]
    starts = np.searchsorted(seq[order], np.arange(int(n_snapshots.max()) + 1))
    n_of = n_snapshots[sample]
    held, before, out = [np.zeros(len(sample), dtype=v.dtype) for v in vectors], Bitmap({}), []
    for t in range(len(starts) - 1):
        rows = order[starts[t] : starts[t + 1]]
        now = Bitmap.of(ordinal[rows])
        if t:
            gone = before.and_not(now).ordinals()
            common = now.and_(before).ordinals()
            fresh = rows[np.searchsorted(ordinal[rows], common)]
            differs = np.zeros(len(common), dtype=bool)
            for vector, aligned in zip(vectors, held, strict=True):
                differs |= aligned[common] != vector[fresh]
            for kind, which in enumerate((now.and_not(before).ordinals(), gone[n_of[gone] > t], common[differs])):
                out.append((sample[which], np.full(len(which), t), np.full(len(which), kind, dtype=np.int8)))
        for vector, aligned in zip(vectors, held, strict=True):
            aligned[ordinal[rows]] = vector[rows]
        before = now
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else block_changes(*(np.empty(0, np.int64),) * 5, [])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    t = pa.Table.from_batches(got)
    codes, names = {}, {}
    for c in ("repo_path", "path"):
        d = t[c].combine_chunks().dictionary_encode()
        codes[c], names[c] = d.indices.to_numpy(), d.dictionary
    col = lambda c: t[c].to_numpy()
    row, seq, kind = block_changes(codes["repo_path"], codes["path"], col("seq"), col("n_snapshots"), col("item_id"), [col("size"), col("mtime"), col("chunks")])
    for i in range(0, len(row), 50_000):
        r = row[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [names["repo_path"].take(pa.array(codes["repo_path"][r])), pa.array(seq[i : i + 50_000].astype(np.int32)), names["path"].take(pa.array(codes["path"][r])), pa.array(KINDS[kind[i : i + 50_000]], type=pa.string())],
            names=["repo_path", "seq", "path", "change_kind"],
        )


def snapshot_changes(items: DataFrame, archives: DataFrame) -> DataFrame:
    """(repo_path, archive_name, path, change_kind) of each snapshot against the one before.

    Of a path listed twice in an archive the row with the largest item_id holds. A null size or
    mtime equals only null; a null chunk list is an empty one. Rows without a path or an archive
    are no entries; an archive that is not registered, or without a repo_path, is no snapshot.
    Archives of one time are ordered by name. Chunk lists are compared by a 64-bit hash of the
    ids in plain form: a changed list goes unseen once in 2^64 comparisons.
    """
    spark = items.sparkSession
    n_rows = items.select("item_id").count()
    if not n_rows:
        return items.select(F.lit("").alias("repo_path"), "archive_name", "path", F.lit("").alias("change_kind")).limit(0)
    snaps = cut(snapshots(items, archives))
    none = F.lit(np.iinfo(np.int64).min)
    rows = (
        items.where(F.col("path").isNotNull())
        .select("archive_name", F.coalesce("item_id", none).alias("item_id"), plain_path("path").alias("path"), F.coalesce("size", none).alias("size"), F.coalesce(F.col("attrs.mtime"), none).alias("mtime"), chunk_fingerprint("chunks").alias("chunks"))
        .join(small_side(snaps), "archive_name")
        .withColumn("block", F.pmod(F.xxhash64("path"), F.col("n_blocks")))
        .repartition(parallelism(spark, n_rows, BLOCK_ROWS * 2), "repo_path", "block")
        .select("repo_path", "path", "seq", "n_snapshots", "item_id", "size", "mtime", "chunks")
    )
    found = rows.mapInArrow(_changes, "repo_path string, seq int, path string, change_kind string")
    return found.join(small_side(snaps.select("repo_path", "seq", "archive_name")), ["repo_path", "seq"]).select("repo_path", "archive_name", "path", "change_kind")
