"""File trees and object stores: the walk of a folder, stored objects, and writing files back."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chunkloom.functions.chunking import compress_bytes, decompress_bytes
from chunkloom.functions.parity import encode, repair
from chunkloom.functions.patterns import Rule
from chunkloom.functions.scalars import PARITY
from chunkloom.model import usable_id
from chunkloom.session import cut
from chunkloom.sources import storage

ENTRY = "root string, path string, item_type string, size bigint, mode bigint, uid bigint, gid bigint, atime bigint, mtime bigint, ctime bigint, inode bigint, nlink bigint, symlink_target string"
#: Payloads below this many bytes are stored raw (fixed value).
MIN_COMPRESSED = 128
ITEM_KINDS = ((stat.S_ISREG, "File"), (stat.S_ISDIR, "Directory"), (stat.S_ISLNK, "Symlink"), (stat.S_ISFIFO, "Fifo"), (stat.S_ISSOCK, "Socket"), (stat.S_ISBLK, "BlockDevice"), (stat.S_ISCHR, "CharDevice"))


class _Root(InputPartition):
    def __init__(self, root: str, below: str | None) -> None:
        super().__init__(0)
        self.root, self.below = root, below


def _entry(root: str, path: str) -> tuple | None:
    try:
        s = os.lstat(path)
        kind = next((k for test, k in ITEM_KINDS if test(s.st_mode)), None)
        target = os.readlink(path) if kind == "Symlink" else None
    except OSError:
        return None
    return (root, path, kind, s.st_size if kind == "File" else 0, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, int(s.st_atime), int(s.st_mtime), int(s.st_ctime), s.st_ino, s.st_nlink, target)


class FolderReader(DataSourceReader):
    """A task for the root itself and one for each entry of it; links are not followed, errors are passed over."""

    def __init__(self, root: str, rules: list[Rule]) -> None:
        self.root, self.rules = root, rules

    def partitions(self) -> list[InputPartition]:
        try:
            names = sorted(os.listdir(self.root))
        except OSError:
            names = []
        return [_Root(self.root, None), *(_Root(self.root, n) for n in names)]

    def _pruned(self, path: str) -> bool:
        import re

        from chunkloom.functions.patterns import exclusion_glob_regex

        own = path.lstrip("/")
        for rule in self.rules:
            if rule.kind == "prefix":
                root = rule.pattern.rstrip("/")
                if own == root or own.startswith(root + "/"):
                    return True
            elif re.search((rule.pattern if rule.kind == "regex" else exclusion_glob_regex(rule.pattern)).replace(r"\z", r"\Z"), own):
                return True
        return False

    def read(self, partition: _Root) -> Iterator[tuple]:
        start = self.root if partition.below is None else os.path.join(self.root, partition.below)
        todo = [start]
        while todo:
            path = todo.pop()
            row = _entry(self.root, path)
            if row is None or row[2] is None or self._pruned(os.path.relpath(path, self.root)) and path != self.root:
                continue
            yield row
            if row[2] == "Directory" and partition.below is not None:
                try:
                    todo += sorted((os.path.join(path, n) for n in os.listdir(path)), reverse=True)
                except OSError:
                    continue


class FolderSource(DataSource):
    """``spark.read.format("folder").option("exclude", patterns).load(root)``: one row per entry.

    The folder must be visible to all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: object) -> FolderReader:
        from chunkloom.functions.patterns import parse_rules

        return FolderReader(os.path.abspath(self.options["path"]), parse_rules(self.options.get("exclude", "")))


def walk(spark: SparkSession, root: str, exclude: str = "") -> DataFrame:
    """Entries of a folder and all below it; an excluded folder is not entered."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("exclude", exclude).load(root)


def to_items(entries: DataFrame) -> DataFrame:
    """Items of walked entries: of names with one inode the first is a file, the others hardlinks to it; sockets and the like are dropped."""
    kept = entries.where(F.col("item_type").isin("File", "Directory", "Symlink"))
    first = kept.where((F.col("item_type") == "File") & (F.col("nlink") > 1)).groupBy("root", "inode").agg(F.min("path").alias("first_path"))
    linked = kept.join(first, ["root", "inode"], "left").withColumn("linked", F.col("first_path").isNotNull() & (F.col("first_path") != F.col("path")) & (F.col("item_type") == "File"))
    return linked.select("root", "path", F.when(F.col("linked"), "Hardlink").otherwise(F.col("item_type")).alias("item_type"), "size", F.struct("mode", "uid", "gid", "atime", "mtime", "ctime").alias("attrs"), "symlink_target", F.when(F.col("linked"), F.col("first_path")).alias("hardlink_target"))


#: Columns of a stored object: its payload as stored, how it was compressed, and its parity blob; the last are null in raw stores.
OBJECT = "chunk_id string, data binary, algorithm string, parity binary, prefix string"


def _encoded(chunks: DataFrame, algorithm: str, shards: int) -> DataFrame:
    """Chunks as they are stored: compressed where that gains, with parity of what is stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [compress_bytes(bytes(d or b""), algorithm, MIN_COMPRESSED) for d in pdf["data"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "data": [b for _, b in done], "algorithm": [a for a, _ in done], "parity": [encode(b, shards) or None for _, b in done]})

    return chunks.select("chunk_id", "data").mapInPandas(run, "chunk_id string, data binary, algorithm string, parity binary")


def put_objects(chunks: DataFrame, folder: str, algorithm: str = "none", redundancy: str = "none") -> DataFrame:
    """Write the chunks (chunk_id, data) that the store lacks, by hash prefix; gives the ids written.

    Each chunk is written once however often it comes. Which are new is settled first, by ids alone, so
    no payload is held while the store is read.
    """
    spark = chunks.sparkSession
    ids = chunks.where(usable_id("chunk_id")).select("chunk_id").distinct()
    if storage.exists(spark, folder):
        ids = ids.join(list_objects(spark, folder), "chunk_id", "left_anti")
    ids = cut(ids)
    new = chunks.select("chunk_id", F.col("data").cast("binary").alias("data")).join(ids, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    _encoded(new, algorithm, PARITY.get(redundancy, 0)).withColumn("prefix", F.substring("chunk_id", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)
    return ids


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OBJECT).parquet(folder)


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id) of a store written by ``put_objects``; reads no payload."""
    return _stored(spark, folder).select("chunk_id")


def get_objects(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(chunk_id, data) of the wanted chunks, decompressed.

    A payload that does not give its id is repaired by its parity; where that fails ``data`` is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            data = [_decoded(*x) for x in zip(pdf["chunk_id"], pdf["data"], pdf["algorithm"], pdf["parity"], strict=True)]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "data": data})

    keys = wanted.select("chunk_id", F.substring("chunk_id", 1, 2).alias("prefix"))
    return _stored(spark, folder).join(keys, ["chunk_id", "prefix"], "left_semi").select("chunk_id", "data", "algorithm", "parity").mapInPandas(run, "chunk_id string, data binary")


def _decoded(chunk_id: str, data: bytes | None, algorithm: str | None, parity: bytes | None) -> bytes | None:
    stored = bytes(data or b"")
    for payload in (lambda: stored, lambda: repair(stored, bytes(parity or b""))):
        try:
            out = decompress_bytes(payload(), algorithm or "none")
        except Exception:  # noqa: BLE001, S112 - damaged payloads raise whatever their codec does
            continue
        if hashlib.sha256(out).hexdigest() == chunk_id:
            return out
    return None


def delete_objects(spark: SparkSession, folder: str, unwanted: DataFrame) -> None:
    """Rewrite the hash prefixes that hold unwanted chunks without them; other prefixes stay untouched.

    What is kept is written beside the store and renamed into it prefix by prefix. A deletion that was
    cut short is ended by the next one, or by ``settle_objects``; no kept chunk is lost at any moment.
    """
    folder = folder.rstrip("/")
    settle_objects(spark, folder)
    gone = unwanted.select("chunk_id").where(usable_id("chunk_id")).distinct()
    hit = cut(gone.select(F.substring("chunk_id", 1, 2).alias("prefix")).distinct())  # 256 rows at most
    kept = _stored(spark, folder).join(F.broadcast(hit), "prefix", "left_semi").join(gone, "chunk_id", "left_anti")
    kept.write.mode("overwrite").partitionBy("prefix").parquet(folder + ".kept")
    fresh = set(storage.children(spark, folder + ".kept"))
    for prefix in sorted(r["prefix"] for r in hit.collect()):
        part = f"prefix={prefix}"
        if part in fresh:
            storage.swap_in(spark, f"{folder}.kept/{part}", f"{folder}/{part}")
        else:
            storage.delete(spark, f"{folder}/{part}")
    storage.delete(spark, folder + ".kept")


def settle_objects(spark: SparkSession, folder: str) -> None:
    """End a deletion that was cut short: prefixes that were moved away get their kept chunks."""
    for part in storage.children(spark, folder + ".kept"):
        if part.startswith("prefix="):
            storage.settle(spark, f"{folder}.kept/{part}", f"{folder}/{part}")
    storage.delete(spark, folder + ".kept")


def object_ids(paths: DataFrame, column: str = "path") -> DataFrame:
    """(chunk_id) of listed places ``…/aa/rest``; others are left out."""
    parts = F.regexp_extract(column, r"([0-9a-f]{2})/([0-9a-f]{62})\z", 1), F.regexp_extract(column, r"([0-9a-f]{2})/([0-9a-f]{62})\z", 2)
    return paths.select(F.concat(*parts).alias("chunk_id")).where(usable_id("chunk_id"))
