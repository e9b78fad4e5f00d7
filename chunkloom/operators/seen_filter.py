"""Has this key been seen before? Quotient filters over ranges of the hash space.

Map side, each task sorts its records by key and settles all but the earliest record of a key on
its own: they come after a record of their own task. Only one record per key and task goes on
as a candidate, so a key that fills a third of the input reaches its range with a handful of rows.
A key has two 64-bit hashes: the first bits of one name its range, and the range's filter keeps up to 64
bits of the other. A task per range reads its candidates in arrival order and keeps a cascade of
quotient filters, never the keys themselves.

A false match takes equal fingerprints of two keys: equal range and equal bits within it. The bits are
derived from the number of records and the rate of wrong answers allowed. As ranges grow in number with the
records, not in size, the bits within a range stay at about 60 for any number of records at the
rate ``WRONG``. ``seen_error_report`` measures what comes out, at the width in use as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.model import plain_id
from chunkloom.operators.quotient_filter import Cascade, fingerprint_bits, mean_wrong
from chunkloom.session import cut, parallelism

#: Rate of wrong answers allowed for a new key.
WRONG = 2.0**-40
#: Rows a map task settles at a time, and records a range's task holds at most on average.
LOCAL_ROWS, RANGE_ROWS = 400_000, 1_000_000
#: What sets the second hash of a key apart.
PLACE_SEED = 20_240_601
#: A key of the register stands before every record.
REGISTER = np.iinfo(np.int64).min


def _batches(source: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in source:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _settle_locally(prefix: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Emit each record with its hash, the range it goes to and whether it is still open (else: seen)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(source, LOCAL_ROWS):
            record, place, key = t["record"].to_numpy(), t["place"].to_numpy(), t["hash"].to_numpy()
            order = np.lexsort((record, key))
            record, place, key = record[order], place[order].view(np.uint64), key[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])  # both hashes: a record more or less left open does no harm
            # a second delivery of the earliest record is that record
            earliest = record[np.flatnonzero(first)][np.cumsum(first) - 1]
            keep = first | (record != earliest)
            first, record, place, key = first[keep], record[keep], place[keep], key[keep]
            to = np.where(first, (place >> np.uint64(64 - prefix)).astype(np.int64), record % (1 << prefix)).astype(np.int32)
            for i in range(0, len(record), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(to[s]), pa.array(record[s]), pa.array(key[s]), pa.array(first[s])], names=["to", "record", "hash", "open"])

    return run


def _resolve(within: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade, last = Cascade(within), None
        for t in _batches(source, 65_536):
            record, key, is_open = t["record"].to_numpy(), t["hash"].to_numpy().view(np.uint64), t["open"].to_numpy(zero_copy_only=False)
            seen = [record[~is_open]]
            record, key = record[is_open], key[is_open] >> np.uint64(64 - within)
            if len(record):
                # register keys share one record number, so only records proper are deliveries of one another
                again = np.zeros(len(record), dtype=bool)
                again[1:] = record[1:] == record[:-1]
                again[0] = record[0] == last
                last = record[-1]
                keep = ~again | (record == REGISTER)
                record, key = record[keep], key[keep]
            if len(record):
                order = np.argsort(key, kind="stable")  # by arrival within a key
                first = np.ones(len(order), dtype=bool)
                first[1:] = key[order][1:] != key[order][:-1]
                known = cascade.contains(key)
                known[order[~first]] = True
                fresh = order[first]
                cascade.add(key[fresh][~known[fresh]])
                seen.append(record[known & (record != REGISTER)])
            out = np.concatenate(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["record"])

    return run


def filter_bits(records: int, partitions: int, wrong: float = WRONG, bits: int | None = None) -> tuple[int, int]:
    """(bits of the range, bits within it) for a number of records, over as many ranges as partitions at least.

    ``bits`` overrides the sum that ``wrong`` asks for. Within a range there are 8 to 64 bits.
    """
    prefix = max(1, (max(partitions, 1) - 1).bit_length())
    return prefix, min(64, max(8, (bits or fingerprint_bits(records, wrong)) - prefix))


def _bits_in_use(records: DataFrame, wrong: float, bits: int | None) -> tuple[int, int]:
    n = records.count()
    return filter_bits(n, parallelism(records.sparkSession, n, RANGE_ROWS), wrong, bits)


def seen_records(records: DataFrame, register: DataFrame, wrong: float = WRONG, bits: int | None = None) -> DataFrame:
    """(record bigint) of the records whose key stands in ``register`` or came with a smaller record number.

    ``records`` has (record, key), ``register`` (key). Records without number or key are no case.
    A second delivery of a record is the same record and comes out once. ``bits`` overrides the
    fingerprint width that ``wrong`` asks for.
    """
    prefix, within = _bits_in_use(records, wrong, bits)
    hashes = F.xxhash64("key").alias("hash"), F.xxhash64(F.lit(PLACE_SEED), "key").alias("place")
    every = (
        records.where(F.col("record").isNotNull() & F.col("key").isNotNull())
        .select(F.col("record").cast("bigint").alias("record"), *hashes)
        .unionByName(register.where(F.col("key").isNotNull()).select(F.lit(REGISTER).alias("record"), *hashes))
    )
    routed = every.mapInArrow(_settle_locally(prefix), "to int, record bigint, hash bigint, open boolean")
    resolved = routed.repartitionById(1 << prefix, F.col("to")).sortWithinPartitions("record").select("record", "hash", "open").mapInArrow(_resolve(within), "record bigint")
    return resolved.where(F.col("record") != REGISTER).distinct()


def arrivals_and_seeds(arrivals: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk arrivals as (record, key) and the seed chunks as (key), ids in plain form."""
    return arrivals.select(F.col("arrival_id").alias("record"), plain_id("chunk_id").alias("key")), seeds.select(plain_id("chunk_id").alias("key"))


def seen_exactly(records: DataFrame, register: DataFrame) -> DataFrame:
    """(key, first record) by the keys themselves: the yardstick of the filter's answers."""
    known = register.where(F.col("key").isNotNull()).select("key", F.lit(REGISTER).alias("first"))
    own = records.where(F.col("record").isNotNull() & F.col("key").isNotNull())
    first = own.groupBy("key").agg(F.min("record").alias("first")).unionByName(known).groupBy("key").agg(F.min("first").alias("first"))
    return first.select("key", "first")


def seen_error_report(records: DataFrame, register: DataFrame, widths: tuple[int | None, ...], wrong: float = WRONG) -> DataFrame:
    """(bits, n_keys, n_asked, derived_wrong, n_wrong, measured_wrong) per fingerprint width; null asks for the one in use.

    ``bits`` are those the filter really had: the range's and those within it.

    A filter can only take a new key for a known one. ``n_asked`` counts the new keys, each asked
    once, ``n_wrong`` those that the filter claims to have seen, ``derived_wrong`` is the mean
    expected rate while the filter fills.
    """
    first = cut(seen_exactly(records, register))
    new = first.where(F.col("first") != REGISTER).select(F.col("first").alias("record"))
    n_keys, n_new = first.count(), new.count()
    spark, out = records.sparkSession, None
    for asked in widths:
        bits = sum(_bits_in_use(records, wrong, asked))
        found = seen_records(records, register, wrong, asked).join(new, "record", "left_semi").agg(F.count(F.lit(1)).alias("n_wrong"))
        row = found.select(
            F.lit(bits).alias("bits"),
            F.lit(n_keys).cast("bigint").alias("n_keys"),
            F.lit(n_new).cast("bigint").alias("n_asked"),
            F.lit(mean_wrong(n_keys, bits)).alias("derived_wrong"),
            "n_wrong",
            (F.col("n_wrong") / F.lit(max(n_new, 1))).alias("measured_wrong"),
        )
        out = row if out is None else out.unionByName(row)
    return out
