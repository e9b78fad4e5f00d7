"""Readers and the plain forms of keys, ids and times that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that may stand around a value.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2007\u202f\u3000\ufeff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def plain_id(c: Column | str) -> Column:
    """Plain form of a chunk id: lower case, without outer blanks and the mark in front.

    Null and blank ids give null.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(strip(c))
    unmarked = F.when(t.startswith("sha") | t.startswith("0x") | t.startswith("\\x"), F.regexp_replace(t, r"^(?:sha-?256\s*[:=_-]?\s*|0x|\\x)+", "")).otherwise(t)
    # most ids are plain already: one test settles them
    return F.when(usable_id(c), c).otherwise(F.when(F.length(unmarked) > 0, unmarked))


def plain_ids(c: Column | str) -> Column:
    """The list's ids in plain form and order, without null and blank elements; null list = empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.filter(F.transform(c, plain_id), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def chunk_fingerprint(c: Column | str) -> Column:
    """64-bit hash of a list's ids in plain form and order.

    Lists whose ids are plain already, as most are, are hashed as they stand, inside codegen.
    """
    c = F.col(c) if isinstance(c, str) else c
    joined = F.array_join(c, ",")
    return F.when(joined.rlike(r"\A[0-9a-f]{64}(?:,[0-9a-f]{64})*\z"), F.xxhash64(joined)).otherwise(F.xxhash64(F.array_join(plain_ids(c), ",")))


def usable_id(c: Column | str) -> Column:
    """Whether a plain id has the 64 hex digits of a stored chunk."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\A[0-9a-f]{64}\z")


def plain_path(c: Column | str) -> Column:
    """Path without empty and ``.`` components, joined by ``/``."""
    c = F.col(c) if isinstance(c, str) else c
    odd = c.contains("//") | c.startswith("/") | c.endswith("/") | c.startswith("./") | c.contains("/./") | c.endswith("/.") | (c == ".")
    return F.when(odd, F.array_join(F.filter(F.split(c, "/", -1), lambda x: ~x.isin("", ".")), "/")).otherwise(c)


def rfc3339(c: Column | str) -> Column:
    """RFC 3339 text as a timestamp (microseconds; further digits are cut), null if unreadable.

    The date and time may be joined by ``T``, ``t`` or a blank; an offset is required.
    """
    t = F.upper(strip(c))
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(t.rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"), t.try_cast("timestamp"))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp, or of a zoneless one read as UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def distinct_archives(archives: DataFrame) -> DataFrame:
    """(archive_name, repo_path, archive_time), one row per name: second deliveries count once."""
    return archives.where(F.col("archive_name").isNotNull()).groupBy("archive_name").agg(F.min(F.struct("archive_time", "repo_path")).alias("a")).select("archive_name", "a.repo_path", "a.archive_time")


def final_runs(history: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per run id, with start_us and end_us of its times: the row with a readable end, else with any end text, else the first.

    Rows without an id are runs of their own, unless equal in all columns. Ties are settled by
    the later end text and then the other columns, so that the choice never depends on row order.
    """
    cols = ["job_name", "start_time", "end_time", "status", "files_processed", "bytes_processed", *more]
    # times are read before the aggregation, once per row: filters on them do not pass it
    end_us, start_us = micros(rfc3339("end_time")), micros(rfc3339("start_time"))
    rank = F.struct(end_us.isNotNull().alias("r"), (F.coalesce(F.length(strip("end_time")), F.lit(0)) > 0).alias("t"), *cols, start_us.alias("start_us"), end_us.alias("end_us"))
    key = [F.col("id").alias("run_id"), F.when(F.col("id").isNull(), F.xxhash64(*cols)).alias("no_id")]
    return history.select(*key, rank.alias("v")).groupBy("run_id", "no_id").agg(F.max("v").alias("v")).select(F.col("run_id").alias("id"), *[F.col(f"v.{c}") for c in (*cols, "start_us", "end_us")])
