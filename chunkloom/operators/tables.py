"""Changes to tables held as files: each gives the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """``table`` in which ``rows`` replace all other columns of their key; of several the last in ``order`` holds."""
    new = rows
    if order is not None:
        new = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where(F.col("_n") == 1).drop("_n")
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of the given keys."""
    return table.join(keys.select(key), key, "left_anti")


def increment(table: DataFrame, keys: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` raised by the number of times its key is given."""
    n = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return table.join(n, key, "left").withColumn(column, F.col(column) + F.coalesce("_n", F.lit(0))).drop("_n").select(*table.columns)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and ``rows``; raises if a key is there already or twice among the rows."""
    clash = rows.join(table.select(key), key, "left_semi").select(key).unionByName(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(key)).limit(1).collect()
    if clash:
        raise ValueError(f"already exists: {clash[0][0]}")
    return table.unionByName(rows)


def taken(names: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, is_taken) of each distinct name: whether it is held already."""
    known = held.where(F.col(key).isNotNull()).select(key).distinct().withColumn("is_taken", F.lit(True))
    return names.select(key).distinct().join(known, key, "left").fillna(False, ["is_taken"])


def reindex(table: DataFrame, rows: DataFrame, part: str) -> DataFrame:
    """``table`` in which all rows of the parts found in ``rows`` are replaced: no stale row of a part stays."""
    return delete(table, rows.select(part).distinct(), part).unionByName(rows.select(*table.columns))


def free_names(names: DataFrame) -> DataFrame:
    """(row_id, name, unique_name): the first of equal names keeps it, later ones get ``_1``, ``_2`` and so on.

    A number whose name stands in the table itself is passed over.
    """
    order = Window.partitionBy("name").orderBy("row_id")
    ranked = names.withColumn("n", F.row_number().over(order) - 1)
    taken = names.select(F.regexp_extract("name", r"\A(.*)_([1-9]\d{0,8})\z", 1).alias("name"), F.expr(r"try_cast(regexp_extract(name, '\\A(.*)_([1-9]\\d{0,8})\\z', 2) AS INT)").alias("k")).where(F.col("k").isNotNull()).distinct()
    blocked = taken.groupBy("name").agg(F.array_sort(F.collect_set("k")).alias("blocked"))
    # the n-th free number is n plus the blocked numbers up to it
    free = F.aggregate(F.coalesce("blocked", F.array().cast("array<int>")), F.col("n"), lambda acc, b: F.when(b <= acc, acc + 1).otherwise(acc))
    out = ranked.join(blocked, "name", "left")
    return out.select("row_id", "name", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat_ws("_", "name", free.cast("string"))).alias("unique_name"))


def orphans(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``column`` that name no row of ``table``, unless they look like a place (hold a ``/``)."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).contains("/")).join(table.select(F.col(key).alias(column)), column, "left_anti").select(column).distinct()


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand in more than one row."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
