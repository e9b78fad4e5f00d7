"""Numbering rows within groups, however large a group is.

A window sorts each group in one task, so a group that holds a third of all rows is one task's work. Groups of
more than ``HOT_ROWS`` are counted first and numbered apart: their rows are range-sorted over all
tasks, and a row's number is its place in its partition plus the group's rows in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.session import cut, parallelism, small_side

#: Rows of a group that one task may sort.
HOT_ROWS = 2_000_000


def numbered(rows: DataFrame, groups: list[str], order: list[tuple[str, bool]], name: str) -> DataFrame:
    """``rows`` with ``name``: the number of each row in its group from 1, by (column, descending) pairs; nulls come first, or last if descending.

    The order must be total. Rows with a null in ``groups`` form groups like others.
    """
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
    plain = F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)).cast("bigint")
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).drop("_n")
    hot = cut(sizes)  # at most one row per HOT_ROWS rows
    if hot.isEmpty():
        return rows.withColumn(name, plain)
    same = _same(rows, hot, groups)
    rest = rows.join(small_side(hot), same, "left_anti").withColumn(name, plain)
    return rest.unionByName(_range_numbered(rows.join(small_side(hot), same, "left_semi"), groups, keys, name))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & a[c].eqNullSafe(b[c])
    return test


def _range_numbered(rows: DataFrame, groups: list[str], keys: list[Column], name: str) -> DataFrame:
    tasks = parallelism(rows.sparkSession, rows.count(), HOT_ROWS)
    by = [F.col(g).asc_nulls_first() for g in groups] + keys
    # the number a row gets here is its partition and, in the low bits, its place there
    placed = cut(rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    low = F.lit((1 << 33) - 1)
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(low)})
    held = placed.groupBy(*groups, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = cut(held.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).drop("_first", "_n"))  # one row per hot group and partition
    keys_of = {c: f"_of_{c}" for c in (*groups, "_part")}
    side = held.withColumnsRenamed(keys_of)
    same = F.lit(True)
    for c, of in keys_of.items():
        same = same & F.col(c).eqNullSafe(F.col(of))
    found = placed.join(small_side(side), same)
    return found.select(*rows.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name))
