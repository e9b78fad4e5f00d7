"""Paths against roots and exclusion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.patterns import Rule, excluded
from chunkloom.model import plain_path
from chunkloom.session import cut, fits, small_side

#: Roots of a key that are tried in the row.
ROOTS_IN_ROW = 64


def ancestors(path: Column | str) -> Column:
    """The path and all paths above it, without the root, in plain form, deepest last."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(plain_path(path), "/", -1)
    return F.when(plain_path(path) != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def assign_roots(paths: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """``paths`` with ``root``: the deepest root of the same key that is the path or above it.

    ``paths`` has the keys and path, ``roots`` the keys, root and n. A leading slash does not
    matter; of a root named twice the last n holds, as ``root_n``. A path without a root has nulls.
    Roots of a key stand in one array and are tried in the row, if there are not more than ``ROOTS_IN_ROW``;
    for keys with more, the ancestors of their paths are joined by equality.
    """
    held = roots.groupBy(*keys, plain_path("root").alias("above")).agg(F.max("n").alias("root_n"))
    held = cut(held)
    crowded_keys = cut(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROOTS_IN_ROW).drop("n"))
    sparse = held.join(small_side(crowded_keys), keys, "left_anti")
    few = sparse.groupBy(*keys).agg(F.collect_list(F.struct(F.when(F.col("above") == "", 0).otherwise(F.size(F.split("above", "/", -1))).alias("level"), "above", "root_n")).alias("_roots"))
    if fits(sparse):  # the arrays hold no more roots than fit
        few = F.broadcast(few)
    rows = paths.drop("root", "root_n").join(few, keys, "left").withColumn("_plain", plain_path("path"))
    above = lambda r: (r["above"] == "") | (F.col("_plain") == r["above"]) | F.col("_plain").startswith(F.concat(r["above"], F.lit("/")))
    best = F.when(F.col("path").isNotNull(), F.array_max(F.filter("_roots", above)))
    out = rows.withColumn("_best", best).withColumns({"root": F.col("_best.above"), "root_n": F.col("_best.root_n")}).drop("_best", "_roots", "_plain")
    if crowded_keys.isEmpty():
        return out
    crowded = held.join(small_side(crowded_keys), keys, "left_semi")
    up = F.concat(F.array(F.lit("")), ancestors("path"))
    tried = paths.select(*keys, "path").join(small_side(crowded_keys), keys, "left_semi").distinct().select(*keys, "path", F.posexplode(up).alias("level", "above"))
    found = tried.join(crowded, [*keys, "above"]).groupBy(*keys, "path").agg(F.max(F.struct("level", "above", "root_n")).alias("b")).select(*keys, "path", F.col("b.above").alias("_root"), F.col("b.root_n").alias("_root_n"))
    out = out.join(found, [*keys, "path"], "left")
    return out.withColumns({"root": F.coalesce("root", "_root"), "root_n": F.coalesce("root_n", "_root_n")}).drop("_root", "_root_n")


def exclude_flat(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """``items`` with ``is_excluded`` by the rules on the path alone."""
    return items.withColumn("is_excluded", F.coalesce(excluded(rules, "path", F.col("item_type") == "Directory"), F.lit(False)))


def exclude_with_ancestors(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """As ``exclude_flat``, but a path below an excluded folder is excluded too, as descent ends there.

    Every path above is tested as a folder, in place: no join and no shuffle.
    """
    up = ancestors("path")
    folders = F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0)))
    above = F.exists(folders, lambda p: excluded(rules, p, F.lit(True)))
    own = excluded(rules, plain_path("path"), F.col("item_type") == "Directory")
    return items.withColumn("is_excluded", F.coalesce(above | own, F.lit(False)))


def exclusion_stats(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: paths checked, excluded, included, and the rate of exclusion (0 of none)."""
    n, out = F.count(F.lit(1)), F.count_if("is_excluded")
    return flagged.groupBy(*keys).agg(n.alias("n_checked"), out.alias("n_excluded"), (n - out).alias("n_included"), F.when(n > 0, out / n).otherwise(0.0).alias("exclusion_rate"))
