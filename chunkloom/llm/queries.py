"""Queries of the operators on text, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import mixing, packing, truncation
from chunkloom.model import table

Query = Callable[[SparkSession, str], DataFrame]


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every post once, in the tier of its size or a gap of a longer one."""
    return packing.pack(packing.sized_posts(table(spark, sf, "documents")), packing.read_limits(table(spark, sf, "pack_limits")))


def p7_pack_each(spark: SparkSession, sf: str) -> DataFrame:
    """All posts in containers of each single capacity in turn."""
    sized, out = packing.sized_posts(table(spark, sf, "documents")), None
    for capacity, name in packing.read_limits(table(spark, sf, "pack_limits")).items():
        one = packing.pack(sized, {capacity: name}).withColumn("limit_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, sf), table(spark, sf, "pack_limits"))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Of every post whether its pieces hold exactly its tokens, one after the other from piece 0."""
    sized = packing.sized_posts(table(spark, sf, "documents"))
    packed = packing.pack(sized, packing.read_limits(table(spark, sf, "pack_limits")))
    pieces = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("n_distinct"), F.max("piece").alias("last"))
    whole = (F.col("held") == F.coalesce("n_tokens", F.lit(0))) & (F.col("n") == F.col("n_distinct")) & (F.col("last") + 1 == F.col("n"))
    return sized.join(pieces, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("is_whole"))


def p7_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Of every kind of container whether all of them keep to its capacity and number their pieces from 0 without gaps."""
    limits = table(spark, sf, "pack_limits").select("limit_name", "capacity_tokens")
    per = p7_pack(spark, sf).where(F.col("container_id").isNotNull()).groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_distinct"), F.max("position").alias("last"))
    bad = per.join(F.broadcast(limits), "limit_name").where((F.col("tokens") > F.col("capacity_tokens")) | (F.col("n") != F.col("n_distinct")) | (F.col("last") + 1 != F.col("n"))).select("limit_name").distinct().withColumn("bad", F.lit(True))
    return limits.join(bad, "limit_name", "left").select("limit_name", "capacity_tokens", F.col("bad").isNull().alias("is_within"))


def p8_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Of every target source whether no post is used more often than it may be and its budget is met within the largest post."""
    sized = mixing.sized_texts(table(spark, sf, "documents"))
    mixed, planned = _mixed(spark, sf, sized)
    used = mixed.groupBy("source").agg(F.max("repeats").alias("most"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"))
    used = used.join(sized.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source", "right")
    within = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.abs(F.coalesce("used", F.lit(0)) - F.col("budget_tokens")) <= F.coalesce("largest", F.lit(0)))
    return planned.join(used, "source", "left").select("source", "max_repeats", within.alias("is_within"))


def _mixed(spark: SparkSession, sf: str, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_texts(table(spark, sf, "documents")) if sized is None else sized
    planned = mixing.cut(mixing.plan(sized, table(spark, sf, "mix_targets")))
    return mixing.mix(sized, planned), planned


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(*_mixed(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents"))


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, sf, "documents"))


def p9_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Each cut post with what told it: how it ends, what is open there, and the finding."""
    found = truncation.judged(table(spark, sf, "documents")).where("is_cut")
    return found.select("doc_id", "source", "ending", F.array_join("open", ",").alias("left_open"), "at_limit", "reason")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p7_pack, p7_pack_each, p7_fill, p7_whole, p7_bounds, p8_mix, p8_shares, p8_caps, p9_found, p9_rates, p9_reasons)}

#: SQL has no tokenizer and no corpus walk; what must hold of their results it can state.
SQL: dict[str, str] = {
    "p7_whole": "SELECT doc_id, true AS is_whole FROM documents",
    "p7_bounds": "SELECT limit_name, capacity_tokens, true AS is_within FROM pack_limits",
    "p8_caps": "SELECT lower(trim(source)) AS source, max(max_repeats) AS max_repeats, true AS is_within FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1",
}
