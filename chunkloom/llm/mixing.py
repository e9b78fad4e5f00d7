"""Mixing sources to target weights with capped repeats.

The total is the largest at which every source that has texts reaches its share without using a
text more often than allowed, unless a total is given; shares of sources without texts are
spread over the others in proportion. A source's budget is met by complete epochs of all its
texts and then by a part of them, chosen by Efraimidis-Spirakis sampling: exponential keys
scaled by quality weights, ascending, up to the rest of the budget.

The prefix sum over a source's keys needs no sort of the source: the range of the keys is cut into
65,536 buckets in order, tokens are summed per source and bucket (map side first), the prefix runs over
buckets, and the bucket in which the budget ends is cut again until it holds ``EDGE_ROWS`` texts at
most. Only that one is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.tokens import character_model, form, surprise, token_counts, with_quality
from chunkloom.model import strip
from chunkloom.session import cut, small_side, spread

BUCKETS = 1 << 16
#: Texts at most in the range that one task sorts, and times at most that it is cut; keys that many cuts can't part are equal.
EDGE_ROWS, MOST_CUTS = 200_000, 8
SEED = 20240601


def sized_texts(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, sample_key), materialised; sources in plain form."""
    source = F.lower(strip("source"))
    texts = documents.select("doc_id", "source", "text")
    model = documents.sparkSession.sparkContext.broadcast(character_model(texts.where("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")))
    rows = spread(texts).select("doc_id", source.alias("source"), form().alias("form"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    told = rows.mapInArrow(surprise(model), f"doc_id {kind}, source string, form double, text string, bits double")
    sized = with_quality(cut(token_counts(told, ["doc_id", "source", "form", "bits"])))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return cut(sized.select("doc_id", "source", "n_tokens", (-F.log(u) / F.col("weight")).alias("sample_key")))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: what it holds, its budget, complete epochs and the rest."""
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy(F.lower(strip("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sized.where(F.col("n_tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("n_tokens").alias("held_tokens"))
    rows = wanted.join(held, "source", "left").fillna(0, ["n_posts", "held_tokens"])
    every = Window.partitionBy(F.lit(1))  # one row per target source
    share = F.when(F.col("held_tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("held_tokens") > 0, F.col("target_share"))).over(every)).otherwise(0.0)
    rows = rows.withColumn("aim_share", share)
    most = F.min(F.when(F.col("aim_share") > 0, F.col("max_repeats") * F.col("held_tokens") / F.col("aim_share"))).over(every)
    total = F.lit(float(total_tokens)) if total_tokens is not None else most
    budget = F.least(F.round(F.coalesce(total, F.lit(0.0)) * F.col("aim_share")).cast("bigint"), F.col("max_repeats") * F.col("held_tokens"))
    rows = rows.withColumn("budget_tokens", budget)
    epochs = F.when(F.col("held_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("held_tokens"))).otherwise(0).cast("int")
    return rows.withColumn("epochs", epochs).withColumn("rest_tokens", F.col("budget_tokens") - F.col("epochs") * F.col("held_tokens"))


def mix(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the chosen texts.

    In the last, partial epoch a text is taken if the budget reaches its middle, so a source misses
    its budget by half a text at most. Texts without tokens, a source or a target are not used.
    """
    place = F.col("sample_key") / (1 + F.col("sample_key"))  # ascending as the keys, within [0, 1)
    texts = sized.where(F.col("n_tokens") > 0).withColumn("place", place)
    budgets = planned.where(F.col("budget_tokens") > 0).select("source", "epochs", "rest_tokens")
    edges = cut(budgets.select("*", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("bigint").alias("before"), F.lit(EDGE_ROWS + 1).cast("bigint").alias("n_edge")))
    for _ in range(MOST_CUTS):
        if not edges.where(F.col("n_edge") > EDGE_ROWS).limit(1).count():
            break
        edges = cut(_narrowed(texts, edges))
    tagged = texts.join(small_side(edges), "source")
    whole, edge = F.col("place") < F.col("low"), (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    clear = tagged.where(~edge).withColumn("part", F.when(whole & (F.col("rest_tokens") > 0), 1).otherwise(0))
    run = Window.partitionBy("source").orderBy("sample_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("before") + F.sum("n_tokens").over(run) - F.col("n_tokens") / 2
    last = tagged.where(edge).withColumn("part", F.when((reach <= F.col("rest_tokens")) & (F.col("rest_tokens") > 0), 1).otherwise(0))
    used = clear.unionByName(last).withColumn("repeats", (F.col("epochs") + F.col("part")).cast("int"))
    return used.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", "repeats")


def _narrowed(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with the bucket of each source in which its budget ends as its new range, and the tokens before it.

    A source whose texts the budget covers keeps no texts on its edge.
    """
    wide = edges.where(F.col("n_edge") > EDGE_ROWS)
    inside = texts.join(small_side(wide.select("source", "low", "high")), "source").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    bucket = F.least(F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
    held = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.withColumn("up_to", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    # the first bucket that the rest does not cover; buckets before it are taken whole
    ends = sums.join(small_side(wide.select("source", "rest_tokens", "before")), "source").where(F.col("before") + F.col("up_to") + F.col("tokens") > F.col("rest_tokens")).groupBy("source").agg(F.min(F.struct("bucket", "up_to", "n", "first", "last")).alias("end"))
    found = wide.join(ends, "source", "left")
    covered, above = F.col("end").isNull(), F.col("end.last") * (1 + 2.0**-52) + 2.0**-60  # just beyond the bucket's last key
    narrow = found.select("source", "epochs", "rest_tokens", F.when(covered, F.col("high")).otherwise(F.col("end.first")).alias("low"), F.when(covered, F.col("high")).otherwise(above).alias("high"), (F.col("before") + F.coalesce("end.up_to", F.lit(0))).alias("before"), F.coalesce("end.n", F.lit(0)).cast("bigint").alias("n_edge"))
    return edges.where(F.col("n_edge") <= EDGE_ROWS).unionByName(narrow)


def share_report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target source its target and actual share of all tokens, and how often texts are used."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("used_posts"), F.max("repeats").alias("most_repeats"))
    rows = planned.join(used, "source", "left").fillna(0, ["used_tokens", "used_posts", "most_repeats"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return rows.select("source", "target_share", "aim_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("actual_share"), "n_posts", "held_tokens", "budget_tokens", "used_tokens", "used_posts", "max_repeats", "most_repeats", "epochs")
