from __future__ import annotations

import math
import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import mixing, tokens

SIZED = "doc_id bigint, source string, n_tokens bigint, sample_key double, bucket int"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, rows: list[tuple[int, str | None, int]]):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    key = (F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) + 1) / 2e5
    return df.withColumn("sample_key", key).withColumn("bucket", F.floor((1 - F.exp(-F.col("sample_key") / 2)) * mixing.BUCKETS).cast("int"))


def by_hand(rows: list, planned: dict) -> dict:
    """Complete epochs, then texts in order of their keys until the rest is reached."""
    out, by = {}, defaultdict(list)
    for r in rows:
        if r.n_tokens and r.source in planned:
            by[r.source].append((r.sample_key, r.doc_id, r.n_tokens))
    for source, texts in by.items():
        p, done = planned[source], 0
        for _, doc, n in sorted(texts):
            times = p.epochs + (p.rest_tokens > 0 and done + n - n / 2 <= p.rest_tokens)
            done += n
            if times:
                out[doc] = times
    return out


@pytest.mark.parametrize("buckets", [1 << 16, 8, 1])
def test_mix(spark, buckets: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = [(i, ["hot", "hot", "small", "mid", None, "none"][i % 6] if i % 6 != 2 or i < 60 else "hot", (i * 7) % 90) for i in range(1200)]
    df = sized(spark, rows)
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.2, 5), (" MID ", 0.2, 2), ("empty", 0.1, 9)], TARGETS)
    planned = mixing.plan(df, targets)
    p = {r.source: r for r in planned.collect()}
    found = mixing.mix(df, planned).collect()
    assert {r.doc_id: r.repeats for r in found} == by_hand(df.collect(), p) and len({r.doc_id for r in found}) == len(found)
    shares = {r.source: r for r in mixing.share_report(mixing.mix(df, planned), planned).collect()}
    for source, want in (("hot", 5 / 9), ("small", 2 / 9), ("mid", 2 / 9), ("empty", 0)):
        assert shares[source].actual_share == pytest.approx(want, abs=0.02)
        assert shares[source].most_repeats <= shares[source].max_repeats
    # the total is the largest feasible: some source is used up
    assert any(r.budget_tokens == r.max_repeats * r.held_tokens for r in p.values() if r.held_tokens)


def test_given_total_and_caps(spark) -> None:
    df = sized(spark, [(i, "a" if i < 10 else "b", 10) for i in range(110)])
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], TARGETS)
    p = {r.source: r for r in mixing.plan(df, targets, 2000).collect()}
    assert (p["a"].budget_tokens, p["a"].epochs, p["b"].budget_tokens, p["b"].epochs) == (300, 3, 1000, 1)
    assert {r.repeats for r in mixing.mix(df, mixing.plan(df, targets, 2000)).collect()} == {1, 3}


def test_empty_tables(spark) -> None:
    none, targets = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert mixing.mix(none, mixing.plan(none, targets)).count() == 0
    some = sized(spark, [(1, "a", 5)])
    assert mixing.mix(some, mixing.plan(some, targets.limit(0))).count() == 0
    assert [r.actual_share for r in mixing.share_report(mixing.mix(none, mixing.plan(none, targets)), mixing.plan(none, targets)).collect()] == [0.0]


def test_better_texts_come_first(spark) -> None:
    good, bad = "plain words of a decent length without any marks " * 6, "<<[[{{1234 5678}}]]>> " * 12
    docs = spark.createDataFrame([(i, good if i % 2 else bad, " S ") for i in range(2000)] + [(9999, None, "s")], "doc_id bigint, text string, source string")
    df = mixing.sized_texts(docs)
    assert df.where("n_tokens = 0").count() == 1 and df.select("source").distinct().count() == 1
    first = df.where("n_tokens > 0").orderBy("sample_key").limit(300).where("doc_id % 2 = 1").count()
    assert first > 240
    rows = docs.select("source", mixing.form().alias("form"), F.when(F.col("doc_id") % 2 == 1, 2.0).when(F.col("text").isNotNull(), 6.0).alias("bits"))
    weight = mixing.with_quality(rows).agg(F.min("weight"), F.max("weight")).first()
    assert 0.05 <= weight[0] < weight[1] <= 1 and not math.isnan(weight[1])


def test_unusual_texts_weigh_less(spark) -> None:
    """A text of shuffled letters is as well formed as its source's others, but its characters surprise."""
    rng = random.Random(4)
    words = ["kettle", "valve", "the", "pump", "often", "leaks", "slowly", "under", "winter", "load"]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("qxzjkvwpgbn ") for _ in range(220))) for i in range(20)] + [(5000, None), (5001, ""), (5002, "ab")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = spark.sparkContext.broadcast(tokens.character_model(docs.where("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")))
    told = docs.select("doc_id", F.lit("s").alias("source"), tokens.form().alias("form"), "text").mapInArrow(tokens.surprise(model), "doc_id bigint, source string, form double, text string, bits double")
    weight = {r.doc_id: r.weight for r in tokens.with_quality(told.drop("text")).collect()}
    assert max(weight[1000 + i] for i in range(20)) < min(weight[i] for i in range(300))
    assert weight[5000] == weight[5001] == tokens.LEAST_WEIGHT


def test_edge_is_cut_until_it_is_small(spark, monkeypatch: pytest.MonkeyPatch) -> None:
    """At the least weight, with few buckets, the range that one task sorts still stays small."""
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 20)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"), (-F.log((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 0.5) / (1 << 30)) / 0.05).alias("sample_key"))
    planned = mixing.plan(df, spark.createDataFrame([("a", 1.0, 2)], TARGETS), 40_000)
    edges = spark.createDataFrame([("a", 1, 10_000, 0.0, 1.0, 0, 21)], "source string, epochs int, rest_tokens bigint, low double, high double, before bigint, n_edge bigint")
    texts = df.withColumn("place", F.col("sample_key") / (1 + F.col("sample_key")))
    cuts = 0
    while (row := edges.first()).n_edge > 20:
        edges, cuts = mixing.cut(mixing._narrowed(texts, edges)), cuts + 1
    assert 2 <= cuts <= mixing.MOST_CUTS
    assert texts.where((F.col("place") >= row.low) & (F.col("place") < row.high)).count() == row.n_edge
    assert texts.where(F.col("place") < row.low).count() * 10 == row.before <= 10_000
    p = {r.source: r for r in planned.collect()}
    assert {r.doc_id: r.repeats for r in mixing.mix(df, planned).collect()} == by_hand(df.collect(), p)


def _counts_by_hand(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every different text once, byte by byte."""
    pairs, trigrams = np.zeros(1 << 16, np.int64), np.zeros(tokens.TRIGRAMS, np.int64)
    for data in {t.encode() for t in texts}:
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            pairs[a << 8 | b] += 1
            trigrams[((a << 8 | b) * 0x9E3779B1 + c * 0x85EBCA6B >> 7) & (tokens.TRIGRAMS - 1)] += 1
    return pairs, trigrams


@pytest.mark.parametrize("broadcast", [True, False])
def test_character_model_counts_all_texts_whole(spark, broadcast: bool, monkeypatch: pytest.MonkeyPatch) -> None:
    """More than 10,000 texts, some beyond 4,000 bytes, some twice: every byte of each different one is counted."""
    monkeypatch.setattr(tokens, "fits", lambda _: broadcast)
    rng = random.Random(7)
    texts = [f"{i} {rng.choice(['pump', 'välve', '水'])}" for i in range(10_500)] + ["".join(rng.choices("abc é", k=9_000)) for _ in range(3)]
    texts += texts[:40] * 3 + texts[-1:] + ["", "", "a", "ab", "abc", "abc"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    pairs, trigrams = (np.frombuffer(x, np.int64) for x in tokens.character_model(docs.select(F.xxhash64("text").alias("text_hash"), "text")))
    want = _counts_by_hand(texts)
    assert (pairs == want[0]).all() and (trigrams == want[1]).all() and pairs.sum() == sum(max(len(t.encode()) - 2, 0) for t in set(texts))


def test_counts_beyond_what_floats_count_by_ones(spark) -> None:
    """The same three bytes come more than 2^24 times in a text of many pieces."""
    n = (1 << 24) + 99
    docs = spark.range(1).select(F.xxhash64("id").alias("text_hash"), F.repeat(F.lit("a"), n).alias("text"))
    pairs, trigrams = (np.frombuffer(x, np.int64) for x in tokens.character_model(docs))
    assert pairs[ord("a") << 8 | ord("a")] == pairs.sum() == trigrams.max() == trigrams.sum() == n - 2


@pytest.mark.parametrize("piece", [1 << 20, 64, 5])
def test_bits_of_each_text(piece: int, monkeypatch: pytest.MonkeyPatch) -> None:
    """Texts side by side, short and null ones between, give what each gives alone, however they are cut into pieces."""
    monkeypatch.setattr(tokens, "PIECE", piece)
    rng = random.Random(3)
    texts = ["", "ab", "a", None, *("".join(rng.choices("ab é", k=rng.randrange(90))) for _ in range(60)), "xyz", None, "b", "aab"]
    pairs, trigrams = counts = _counts_by_hand([t for t in texts if t])
    model = SimpleNamespace(value=tuple(x.tobytes() for x in counts))
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    (told,) = tokens.surprise(model)([pa.RecordBatch.from_arrays([column], names=["text"])])
    (counted,) = tokens._count_grams([pa.RecordBatch.from_arrays([pa.array(sorted({t for t in texts if t}))], names=["text"])])
    assert dict(zip(*(c.to_pylist() for c in counted.columns), strict=True)) == {int(i): int(n) for at, x in ((0, pairs), (tokens.PAIRS, trigrams)) for i, n in zip(np.flatnonzero(x) + at, x[x > 0], strict=True)}
    for text, bits in zip(texts, told.column("bits").to_pylist(), strict=True):
        data = (text or "").encode()
        if len(data) < 3:
            assert bits is None
            continue
        slots = [(a << 8 | b, ((a << 8 | b) * 0x9E3779B1 + c * 0x85EBCA6B >> 7) & (tokens.TRIGRAMS - 1)) for a, b, c in zip(data, data[1:], data[2:], strict=False)]
        assert bits == pytest.approx(sum(math.log2((pairs[p] + tokens.ALPHA * 256) / (trigrams[t] + tokens.ALPHA)) for p, t in slots) / len(slots))
