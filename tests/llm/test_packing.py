from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm import packing, tokens

LIMITS = {256: "short", 1024: "medium", 4096: "long"}


@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from([[100], [30, 100], [10, 20, 100]]))
@settings(max_examples=200, deadline=None)
def test_assignment_is_sound(sizes: list[int], capacities: list[int]) -> None:
    container, position, offset, capacity = packing.assign(np.array(sizes, dtype=np.int64), capacities)
    held = defaultdict(list)
    for n, c, p, o, cap in zip(sizes, container, position, offset, capacity, strict=True):
        held[c].append((p, o, n, cap))
    for rows in held.values():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(len(rows)))
        assert [o for _, o, *_ in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
        assert len({cap for *_, cap in rows}) == 1 and sum(r[2] for r in rows) <= rows[0][3]


def test_little_space_is_left() -> None:
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(4.5, 1, 20_000).astype(np.int64) + 1, 4096)
    container, _, _, capacity = packing.assign(sizes, list(LIMITS))
    room = np.zeros(container.max() + 1)
    room[container] = capacity
    assert sizes.sum() / room.sum() > 0.995
    # an adversary: nothing fits beside these in a short container, so they go to long ones
    container, _, _, capacity = packing.assign(np.full(1000, 130), list(LIMITS))
    room = np.zeros(container.max() + 1)
    room[container] = capacity
    assert 130_000 / room.sum() > 0.95


def test_groups_are_even() -> None:
    sizes = np.random.default_rng(2).integers(1, 256, 20_000)
    container, _, _, capacity = packing.assign(sizes, [256])
    group = packing.step_groups(container, capacity, sizes)
    cost = np.bincount(group[container], weights=sizes.astype(float) ** 2)
    members = np.bincount(group)
    full = members == packing.STEP_GROUP
    assert full.sum() >= len(members) - packing.STEP_GROUP
    assert cost[full].max() < 1.15 * cost[full].min()


def test_pack(spark, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 1, 255, 256, 257, 1024, 4096, 4097, 9000, rng.randrange(1, 600)])) for i in range(1000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), LIMITS).collect()
    capacity, pieces, room = {v: k for k, v in LIMITS.items()}, defaultdict(list), defaultdict(int)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.n_tokens))
        if r.container_id:
            room[r.container_id, capacity[r.limit_name]] += r.n_tokens
    assert all(used <= most for (_, most), used in room.items())
    for i, n in rows:
        got = sorted(pieces[i])
        assert [p for p, _ in got] == list(range(len(got))) and sum(x for _, x in got) == (n or 0)
        assert len(got) == (1 if (n or 0) <= 4096 else -(-n // 4096))
    assert packing.fill_report(spark.createDataFrame(found), spark.createDataFrame([(v, k) for k, v in LIMITS.items()], "limit_name string, capacity_tokens int")).where("fill > 1").count() == 0


def test_nothing_to_pack(spark) -> None:
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(none, LIMITS).count() == 0
    one = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint")
    assert [r.container_id for r in packing.pack(one, {}).collect()] == [None]
    assert packing.read_limits(spark.createDataFrame([], "limit_name string, capacity_tokens int")) == {}


def test_token_counts(spark) -> None:
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "x" * 50_000), (5, " " * 50_000), (6, "<|endoftext|>"), (7, "日本語のテキスト")]
    rows = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash")), ["doc_id"]).collect()}
    assert 1 < rows[1] < 5 and rows[2] == rows[3] == 0 and rows[4] > 1000 and rows[5] > 0 and rows[6] > 1 and 3 < rows[7] < 30
