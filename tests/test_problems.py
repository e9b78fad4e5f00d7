"""The general problems against brute force on small rows with all kinds of dirt."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.model import plain_id, plain_path, rfc3339
from chunkloom.operators import intervals, orphans, packed_fields, rolling, seen_filter, snapshot_changes
from chunkloom.operators.bitmaps import Bitmap
from chunkloom.operators.packed_fields import Reader, Separators
from chunkloom.operators.quotient_filter import Cascade, QuotientFilter, mean_wrong

# --- plain forms -----------------------------------------------------------------------------


def test_plain_id(spark) -> None:
    raw = ["ABC", " abc\n", "sha256:AbC", "0xabc", "SHA256: abc", "", "  ", None, "\u00a0abc"]
    rows = spark.createDataFrame([(r,) for r in raw], "x string").select(plain_id("x")).collect()
    assert [r[0] for r in rows] == ["abc"] * 5 + [None, None, None, "abc"]


def test_plain_path(spark) -> None:
    raw = {"a/b": "a/b", "/a//b/": "a/b", "./a/./b": "a/b", "a/.": "a", ".": "", "": "", "..": "..", "a/../b": "a/../b", ".a": ".a", " a": " a"}
    rows = spark.createDataFrame([(r,) for r in raw], "x string").select("x", plain_path("x").alias("y")).collect()
    assert {r.x: r.y for r in rows} == raw


def test_rfc3339(spark) -> None:
    want = {"2024-01-01T00:00:00Z": 0, "2024-01-01 01:00:00+01:00": 0, "2024-01-01t00:00:00.1234567z": 123456, "2024-01-01": None, "2024-01-01T00:00:00": None, "n/a": None, "": None, "2024-13-01T00:00:00Z": None}
    rows = spark.createDataFrame([(r,) for r in want], "x string").select("x", F.unix_micros(rfc3339("x")).alias("y")).collect()
    assert {r.x: None if r.y is None else r.y - 1704067200000000 for r in rows} == want


# --- 1: packed fields ------------------------------------------------------------------------

TAGS = Reader(Separators())
PATHS = Reader(Separators(weak=":", paths=True))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), (" \n", []), (",", []), (" ; ", []), ("[]", []), ("a", ["a"]), ("a,b", ["a", "b"]), ("a;;b", ["a", "b"]), ("a,\u00a0b", ["a", "b"]), ("a\r\nb\tc", ["a", "b", "c"]),
        ("a b, c", ["a b", "c"]), ('"x | y"|z', ["x | y", "z"]), (r"a\, b, c", ["a, b", "c"]), ('5" floppies,a', ['5" floppies', "a"]), ("ana's laptop;b", ["ana's laptop", "b"]),
        ('"so ""gold"", 2", b', ['so "gold", 2', "b"]), (r'"so \"gold\", 2"', ['so "gold", 2']), ("'so \"gold\", 2'", ['so "gold", 2']), ('"it\'s ours, mostly"', ["it's ours, mostly"]),
        ('["a", "b, c", null, " "]', ["a", "b, c"]), ("['a', \"b's\"]", ["a", "b's"]), ('["a"', ['["a"']), ("a,a", ["a", "a"]), ('"a', ['"a']), ('""', []), ('"a" b, c', ['"a" b', "c"]), ("a|", ["a"]),
    ],
)
def test_split_tags(text: str | None, want: list[str]) -> None:
    assert TAGS.split(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/a:/b", ["/a", "/b"]), ("/a/db:x", ["/a/db:x"]), ("/a/db:xy:/b", ["/a/db:xy", "/b"]), ("/a:/b:", ["/a", "/b"]), ("/a : /b", ["/a", "/b"]), ("C:/x", ["C:/x"]), ("C:\\x;D:\\y", ["C:\\x", "D:\\y"]), ("'X:\\S\\m, s'; D:\\S", ["X:\\S\\m, s", "D:\\S"]),
        (r"/data/old\; new | /b", ["/data/old; new", "/b"]), ('["C:\\\\a"]', ["C:\\a"]), ('["/r\\u00e9s"]', ["/rés"]), ('"/a b":/c', ["/a b", "/c"]), ("\\\\host\\share,/b", ["\\\\host\\share", "/b"]),
    ],
)
def test_split_paths(text: str, want: list[str]) -> None:
    assert PATHS.split(text) == want


def test_long_and_hostile_values() -> None:
    assert TAGS.split('"a,' * 20_000)[0] == '"a'
    assert len(TAGS.split("x," * 100_000)) == 100_000
    assert TAGS.split('"' * 50_001)


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1).map(str.strip).filter(lambda x: x.strip(packed_fields.BLANKS) == x and x), min_size=2, max_size=5))
@settings(max_examples=200, deadline=None)
def test_quoted_values_come_back(entries: list[str]) -> None:
    packed = ", ".join('"' + e.replace('"', '""') + '"' for e in entries)
    if not any(e.endswith("\\") or "\\\"" in e.replace('"', '""') for e in entries):
        assert TAGS.split(packed) == entries


def test_packed_entries(spark) -> None:
    marks = spark.createDataFrame([(1, "a,b", "x"), (1, "a,b", "x"), (2, None, "x"), (3, " ", "x"), (4, "a;a", "y")], "id bigint, tags string, entry string")
    tasks = spark.createDataFrame([(1, "/a:/b"), (2, "/x y"), (3, "/z")], "id bigint, paths_to_backup string")
    rows = packed_fields.packed_entries(marks, tasks).collect()
    assert sorted(map(tuple, rows)) == [("archive_bookmarks", 1, 0, "a"), ("archive_bookmarks", 1, 1, "b"), ("archive_bookmarks", 4, 0, "a"), ("archive_bookmarks", 4, 1, "a"), ("scheduled_tasks", 1, 0, "/a"), ("scheduled_tasks", 1, 1, "/b"), ("scheduled_tasks", 2, 0, "/x y"), ("scheduled_tasks", 3, 0, "/z")]
    assert packed_fields.packed_entries(marks.limit(0), tasks.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 10_000])
def test_marks_are_told_alike_at_every_size(spark, n: int) -> None:
    """A usual mark that is text in every value that holds it is text, however many these are; true marks separate."""
    rng = random.Random(n)
    tags = [f"tag{i}" for i in range(max(20, n // 20))]
    rows = []
    for i in range(3 * n):
        own = rng.sample(tags, rng.randint(1, 5))
        rows.append((i, [", ".join(own), ";".join(own), f"this {i}|that {i}"][i % 3]))
    reader, _ = packed_fields.infer(spark.createDataFrame(rows, "id bigint, v string").select("v"))
    assert set(reader.separators.strong) == {",", ";"} and not reader.separators.weak


def test_weak_marks(spark) -> None:
    """A mark that separates in few values does so only where all pieces are regular."""
    words = ["red", "green", "blue", "grey"]
    rows = [(i, words[i % 4]) for i in range(40)] + [(100 + i, f"k{i}:v{i}") for i in range(90)] + [(300 + i, f"{words[i % 4]}:{words[(i + 1) % 4]}") for i in range(10)]
    found = packed_fields.unpack(spark.createDataFrame(rows, "id bigint, v string"), "id", "v").collect()
    by = defaultdict(list)
    for r in sorted(found):
        by[r.record_id].append(r.entry)
    assert by[0] == ["red"] and by[100] == ["k0:v0"] and by[300] == ["red", "green"]


# --- 2: snapshot changes ---------------------------------------------------------------------


@given(st.sets(st.integers(0, 200_000)), st.sets(st.integers(0, 200_000)))
@settings(max_examples=50, deadline=None)
def test_bitmaps(a: set[int], b: set[int]) -> None:
    x, y = (Bitmap.of(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
    assert x.ordinals().tolist() == sorted(a) and len(x) == len(a)
    assert x.and_not(y).ordinals().tolist() == sorted(a - b)
    assert x.and_(y).ordinals().tolist() == sorted(a & b)


def test_full_bitmaps() -> None:
    x, y = Bitmap.of(np.arange(0, 150_000, 2)), Bitmap.of(np.arange(0, 150_000, 3))
    assert x.and_not(y).ordinals().tolist() == [i for i in range(0, 150_000, 2) if i % 3]
    assert y.and_(x).ordinals().tolist() == list(range(0, 150_000, 6))
    assert len(x.and_not(x)) == 0


ITEMS = "item_id bigint, archive_name string, path string, size bigint, attrs struct<mtime:bigint>, chunks array<string>, seq int, n_rows string, repo_path int"
ARCHIVES = "archive_name string, archive_time timestamp_ntz, repo_path string, seq string"


def _trees(seed: int) -> tuple[list, list]:
    rng, items, archives, n = random.Random(seed), [], [], 0
    for repo in range(3):
        for t in range(rng.randint(1, 5)):
            name = f"a{rng.randrange(10**6)}-{repo}-{t}"
            archives.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(days=t), f"r{repo}", "x"))
            for _ in range(rng.choice([0, 1, 30])):
                n += 1
                p = rng.choice(["", "./", "/"]) + f"d/{rng.randrange(25)}" + rng.choice(["", "/"])
                c = rng.choice([None, [], ["AB"], ["ab", None], ["ab", " "], ["sha256:ab", "cd"], ["cd", "ab"]])
                items.append((n, name, rng.choice([p, p, p, None]), rng.choice([1, 2, None]), rng.choice([(5,), (5,), (6,), None]), c, 1, "x", 2))
    return items + items[:5], archives + archives[:1]


def _changes_by_hand(items: list, archives: list) -> set:
    held = {i[1] for i in items}
    plain = lambda p: "/".join(x for x in p.split("/") if x not in ("", "."))
    ids = lambda c: tuple(x.strip().lower().removeprefix("sha256:") for x in c or [] if x and x.strip())
    repos, out = defaultdict(list), set()
    for name, time, repo, _ in sorted(set(archives), key=lambda a: (a[1], a[0])):
        if name in held:
            repos[repo].append(name)
    for repo, names in repos.items():
        trees = []
        for name in names:
            tree = {}
            for i in sorted((i for i in items if i[1] == name and i[2] is not None), key=lambda i: i[0]):
                tree[plain(i[2])] = (i[3], i[4] and i[4][0], ids(i[5]))
            trees.append(tree)
        for a, b, name in zip(trees, trees[1:], names[1:], strict=False):
            out |= {(repo, name, p, "added") for p in b.keys() - a.keys()} | {(repo, name, p, "removed") for p in a.keys() - b.keys()} | {(repo, name, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_snapshot_changes(spark, seed: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(snapshot_changes, "BLOCK_ROWS", 8)  # trees are split into many blocks
    items, archives = _trees(seed)
    found = snapshot_changes.snapshot_changes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(archives, ARCHIVES)).collect()
    assert len(found) == len(set(found))
    assert set(map(tuple, found)) == _changes_by_hand(items, archives)


def test_snapshot_changes_of_nothing(spark) -> None:
    items, archives = spark.createDataFrame([], ITEMS), spark.createDataFrame([], ARCHIVES)
    found = snapshot_changes.snapshot_changes(items, archives)
    assert found.count() == 0 and found.columns == ["repo_path", "archive_name", "path", "change_kind"]


# --- 3: seen keys ----------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [9, 12, 33, 47, 64])
def test_quotient_filter(bits: int) -> None:
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 3000):
        a, b, ask = (np.unique(rng.integers(0, 2**bits - 1, k, dtype=np.uint64)) for k in (n, n, 5000))
        f = QuotientFilter(a, bits)
        assert (f.fingerprints() == a).all()
        ask = np.concatenate((ask, a))
        assert (f.contains(ask) == np.isin(ask, a)).all()
        assert (f.merge(QuotientFilter(b, bits)).fingerprints() == np.union1d(a, b)).all()


def test_cascade_is_small() -> None:
    rng, c = np.random.default_rng(1), Cascade(40)
    keys = rng.permutation(np.unique(rng.integers(0, 2**40, 60_000, dtype=np.uint64)))
    for part in np.array_split(keys, 20):
        assert not c.contains(part).any()
        c.add(np.sort(part))
    assert c.contains(keys).all()
    assert c.nbytes < 6 * len(keys) and len(c.levels) < 6


def test_seen_records(spark, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.35 else rng.choice([f"k{rng.randrange(600)}", f"k{rng.randrange(600)}x", None, "seed"])) for i in range(3000)]
    rows += rng.sample(rows, 300) + [(None, "hot"), (None, None)]
    rng.shuffle(rows)
    monkeypatch.setattr(seen_filter, "LOCAL_ROWS", 100)
    records = spark.createDataFrame(rows, "record bigint, key string").repartition(5)
    register = spark.createDataFrame([("seed",), (None,), ("seed",)], "key string")
    found = [r.record for r in seen_filter.seen_records(records, register).collect()]
    first, want = {}, set()
    for i, k in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        if k == "seed" or k in first:
            want.add(i)
        first.setdefault(k, i)
    assert len(found) == len(set(found)) and set(found) == want
    assert seen_filter.seen_records(records.limit(0), register).count() == 0


def test_width_holds_at_any_size() -> None:
    for n in (10**3, 10**6, 10**9, 10**12):
        bits = sum(seen_filter.filter_bits(n, max(8, n // seen_filter.RANGE_ROWS)))
        assert mean_wrong(n, bits) <= seen_filter.WRONG
    assert seen_filter.filter_bits(10**9, 1000)[1] <= 64


def test_error_rates_are_as_derived(spark) -> None:
    records = spark.range(40_000).select(F.col("id").alias("record"), F.col("id").cast("string").alias("key"))
    rows = {r.bits: r for r in seen_filter.seen_error_report(records, records.select("key").limit(0), (14, 18, 40)).collect()}
    assert rows[40].n_wrong == 0
    for bits in (14, 18):
        assert rows[bits].measured_wrong == pytest.approx(rows[bits].derived_wrong, rel=0.15)
    assert mean_wrong(0, 20) == 0


# --- 4: intervals ----------------------------------------------------------------------------


def _periods_by_hand(rows: list) -> set:
    out, by = set(), defaultdict(list)
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a <= b:
            by[e].append((a, b))
    for e, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "period", a, b) for a, b in merged} | {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_periods_and_gaps(spark, seed: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(intervals, "ROWS_PER_TASK", 12)  # entities span many partitions
    rng, rows = random.Random(seed), []
    for _ in range(240):
        a = rng.randrange(4000)
        rows.append((rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([a, a, a, None]), a + rng.choice([0, 1, 5, 30, 30, 900 if seed % 2 else 40, -3])))
    rows += rows[:20]
    found = intervals.periods_and_gaps(spark.createDataFrame(rows, "entity string, start_us bigint, end_us bigint")).collect()
    assert len(found) == len(set(found))
    assert set(map(tuple, found)) == _periods_by_hand(rows)


HISTORY = "id bigint, job_name string, start_time string, end_time string, status string, files_processed bigint, bytes_processed bigint, entity int"


def test_job_periods(spark) -> None:
    t = "2024-01-01T00:00:{:02d}Z".format
    rows = [(1, "j", t(0), None, "running", 1, 1, 0), (1, "j", t(0), t(5), "success", 1, 1, 0), (1, "j", t(0), t(5), "success", 1, 1, 0), (2, "j", t(5), t(7), "success", 1, 1, 0), (3, "j", t(9), t(8), "failed", 1, 1, 0), (4, "j", "n/a", t(9), "failed", 1, 1, 0), (5, None, t(1), t(2), "failed", 1, 1, 0), (6, "j", t(20), t(20), "success", 1, 1, 0)]
    base = 1704067200_000000
    found = {(r.job_name, r.kind, r.start_us - base, r.end_us - base) for r in intervals.job_periods(spark.createDataFrame(rows, HISTORY)).collect()}
    assert found == {("j", "period", 0, 7_000_000), ("j", "period", 20_000_000, 20_000_000), ("j", "gap", 7_000_000, 20_000_000)}
    assert intervals.job_periods(spark.createDataFrame([], HISTORY)).count() == 0


# --- 5: orphan references --------------------------------------------------------------------


@pytest.mark.parametrize("bound", [10**6, 0])
def test_orphan_references(spark, bound: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(orphans, "fits", lambda df, rows=bound: df.limit(rows + 1).count() <= rows)
    monkeypatch.setattr(orphans, "HEAVY_SHARE", 0.2)
    k = [f"{i:064x}" for i in range(6)]
    day = lambda d: dt.datetime(2024, 1, d)
    items = spark.createDataFrame([(1, "a", [k[0], k[1].upper(), None, " "]), (1, "a", [k[0], k[1].upper(), None, " "]), (2, "a", None), (3, "a", [k[2], k[2]]), (4, "b", [k[3], "ABC", k[0]]), (5, "zz", [k[4]]), *[(100 + i, "b", [k[4]]) for i in range(30)]], "item_id bigint, archive_name string, chunks array<string>")
    archives = spark.createDataFrame([("a", day(5), "r", k[0]), ("b", day(20), "r", "0x" + k[5]), ("b", day(20), "r", "0x" + k[5]), ("c", None, "r", None)], "archive_name string, archive_time timestamp_ntz, repo_path string, id string")
    reports = spark.createDataFrame([(7, day(9), [k[1], k[1]], None), (8, day(2), None, [k[2], ""])], "report_id bigint, report_time timestamp_ntz, missing_chunks array<string>, orphaned_chunks array<string>")
    store = spark.createDataFrame([(k[0], day(1), None), (k[1], day(1), day(2)), (k[1], day(2), day(30)), (k[2], day(4), day(5)), (" " + k[2], day(3), None), (k[3], day(25), None), ("ABC", day(1), None)], "chunk_id string, stored_at timestamp_ntz, deleted_at timestamp_ntz")
    seeds = spark.createDataFrame([(k[5], day(1))], "chunk_id string, stored_at timestamp_ntz")
    found = orphans.orphan_references(items, archives, reports, store, seeds)
    f = "archive_items.chunks"
    want = {(f, "1", k[1], "deleted", "2024-01"), (f, "4", k[3], "later", "2024-01"), (f, "4", "abc", "absent", "2024-01"), (f, "5", k[4], "absent", None), ("verify_reports.missing_chunks", "7", k[1], "deleted", "2024-01"), ("verify_reports.orphaned_chunks", "8", k[2], "later", "2024-01")} | {(f, str(100 + i), k[4], "absent", "2024-01") for i in range(30)}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in want:
        by[(r[0], r[4], r[3])].append(r[2])
    counts = {(r.ref_field, r.period, r.reason): (r.n_references, r.n_ids) for r in orphans.orphan_counts(items, archives, reports, store, seeds).collect()}
    assert counts == {k: (len(v), len(set(v))) for k, v in by.items()}
    none = [x.limit(0) for x in (items, archives, reports, store, seeds)]
    assert orphans.orphan_references(*none).count() == orphans.orphan_counts(*none).count() == 0
    assert orphans.orphan_references(items, archives, reports, *none[3:]).count() > 30


def test_orphan_counts_within_a_month(spark) -> None:
    """Of the references to a key in the month of its first record some are later, some are not; copies count once."""
    key, day = "a" * 64, lambda d: dt.datetime(2024, 1, d)
    items = spark.createDataFrame([(i, f"n{i}", [key, key.upper()] if i % 2 else [key, None, key]) for i in range(1, 21)] * 2, "item_id bigint, archive_name string, chunks array<string>")
    archives = spark.createDataFrame([(f"n{i}", day(i), "r", None) for i in range(1, 21)], "archive_name string, archive_time timestamp_ntz, repo_path string, id string")
    reports = spark.createDataFrame([], "report_id bigint, report_time timestamp_ntz, missing_chunks array<string>, orphaned_chunks array<string>")
    store = spark.createDataFrame([(key, day(8), None)], "chunk_id string, stored_at timestamp_ntz, deleted_at timestamp_ntz")
    seeds = store.select("chunk_id", "stored_at").limit(0)
    assert [tuple(r) for r in orphans.orphan_counts(items, archives, reports, store, seeds).collect()] == [("archive_items.chunks", "2024-01", "later", 7, 1)]


# --- 6: rolling totals -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_rolling_totals(spark, seed: int) -> None:
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(19_000, 19_600), -3, None] if seed == 1 else [rng.randrange(19_000, 19_400)]), rng.choice([None, -5, rng.randrange(2**55)])) for _ in range(80)] + [("one", 19_000, 1)]
    found = rolling.rolling_totals(spark.createDataFrame(rows, "entity string, day int, v bigint"), ["v"], [7, 30]).collect()
    by = defaultdict(lambda: defaultdict(int))
    for e, d, v in rows:
        if e is not None and d is not None:
            by[e][d] += max(v or 0, 0)
    want = {(e, d, sum(x for k, x in days.items() if d - 7 < k <= d), sum(x for k, x in days.items() if d - 30 < k <= d)) for e, days in by.items() for d in range(min(days), max(days) + 1)}
    assert len(found) == len(want) and set(map(tuple, found)) == want


def test_job_rolling_totals(spark) -> None:
    rows = [(1, "j", "2024-01-01T23:30:00-01:00", None, "running", None, 5, 0), (2, "j", "2024-01-04T00:00:00Z", "n/a", "failed", 3, -1, 0), (2, "j", "2024-01-04T00:00:00Z", None, "running", 9, 9, 0), (3, "j", "", None, "failed", 1, 1, 0)]
    found = [tuple(r) for r in rolling.job_rolling_totals(spark.createDataFrame(rows, HISTORY)).orderBy("run_day").collect()]
    assert found == [("j", "2024-01-02", 0, 0, 5, 5), ("j", "2024-01-03", 0, 0, 5, 5), ("j", "2024-01-04", 3, 3, 5, 5)]
    assert rolling.job_rolling_totals(spark.createDataFrame([], HISTORY)).count() == 0
