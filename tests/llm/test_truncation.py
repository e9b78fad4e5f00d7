from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import queries, truncation
from chunkloom.llm.truncation import ending, features

DOC = "doc_id bigint, text string, source string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A whole one.", "terminated"), ('He said "so."', "terminated"), ("終わりです。", "terminated"), ("cut in the mi", "bare"), ("cut in the mi…", "marked"), ("cut in [more]", "marked"), ("cut...", "marked"), ("broken �", "partial"), ("in a [ur", "partial"),
        ("in a <blockq", "partial"), ("in &nb", "partial"), (r"in \u00", "partial"), ("in <blockq…", "partial"), ("a [b]bold[/b]", "tag"), ("[deleted]", "tag"), ("fine :)", "picture"), ("fine 👍", "picture"), ("as I said,", "unfinished"), ("list\n* one\n*", "unfinished"), ("a (", "unfinished"),
        ("5 < 6", "bare"), ("", "bare"),
    ],
)
def test_ending(text: str, want: str) -> None:
    assert ending(text) == want


def test_features() -> None:
    text = "One. The old pump\n* that valve"
    assert features(text, 3) == features("ONE", 3) != features("on", 2)
    assert set(features(text, 17)) == set(features("the old pump", 12))
    assert features(text, len(text)) == features("- That valve", 12)  # marks of list items are alike
    assert features("終わりです", 5) and features("", 0) == [] and len(features("a b c d e f g h", 15)) <= truncation.WIDTH
    assert features("x" * 100_000, 100_000)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a (b) [c] {d}", []), ("a (b", ["bracket"]), ("sad :( and ;-( so", []), ("a) one\nb) two", []), ("[url=x]y[/url] <i>z</i><br><p>", []), ("<i>z", ["tag"]), ("[color=red]z.", ["tag"]),
        ("[code]if (x) {", ["code"]), ("[code]if (x) {[/code]", []), ("```\n(\n```", []), ("```\nx", ["code"]), ('he said "so" and', []), ('he said "so and', ["mark"]), ('5" wide', []), ("„so“ er", []), ("„so er", ["mark"]), ("“so” it", []), ("« si » et « non", ["mark"]),
        ("[quote]a (b[/quote] c", []), ("> a (b\nc", []), ("&gt; a (b\nc", []), ("[quote]a [quote]b st […][/quote] c", []), ("[quote]a [quote]b.[/quote] c", ["quote"]), ("「終わり", ["bracket"]), ("", []),
    ],
)
def test_open_at_end(text: str, want: list[str]) -> None:
    assert truncation.open_at_end(text) == want


def test_deep_nesting_takes_linear_time() -> None:
    assert truncation.open_at_end("(" * 200_000) == ["bracket"]
    assert truncation.open_at_end("[b](" * 50_000 + "[/b]" * 50_000) == []


def test_open_structures_decide(spark) -> None:
    """Cut behind a sentence inside code that the source always closes; open quotes are nothing in a source that leaves them open."""
    rng = random.Random(11)
    rows, cut, loose = [], set(), set()
    for i, text, _ in corpus(rng, 3000):
        body = text.split("\n")[0]
        source = "tidy" if i % 2 else "loose"
        if source == "loose" and i % 10 == 0:
            text = f"[quote]{text}"
            loose.add(i)
        elif i % 6 == 1:
            at = rng.randint(20, len(body) - 2)
            text = f"{body} [code]{body[: at + (body[at - 1] == ' ')]}"
            if ending(text) == "terminated":
                cut.add(i)
        elif source == "tidy":
            text = f"[code]{body}[/code] {text}"
        rows.append((i, text, source))
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert cut and cut <= found
    assert not loose & found


def corpus(rng: random.Random, n: int) -> list[tuple[int, str, str]]:
    subjects = ["the old pump", "my second lathe", "a borrowed kettle", "our workshop roof", "the garden robot", "that brass valve"]
    verbs = ["keeps slipping", "came loose", "started to rattle", "needs more oil", "turned out fine", "arrived broken"]
    tails = ["", " during the long weekend", " after the last frost", " in spite of three coats of varnish", " without any warning from the display"]
    out = []
    for i in range(n):
        text = " ".join((f"{rng.choice(subjects)} {rng.choice(verbs)}{rng.choice(tails)}" + rng.choice([".", ".", ".", "!", "?"])).capitalize() for _ in range(rng.randint(2, 9)))
        text += rng.choice(["", "", "", "\ncheers", "\nhope that helps", "\n-- \nJo\nmeasure twice"])
        out.append((i, text, rng.choice(["a", "b"])))
    return out


def test_cuts_are_found(spark) -> None:
    rng = random.Random(7)
    rows, cut = [], set()
    for i, text, source in corpus(rng, 3000):
        if i % 15 == 0:
            at = rng.randint(20, len(text) - 2)
            body, text = text, text[:at]
            if ending(text) in ("terminated", "tag") or body[at - 1 : at + 1].strip() in ("", "\n"):
                text = body
            else:
                cut.add(i)
        elif source == "b" and len(text) > 200:
            text = text[:200]
            if ending(text) != "terminated":
                cut.add(i)
        rows.append((i, text, source))
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOC).withColumn("share", F.lit("clash"))).collect()}
    assert len(found & cut) >= 0.9 * len(cut)
    assert len(found - cut) <= 0.03 * len(cut)


def test_limits(spark) -> None:
    rng = random.Random(3)
    rows = [("s", rng.randint(100, 499), rng.randint(100, 900), n, rng.random() < 0.02) for n in range(400)] + [("s", 500, 600 + n, 1000 + n, True) for n in range(60)] + [("s", 300, 300, 7, True)] * 90
    rows = [(a, b, max(b, c), h, u) for a, b, c, h, u in rows]
    limits = truncation.field_limits(spark.createDataFrame(rows, "source string, n_chars bigint, n_bytes bigint, text_hash bigint, unfinished boolean")).collect()
    assert ("s", "chars", 500) in {(r.source, r.unit, r.top) for r in limits}
    assert not any(r.top == 300 for r in limits)  # reposts of one text are no limit


def novel(rng: random.Random) -> str:
    """A sentence of made-up words that occur nowhere else."""
    return " ".join("".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(6, 14)))


def test_texts_that_repeat_nothing(spark) -> None:
    """Informal ends of unseen words are whole; unclosed structures and cuts at a field limit are found."""
    rng = random.Random(23)
    rows, informal, unclosed, limited = [], set(), set(), set()
    for i in range(4000):
        text = ". ".join(novel(rng).capitalize() for _ in range(rng.randint(2, 6)))
        source = rng.choice(["x", "y", "z"])
        if i < 1000:
            source, text = "chat", text
            informal.add(i)
        elif i < 1100:
            text = f'{text} (and [quote]{novel(rng)}.' if i % 2 else f"{text}. (He said {novel(rng)}."
            unclosed.add(i)
        elif source == "z" and len(text) > 240:
            text = text[:240]
            if ending(text) == "bare":
                limited.add(i)
        else:
            text += "."
        rows.append((i, text, source))
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert len(found & informal) <= 10
    assert unclosed <= found
    assert len(limited) > 100 and len(found & limited) >= 0.95 * len(limited)
    assert len(found - informal - unclosed - limited) <= 20


def test_edge_cases(spark) -> None:
    rows = [(1, None, "s"), (2, "", None), (3, " \n", "s"), (4, "One whole text.", None), (5, "…", "s"), (6, "word", "s"), (7, "x" * 100_000, "s"), (8, "a b " * 20_000 + "<blockqu", "s"), (8, "a b " * 20_000 + "<blockqu", "s")]
    docs = spark.createDataFrame(rows, DOC)
    found = [r.doc_id for r in truncation.truncated(docs).collect()]
    assert 8 in found and not {1, 2, 3, 4} & set(found)
    assert truncation.truncated(docs.limit(0)).count() == 0
    report = {r.source: (r.n_posts, r.n_cut) for r in truncation.truncation_by_source(docs).collect()}
    assert report[""] == (2, 0) and report["s"][0] == 7


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data: str, name: str) -> None:
    assert queries.QUERIES[name](spark, data).count() > 0
