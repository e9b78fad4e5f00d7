"""Texts that lost their end to a field limit or a broken transfer.

A stack automaton walks each whole text and keeps the open quotes, brackets, quotation marks, tags
and code blocks. How the text ends is read off its end: inside a tag, an entity, an escape or a
broken multibyte sequence, behind a mark after which more must follow, with a mark of shortening,
with a terminator, or without one (bare). A text with something open behind its terminator is
a cut unless that is a habit of its source. For bare ends, what is open raises the odds: how often texts
that look cut leave that open is held against how often whole texts of the source do. A missing terminator is held against the baseline of the source: the share of its
bare ends that are cuts, apart for posts at a field limit and others, and how its whole posts end.

How much a bare end looks like the end of a thought is told by a logistic model over its last
words. It is fitted on a bounded sample of texts (``FIT_POSTS``), which label themselves: the
places where segments end against places drawn at random. Ends whose words the model never met
carry no weight, so the source's baseline decides them. Everything else, automaton, baselines and
field limits, covers all texts. The texts are walked once and not shuffled.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import strip
from chunkloom.session import cut, small_side, spread

#: Texts at most that the end model is fitted on, places of either kind that each gives if there are so many, and if there are few.
FIT_POSTS, FIT_PLACES, MOST_PLACES = 20_000, 8, 40
#: Weights of the model, and distinct texts in which a feature must occur.
WEIGHT_BITS, FEATURE_TEXTS = 21, 3
#: Passes of the fit, its step and its penalty.
EPOCHS, STEP, PENALTY = 4, 0.3, 1e-6
#: One text in so many is left out of the fit and sets its scale.
HELD_OUT = 5
#: Characters between two segment ends, for the odds of a cut that falls on a segment end.
SEGMENT_CHARS = 70.0
#: Scores are kept as whole numbers within +-LOUD; only those below zero speak for a cut.
LOUD = 12
#: Ratio from which a score tells a cut by itself, and weight, in posts, of all sources beside one.
DECISIVE, BACKED = 20.0, 50.0
#: Share of the ends of a source that leave a structure open from which that is its habit.
HABIT = 0.15
#: Log-likelihood ratio above which posts of one length are a field limit; share of them that must look unfinished.
LIMIT_EVIDENCE, LIMIT_UNFINISHED = 12.0, 0.25
#: Lengths below a limit that posts may have if it keeps words whole.
WORD_DEPTH = 12
#: Marks that a shortened text ends with (fixed values).
MARKS = ("…", "...", "[more]", "[…]", "(more)", "[...]")

_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_FOLDED = str.maketrans("123456789*•", "000000000--")
#: A terminator ends a segment if a blank follows it. Searched backwards.
_BREAK = regex.compile(r"(?r)[.!?…](?=\s)|[。！？\n\r<>\[\]\p{Extended_Pictographic}]")
#: Where segments may end in the midst of a text: behind a letter or digit they do.
_SEGMENT_END = re.compile(r"[.!?](?=\s)|[。！？]|[ \t]*[\n\r]")
_ENDING_FOLLOWS = regex.compile(r"[^\S\n\r]*(?:[.!?…。！？\n\r]|\Z)")
_CLOSERS = "\"'”’»)] \t\n\r"
_TERMINAL = _CLOSERS + ".!?。！？"
_TAG_AT_END = regex.compile(r"\[/?[\w]+(?:=[^\[\]\n]*)?\]\s*\Z|</?[\w]+(?:\s[^<>\n]*)?/?>\s*\Z|\[[\p{L} ]+\]\s*\Z")
_PARTIAL_TAG = regex.compile(r"<(?:/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?)?\Z|\[(?:/?[A-Za-z]*(?:=[^\[\]\n]*)?)?\Z")
_PARTIAL_ENTITY = regex.compile(r"&(?:#?[A-Za-z0-9]{0,7})\Z")
_PARTIAL_ESCAPE = regex.compile(r"(?:\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%(?:[0-9A-F])?)\Z")
_PICTURE = regex.compile(r"(?:\p{Extended_Pictographic}️?|(?<![\p{L}\p{N}])(?:[:;=][-^']?[DdPpOo)(/\\|3]|[xX]D|\^_?\^|<3))\s*\Z")
#: A bare text never ends with one of these, nor with the mark of a list item or quote alone.
_UNFINISHED = regex.compile(r"(?:[,(、]|\s[:;]|\n[ \t>]*(?:[-*•]|>))\s*\Z")
_QUOTING = {"quote", "blockquote"}
#: What the automaton reads: a quoted line, tags that are closed again, fences, brackets, quotation marks.
_STRUCTURE = regex.compile(
    r"(?P<line>^(?:>|&gt;)[^\n]*)|(?P<fence>```)"
    r"|\[(?P<off>/)?(?P<square>quote|code|spoiler|hide|b|i|u|s|url|email|img|video|youtube|size|color|font|list|table|left|right|center|indent|sub|sup)(?:=[^\[\]\n]*)?\]"
    r"|<(?P<end>/)?(?!(?:br|hr|img|input|wbr|p|li|dt|dd|td|th|tr)\b)(?P<angle>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>\n]*)?(?<!/)>"
    r"|(?<![:;=]|[:;=][-^'])(?P<up>[(\[{「『（【《])|(?P<down>[)\]}」』）】》])"
    r"|(?P<mark>[“”„«»]|(?<![\p{L}\p{N}\p{P}])\"(?=\S)|(?<=\S)\")",
    regex.IGNORECASE | regex.MULTILINE,
)
#: Where a structure may begin; most characters are passed over by this alone.
_BEGINS = re.compile(r"^(?:>|&gt;)|[`\[<({「『（【《)\]}」』）】》“”„«»\"]", re.MULTILINE)
_DOWN = dict(zip(")]}」』）】》", "([{「『（【《", strict=True))
#: Classes of open structures, each with rates of its own.
CLASSES = ("quote", "code", "tag", "bracket", "mark")
_CLASS = {"quote": "quote", "blockquote": "quote", "cite": "quote", "code": "code", "pre": "code", "```": "code"} | dict.fromkeys(_DOWN.values(), "bracket") | dict.fromkeys("“„«»\"", "mark")
_SHORTENED = regex.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.|more|snip)\]|\(more\))\s*\Z", regex.IGNORECASE)
_PAIRS = {"“": "„", "”": "“„", "»": "«", "«": "»", '"': '"'}


class _Frame:
    """Brackets and quotation marks opened since a tag; they are closed only there."""

    __slots__ = ("held", "name", "open")

    def __init__(self, name: str) -> None:
        self.name, self.open, self.held = name, [], {}

    def push(self, mark: str) -> None:
        self.open.append(mark)
        self.held[mark] = self.held.get(mark, 0) + 1

    def close(self, mark: str) -> None:
        top = None
        while top != mark:
            top = self.open.pop()
            self.held[top] -= 1


def open_at_end(text: str) -> list[str]:
    """Classes of what is open at the end of a text.

    A closing tag closes all that was opened inside it; behind a mark of shortening it closes the
    quotes around it as well, as quoted text that was shortened lost their ends. Nothing is read in
    quoted lines, and in code only the end of the code. Takes time in proportion to the text.
    """
    if "&" in text:
        text = html.unescape(text)
    frames, tags = [_Frame("")], {}

    def start(name: str) -> None:
        frames.append(_Frame(name))
        tags[name] = tags.get(name, 0) + 1

    def close(name: str) -> None:
        top = None
        while top != name:
            top = frames.pop().name
            tags[top] -= 1

    after = 0
    for begin in _BEGINS.finditer(text):
        if begin.start() < after or not (m := _STRUCTURE.match(text, begin.start())):
            continue
        after, kind, frame = m.end(), m.lastgroup, frames[-1]
        if kind == "line":
            continue
        name = (m["square"] or m["angle"] or m[0]).lower() if kind in ("square", "angle") else m[0]
        off = kind in ("square", "angle") and bool(m["off"] or m["end"])
        if _CLASS.get(frame.name) == "code" and not (name == frame.name and (off or kind == "fence")):
            continue
        if kind == "fence":
            close(name) if tags.get(name) else start(name)
        elif kind in ("square", "angle"):
            if not off:
                start(name)
            elif tags.get(name):
                close(name)
                if name in _QUOTING and tags.get(name) and _SHORTENED.search(text, max(0, m.start() - 20), m.start()):
                    while any(tags.get(x) for x in _QUOTING):
                        close(next(f.name for f in reversed(frames) if f.name in _QUOTING))
        elif kind == "up":
            frame.push(name)
        elif kind == "down":
            if frame.held.get(_DOWN[name]):
                frame.close(_DOWN[name])
        else:
            opened = next((x for x in _PAIRS.get(name, "") if frame.held.get(x)), None)
            left, right = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if opened:
                frame.close(opened)
            elif name in "“„" or (name in '«»"' and not left.strip() and (name == "«" or right.strip())):
                frame.push(name)
    classes = {_CLASS.get(f.name, "tag") for f in frames[1:]}
    return sorted(classes.union(*({_CLASS[x] for x in set(f.open)} for f in frames)))


def ending(text: str) -> str:
    """How a text ends: ``partial`` (in a tag, entity, escape or multibyte sequence), ``marked``,
    ``terminated``, ``tag``, ``picture``, ``unfinished`` (behind a mark that more must follow) or ``bare``."""
    end = text.rstrip()
    if end.endswith("\ufffd"):
        return "partial"
    bare = unmarked(end)
    if len(bare) < len(end):
        return "partial" if _in_tag(bare) or _PARTIAL_ENTITY.search(bare, max(0, len(bare) - 9)) else "marked"
    near = max(0, len(end) - 12)
    if _PICTURE.search(end, near):
        return "picture"
    if _in_tag(end) or _PARTIAL_ENTITY.search(end, near) or _PARTIAL_ESCAPE.search(end, near):
        return "partial"
    if end.rstrip(_CLOSERS)[-1:] in tuple(".!?。！？"):
        return "terminated"
    at = max(end.rfind("["), end.rfind("<"))
    if end.endswith("```") or (at >= 0 and _TAG_AT_END.match(end, at)):
        return "tag"
    return "unfinished" if _UNFINISHED.search(end, end.rfind("\n") if "\n" in end else near) else "bare"


def _in_tag(text: str) -> bool:
    at = max(text.rfind("["), text.rfind("<"))
    return at >= 0 and bool(_PARTIAL_TAG.match(text, at))


def unmarked(text: str) -> str:
    """The text without a mark of shortening at its end."""
    end = text.rstrip()
    for mark in MARKS:
        if end.endswith(mark):
            return end[: -len(mark)]
    return end


def features(text: str, end: int) -> list[int]:
    """Hashed features of the words before ``end``: last words by number, the whole segment, last letters."""
    found = _BREAK.search(text, 0, max(end - 1, 0))
    segment = text[found.end() if found else 0 : end].lower().translate(_FOLDED).strip()
    if not segment:
        return []
    if _UNSPACED.match(segment, len(segment) - 1):
        parts = [f"c{segment[-k:]}" for k in (1, 2, 3, 5, 7, 9) if k <= len(segment)]
        parts += [f"s{segment}"] if len(segment) <= 24 else []
    else:
        words = segment.rsplit(None, 6)
        last = words[-6:]
        parts = [f"w{' '.join(last[-k:])}" for k in (1, 2, 3, 4, 6) if k <= len(last)]
        parts += [f"s{' '.join(words)}"] if len(words) <= 6 else []
        parts += [f"l{last[-1][-k:]}" for k in (2, 4) if k < len(last[-1])]
    return [1 + xxhash.xxh32_intdigest(x) % ((1 << WEIGHT_BITS) - 1) for x in parts]


#: Features of one place at most.
WIDTH = 8


def _random_place(rng: random.Random, text: str) -> int:
    """A place where a cut leaves a bare end, or 0 if the one drawn is none."""
    p = rng.randrange(1, len(text)) if len(text) > 1 else 0
    return p if p and text[p - 1].isalnum() and not _ENDING_FOLLOWS.match(text, p) else 0


def _places(per_text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Labelled places of the sampled texts: ends of segments and of texts (true), places drawn at random.

    The ends of whole texts, without their terminators, and the random places set the scale of the scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _places_of(batch, per_text)

    return run


def _places_of(batch: pa.RecordBatch, per_text: int) -> pa.RecordBatch:
    texts, ends, scales, rows = [], [], [], []
    for text, at in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
        rng, text = random.Random(at), text.rstrip()
        closed = [p for p in (m.start() for m in _SEGMENT_END.finditer(text)) if p and text[p - 1].isalnum()]
        places = [(p, True, False) for p in rng.sample(closed, min(per_text, len(closed)))]
        kind, bare = ending(text), len(text.rstrip(_TERMINAL))
        if kind == "terminated" and bare:
            places.append((bare, True, True))
        elif kind == "bare":
            places.append((len(text), True, False))
        drawn = (_random_place(rng, text) for _ in range(per_text))
        places += [(p, False, True) for p in drawn if p]
        for p, is_end, sets_scale in places:
            own = features(text, p)
            texts.append(at)
            ends.append(is_end)
            scales.append(sets_scale)
            rows.append(own + [0] * (WIDTH - len(own)))
    flat = pa.array(np.array(rows, np.int32).reshape(-1))
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(ends, pa.bool_()), pa.array(scales, pa.bool_()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * WIDTH + 1, WIDTH), pa.int32()), flat)], names=["text_hash", "is_end", "sets_scale", "features"])


def _slope(score: np.ndarray, label: np.ndarray, importance: np.ndarray) -> float:
    """Factor that makes scores log-odds on places of texts that were not fitted, by Newton's method; no constant, so unknown words stay at even odds."""
    slope = 1.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-slope * score))
        bend = float((importance * p * (1 - p) * score * score).sum())
        if bend < 1e-9:
            break
        slope = float(np.clip(slope - ((p - label) * importance * score).sum() / bend, 0.1, 10.0))
    return slope


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of a logistic model, place 0 unused; features met in few texts have none."""
    rows = pa.Table.from_batches(list(batches), schema=pa.schema([("text_hash", pa.int64()), ("is_end", pa.bool_()), ("sets_scale", pa.bool_()), ("features", pa.list_(pa.int32()))]))
    weights = np.zeros(1 << WEIGHT_BITS, np.float32)
    if rows.num_rows:
        label = rows["is_end"].to_numpy().astype(np.float32)
        x = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
        _, text = np.unique(rows["text_hash"].to_numpy(), return_inverse=True)
        pairs = np.unique((text[:, None] * np.int64(1 << WEIGHT_BITS) + x).ravel()) & ((1 << WEIGHT_BITS) - 1)
        known = np.bincount(pairs, minlength=1 << WEIGHT_BITS) >= FEATURE_TEXTS
        known[0] = False
        x = np.where(known[x], x, 0)
        share = float(np.clip(label.mean(), 0.01, 0.99))
        importance = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        squares, rng = np.full(1 << WEIGHT_BITS, 1e-6, np.float32), np.random.default_rng(5)
        held_out = text % HELD_OUT == 0
        fitted = np.flatnonzero(~held_out)
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(fitted), max(1, len(fitted) // 2048)):
                at = x[own]
                p = 1 / (1 + np.exp(-weights[at].sum(axis=1)))
                slots, where = np.unique(at, return_inverse=True)
                g = np.bincount(where.ravel(), np.repeat((p - label[own]) * importance[own], WIDTH), len(slots)).astype(np.float32) + PENALTY * weights[slots]
                squares[slots] += g * g
                weights[slots] -= STEP * g / np.sqrt(squares[slots])
                weights[0] = 0
        held_out &= rows["sets_scale"].to_numpy()
        weights *= _slope(weights[x[held_out]].sum(axis=1).astype(float), label[held_out], importance[held_out])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])


def end_model(texts: DataFrame) -> bytes:
    """Weights of the end model, of (text_hash, text); fitted on ``FIT_POSTS`` texts at most, drawn by hash."""
    n, draw = texts.count(), F.pmod(F.xxhash64("text_hash"), F.lit(1 << 30))
    sample = texts.where(draw < int((1 << 30) * min(1.0, FIT_POSTS / max(n, 1)))).limit(FIT_POSTS)
    per_text = max(FIT_PLACES, min(MOST_PLACES, FIT_POSTS * FIT_PLACES // max(n, 1)))
    places = spread(sample).mapInArrow(_places(per_text), "text_hash bigint, is_end boolean, sets_scale boolean, features array<int>")
    return bytes(places.repartition(1).mapInArrow(_fit, "weights binary").head()["weights"])  # one row of fixed size


def _walk(model: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text how it ends, what is open there, and the log-odds of an end against a random place:
    for its last words, without a terminator, and for a place in it drawn at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model.value, np.float32)

        def scores(rows: list[list[int]]) -> pa.Array:
            found = np.array([own + [0] * (WIDTH - len(own)) for own in rows], np.int32).reshape(-1, WIDTH)
            return pa.array(np.clip(np.rint(weights[found].sum(axis=1)), -LOUD, LOUD).astype(np.int32), mask=np.array([not own for own in rows], bool))

        for batch in batches:
            kinds, opened, ends, places = [], [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
                kind = ending(text)
                body = unmarked(text) if kind in ("partial", "marked") else text.rstrip()
                opened.append(open_at_end(body[: max(body.rfind("["), body.rfind("<"))] if kind == "partial" and _in_tag(body) else body))
                own = features(body, len(body.rstrip(_TERMINAL) if kind == "terminated" else body)) if kind in ("bare", "marked", "terminated") else []
                if kind == "bare" and not own:
                    kind = "wordless"
                kinds.append(kind)
                ends.append(own)
                p = _random_place(random.Random(at), body)
                places.append(features(body, p) if p else [])
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(kinds, pa.string()), pa.array(opened, pa.list_(pa.string())), scores(ends), scores(places)], names=[*kept.schema.names, "ending", "open", "score", "place"])

    return run


def field_limits(lengths: DataFrame) -> DataFrame:
    """(source, unit, top, depth): lengths at which a source cuts, of (source, n_chars, n_bytes, text_hash, unfinished).

    A spike is a length held by far more texts than those around it; a cliff is a length up to which,
    within a word, texts are far denser than further down and further up, as where words are kept
    whole. Both are told by a log-likelihood ratio (``LIMIT_EVIDENCE``), at any length and for any
    number of texts, and need a share of texts that look unfinished. Reposts of a text count
    once. ``depth`` is how far below ``top`` a cut text may end.
    """
    once = lengths.where(F.col("source") != "").select("source", "n_chars", "n_bytes", "text_hash", "unfinished").distinct()
    units = once.select("source", "unfinished", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("n_chars", "n_bytes"))).alias("unit", "length"))
    held = units.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if("unfinished").alias("cut"))
    by = Window.partitionBy("source", "unit").orderBy("length")

    def within(column: str, low: int, high: int) -> Column:
        return F.coalesce(F.sum(column).over(by.rangeBetween(low, high)), F.lit(0))

    def evidence(seen: Column, expected: Column) -> Column:
        return F.when(seen > expected, seen * F.log(seen / expected) - (seen - expected)).otherwise(0.0)

    counts = held.select(
        "source", "unit", "length", "n", "cut",
        (within("n", -100, 100) - F.col("n")).alias("around"),
        within("n", -WORD_DEPTH, 0).alias("here"),
        within("cut", -WORD_DEPTH, 0).alias("here_cut"),
        within("n", -WORD_DEPTH - 200, -WORD_DEPTH - 1).alias("below"),
        within("n", 1, 200).alias("above"),
    )
    spike = (evidence(F.col("n"), (F.col("around") + 0.5) / 200) >= LIMIT_EVIDENCE) & (F.col("cut") >= LIMIT_UNFINISHED * F.col("n"))
    wide = (WORD_DEPTH + 1) / 200
    cliff = (
        (evidence(F.col("here"), (F.col("below") + 0.5) * wide) >= LIMIT_EVIDENCE)
        & (evidence(F.col("here"), (F.col("above") + 0.5) * wide) >= LIMIT_EVIDENCE)
        & (F.col("above") * 4 <= F.col("below"))
        & (F.col("here_cut") >= LIMIT_UNFINISHED * F.col("here"))
        & (F.col("cut") > 0)
    )
    kinds = counts.withColumn("depth", F.when(spike, F.when(F.col("unit") == "bytes", 3).otherwise(0)).when(cliff, WORD_DEPTH))
    return kinds.where(F.col("depth").isNotNull()).select("source", "unit", F.col("length").alias("top"), "depth")


def _at_limit(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at_limit``: the post's length is one at which its source cuts."""
    looks_cut = F.col("ending").isin("partial", "unfinished", "marked") | ((F.col("ending") == "bare") & (F.col("score") < 0))
    limits = cut(field_limits(rows.withColumn("unfinished", looks_cut)))
    known = limits.groupBy("source").agg(F.collect_list(F.struct("unit", "top", "depth")).alias("limits"))
    hit = F.exists("limits", lambda x: F.when(x["unit"] == "chars", F.col("n_chars")).otherwise(F.col("n_bytes")).between(x["top"] - x["depth"], x["top"] + F.when(x["unit"] == "bytes", 2).otherwise(0)))
    return rows.join(small_side(known), "source", "left").withColumn("at_limit", F.coalesce(hit, F.lit(False))).drop("limits")


def baselines(rows: DataFrame) -> DataFrame:
    """(source, ending, at_limit, score, ratio, share_cut): what a score tells for a cut among the bare or marked ends of a source, and the share of cuts.

    A score is weighed by how often random places have it in all texts, against how often the ends
    of the source's whole posts, without their terminators, have it. The share of cuts among the
    ends of a kind counts those that are told by their score alone; all others are taken for
    informal, so a source that often ends without a terminator raises no odds. At a field limit it is
    at least the share that the missing terminators leave: whole posts there end without one as often
    beside each that has one as the source's other posts do. Rates of a source are backed by those
    of all sources with a weight of ``BACKED`` posts.
    """
    zero, n_bins, at_all = F.lit(0).cast("bigint"), 2 * LOUD + 1, Window.partitionBy(F.lit(1))
    # all rates come from these counts: a row per source, kind of end and score
    counts = cut(rows.groupBy("source", "ending", "at_limit", "score").agg(F.count(F.lit(1)).alias("n_ends")))
    whole = counts.where((F.col("ending") == "terminated") & ~F.col("at_limit") & F.col("score").isNotNull()).select("source", "score", F.col("n_ends").alias("n"))
    sizes = whole.groupBy("source").agg(F.sum("n").alias("n_whole"))
    places = rows.where(F.col("place").isNotNull()).groupBy(F.col("place").alias("score")).agg(F.count(F.lit(1)).alias("n_places"))
    # one row per score: smoothed shares over all sources
    shares = rows.sparkSession.range(n_bins).select((F.col("id") - LOUD).cast("int").alias("score")).join(places, "score", "left").join(whole.groupBy("score").agg(F.sum("n").alias("n_ends")), "score", "left").fillna(0)
    shares = shares.select("score", ((F.col("n_places") + 0.5) / (F.sum("n_places").over(at_all) + n_bins / 2)).alias("p_cut"), ((F.col("n_ends") + 0.5) / (F.sum("n_ends").over(at_all) + n_bins / 2)).alias("p_end"))
    bins = counts.where(F.col("ending").isin("bare", "marked") & F.col("score").isNotNull())
    told = bins.join(F.broadcast(shares), "score").join(whole, ["source", "score"], "left").join(sizes, "source", "left")
    p_whole = (F.coalesce("n", zero) + BACKED * F.col("p_end")) / (F.coalesce("n_whole", zero) + BACKED)
    ratio = F.col("p_cut") / p_whole
    told = cut(told.select("source", "ending", "at_limit", "score", "n_ends", F.when(F.col("score") >= 0, F.least(ratio, F.lit(1.0))).otherwise(ratio).alias("ratio")))
    decisive = F.sum(F.when(F.col("ratio") >= DECISIVE, F.col("n_ends")).otherwise(zero))
    pooled = told.groupBy("ending", "at_limit").agg(((decisive + 1) / (F.sum("n_ends") + 2)).alias("pooled"))  # four rows at most
    own = told.groupBy("source", "ending", "at_limit").agg(decisive.alias("decisive"), F.sum("n_ends").alias("n")).join(F.broadcast(pooled), ["ending", "at_limit"])
    free, limit = ~F.col("at_limit"), F.col("at_limit")
    ended = counts.groupBy("source").agg(*(F.sum(F.when((F.col("ending") == k) & w, F.col("n_ends")).otherwise(zero)).cast("double").alias(f"{k}_{n}") for k in ("terminated", "bare", "marked") for n, w in (("free", free), ("limit", limit))))
    lacking = [(k, 1 - F.try_divide(F.col("terminated_limit") * F.col(f"{k}_free") / F.col("terminated_free"), F.col(f"{k}_limit"))) for k in ("bare", "marked")]
    missing = ended.where("terminated_free > 0").select("source", F.explode(F.create_map(*(x for k, c in lacking for x in (F.lit(k), c)))).alias("ending", "missing")).withColumn("at_limit", F.lit(True)).where("missing is not null")
    own = own.join(missing, ["source", "ending", "at_limit"], "left").select("source", "ending", "at_limit", ((F.col("decisive") + BACKED * F.col("pooled")) / (F.col("n") + BACKED)).alias("share_cut"), F.when(F.col("missing") > 0.99, 0.99).otherwise(F.col("missing")).alias("missing"))
    own = own.select("source", "ending", "at_limit", F.greatest("share_cut", "missing").alias("share_cut"))
    return told.join(own, ["source", "ending", "at_limit"]).select("source", "ending", "at_limit", "score", "ratio", "share_cut")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, at_limit, score, open, ratio, reason, is_cut) of each text that is not blank.

    ``score`` is the log-odds of an end against a random place for a bare or marked end, ``open`` has
    the classes of what is open at the end, ``ratio`` how far that raises the odds of a cut.
    ``reason`` says which finding made a text a cut.
    """
    texts = documents.select("doc_id", "source", "text").where(F.length(strip("text")) > 0).select("doc_id", F.coalesce(F.lower(strip("source")), F.lit("")).alias("source"), F.length("text").cast("bigint").alias("n_chars"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.xxhash64("text").alias("text_hash"), "text")
    model = documents.sparkSession.sparkContext.broadcast(end_model(texts.select("text_hash", "text")))
    walked = cut(spread(texts).mapInArrow(_walk(model), "doc_id bigint, source string, n_chars bigint, n_bytes bigint, text_hash bigint, ending string, open array<string>, score int, place int"))
    rows = cut(_at_limit(walked))
    base = cut(baselines(rows))
    told = rows.join(small_side(base), ["source", "ending", "at_limit", "score"], "left")
    return _decide(told.withColumn("odds", F.col("ratio") * F.col("share_cut") / (1 - F.col("share_cut"))))


def _decide(rows: DataFrame) -> DataFrame:
    """Judge each end with what is open there.

    What is open multiplies the odds of a cut by how much more often texts that look cut leave it
    open than whole ones; a text is never held against rates it counted for itself. An end that is
    not bare is a cut if something is open there that the source's ends leave open in a share of
    less than ``HABIT``.
    """
    odds, limit = F.coalesce(F.col("odds"), F.lit(0.0)), F.col("at_limit")
    ended = F.col("ending").isin("bare", "marked")
    broken, closed = F.col("ending").isin("partial", "unfinished"), F.col("ending").isin("terminated", "tag", "picture")
    cut_like, whole_like = broken | ended & (odds > 9), ~limit & (closed | ended & (odds < 1 / 9))
    has = {c: F.array_contains("open", c) for c in CLASSES}
    base = rows.groupBy("source").agg(
        F.count_if(closed).alias("n_closed"),
        F.count_if(cut_like).alias("n_cut"),
        F.count_if(whole_like).alias("n_whole"),
        *(F.count_if(cut_like & h).alias(f"cut_{c}") for c, h in has.items()),
        *(F.count_if(whole_like & h).alias(f"whole_{c}") for c, h in has.items()),
        *(F.count_if(closed & h).alias(f"closed_{c}") for c, h in has.items()),
    )
    base = cut(base)
    counts = ["n_cut", "n_whole", *(f"{k}_{c}" for k in ("cut", "whole") for c in CLASSES)]
    total = base.agg(*(F.sum(c).alias(f"all_{c}") for c in counts))

    def rate(kind: str, c: str, one: int) -> Column:
        """Share of the source's texts of a kind that leave ``c`` open, ``one`` of them set apart, with a weight for all sources.

        What looks whole is counted without the cuts that are to be expected behind a sentence.
        """

        def n(prefix: str) -> Column:
            seen = F.col(f"{prefix}{kind}_{c}") - one
            return seen if kind == "cut" else F.greatest(seen - F.col(f"{prefix}cut_{c}") / SEGMENT_CHARS, F.lit(0.0))

        pooled = (n("all_") + 0.5) / F.greatest(F.col(f"all_n_{kind}") - one + 1, F.lit(1))
        return F.try_divide(n("") + BACKED * pooled, F.col(f"n_{kind}") - one + BACKED)

    def ratios(cut_one: int, whole_one: int) -> Column:
        return F.create_map(*(x for c in CLASSES for x in (F.lit(c), F.try_divide(rate("cut", c, cut_one), rate("whole", c, whole_one)))))

    habits = F.filter(F.array(*(F.when(F.col(f"closed_{c}") >= HABIT * (F.col("n_closed") + BACKED), F.lit(c)) for c in CLASSES)), lambda c: c.isNotNull())
    # a text is never held against what it counted itself; one row over all sources
    base = cut(base.crossJoin(F.broadcast(total)).select("source", habits.alias("habits"), ratios(0, 0).alias("ratios"), ratios(1, 0).alias("other_cuts"), ratios(0, 1).alias("other_wholes")))
    own = F.when(cut_like, F.col("other_cuts")).when(whole_like, F.col("other_wholes")).otherwise(F.col("ratios"))
    rated = rows.join(small_side(base), "source", "left").withColumn("own", own).withColumn("ratio", F.coalesce(F.array_max(F.transform("open", lambda c: F.try_element_at("own", c))), F.lit(1.0)))
    ratio, is_open = F.col("ratio"), F.size("open") > 0
    reason = (
        F.when(F.col("ending") == "partial", "broken markup, escape or character")
        .when(F.col("ending") == "unfinished", "ends behind a mark that more must follow")
        .when(ended & (odds * ratio > 1) & is_open & (ratio > 1) & (odds <= 1), "left open, no terminator")
        .when(ended & (odds * ratio > 1) & limit, "no terminator at a field limit")
        .when(ended & (odds * ratio > 1), "no terminator against the baseline")
        .when(closed & (F.size(F.array_except("open", "habits")) > 0), "left open behind a terminator")
    )
    return rated.withColumn("reason", reason).select("doc_id", "source", "ending", "at_limit", "score", "open", "ratio", "reason", F.col("reason").isNotNull().alias("is_cut"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the posts whose text was cut. Null and blank texts are no cases."""
    return judged(documents).where("is_cut").select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, n_posts, n_cut, share_cut) per source in plain form; posts without a source under ''.

    Null and blank texts count as posts that are whole.
    """
    flags = judged(documents).where("is_cut").groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    posts = documents.groupBy(F.coalesce(F.lower(strip("source")), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_posts"))
    return posts.join(flags, "source", "left").select("source", "n_posts", F.coalesce("n_cut", F.lit(0)).cast("bigint").alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_posts")).alias("share_cut"))
