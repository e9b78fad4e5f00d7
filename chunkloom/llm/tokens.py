"""Sizes of texts in tokens of a public tokenizer, and weights by quality."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import cut, fits, small_side

#: Folder of the vocabulary files, and the rank file used unless another is named.
TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a run of blanks or of other characters this long is counted in pieces of that length, else its merges take too long; its count may be higher by a token a piece.
RUN = 20_000
_LONG_RUN = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))


@functools.lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)

        def size(text: str) -> int:
            if len(text) <= RUN or not _LONG_RUN.search(text):
                return len(encoding.encode_ordinary(text))
            return sum(len(encoding.encode_ordinary(text[i : i + RUN])) for i in range(0, len(text), RUN))

        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = pa.array([size(t) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, counts], names=[*(n for n in batch.schema.names if n != "text"), "n_tokens"])

    return run


def token_counts(documents: DataFrame, columns: list[str], directory: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """The given columns and ``n_tokens`` of ``text``; null and empty texts have none."""
    rows = documents.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(_count(f"{directory}/{ranks}"), f"{schema}, n_tokens bigint")


#: Pairs of bytes, slots of the hashed trigrams of the character model, and its smoothing.
PAIRS, TRIGRAMS, ALPHA = 1 << 16, 1 << 20, 0.01
#: Bytes of text that are worked on at once; whole texts as far as they fit, longer ones in parts.
PIECE = 1 << 20


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """All bytes from the third of a text on, piece by piece.

    Numbers of the texts in a piece (of three bytes and more), where each begins in it, the pair before
    each byte, the slot of the pair with that byte, and whether all three are of one text.
    """
    texts = pc.fill_null(column, "").cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    which = np.flatnonzero(np.diff(at) >= 3)
    begins, ends, i = at[which], at[which + 1], 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + PIECE, "right")))
        first, last = int(begins[i]), int(ends[j - 1])
        for low in range(first, last - 2, PIECE):  # more than one of a single long text only, two bytes in common
            b = data[low : min(last, low + PIECE + 2)].astype(np.int64)
            pairs = b[:-2] << 8 | b[1:-1]
            inside = np.ones(len(b), bool)
            border = at[which[i] + 1 : which[j - 1] + 1] - low  # of all texts between, short ones too
            inside[border - 1] = inside[border - 2] = False
            yield which[i:j], np.maximum(begins[i:j] - low, 0), pairs, (pairs * 0x9E3779B1 + b[2:] * 0x85EBCA6B >> 7) & (TRIGRAMS - 1), inside[:-2]
        i = j


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of all texts: of the pairs, and behind them of the trigrams."""
    counts = np.zeros(PAIRS + TRIGRAMS, np.int64)
    for batch in batches:
        for _, _, pairs, trigrams, inside in _grams(batch.column("text")):
            counts[:PAIRS] += np.bincount(pairs[inside], minlength=PAIRS)
            counts[PAIRS:] += np.bincount(trigrams[inside], minlength=TRIGRAMS)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], names=["slot", "n"])


def _once(texts: DataFrame) -> DataFrame:
    """Every different text of (text_hash, text) once; only those whose hash comes again are shuffled, unless they are many."""
    again = cut(texts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_hash"))
    if not fits(again):
        return texts.select("text").distinct()
    again = F.broadcast(again)
    return texts.join(again, "text_hash", "left_anti").select("text").unionByName(texts.join(again, "text_hash", "left_semi").select("text").distinct())


def character_model(texts: DataFrame) -> tuple[bytes, bytes]:
    """Counts of byte pairs and hashed trigrams in all texts of (text_hash, text), each read whole; equal texts count once."""
    rows = _once(texts).mapInArrow(_count_grams, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row per slot at most
    counts = np.zeros(PAIRS + TRIGRAMS, np.int64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return counts[:PAIRS].tobytes(), counts[PAIRS:].tobytes()


def surprise(model: object, column: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``bits``: mean bits per byte of the whole text under the character model, null below three bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_pairs, of_trigrams = (np.log2(np.frombuffer(x, np.int64) + more) for x, more in zip(model.value, (ALPHA * 256, ALPHA), strict=True))
        for batch in batches:
            texts = batch.column(column)
            total, n = np.zeros(len(batch)), pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) - 2
            for which, begins, pairs, trigrams, inside in _grams(texts):
                total[which] += np.add.reduceat((of_pairs[pairs] - of_trigrams[trigrams]) * inside, begins)
            yield batch.append_column("bits", pa.array(total / np.maximum(n, 1), pa.float64(), mask=n < 1))

    return run


def form(text: str = "text") -> Column:
    """How much of a text is letters, from 0 to 1, less for short and marked-up ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / n
    marks = F.length(F.regexp_replace(t, r"[^<>\[\]{}]+", "")) / n
    return letters * (1 - F.exp(-n / F.lit(200.0))) * F.exp(F.lit(-10.0) * marks)


#: Least weight of a text, and weight in texts of all sources' surprise beside that of one.
LEAST_WEIGHT, BACKED = 0.05, 30.0


def with_quality(rows: DataFrame) -> DataFrame:
    """``rows`` of (source, form, bits, ...) with ``weight``, from ``LEAST_WEIGHT`` to 1.

    The form counts in full, and by half how usual the text is among those of its source: a logistic
    function of its bits per byte against the source's mean and deviation, so a language is held
    against itself. Statistics cover all texts.
    """
    stats = rows.where("bits is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("s"), F.sum(F.col("bits") * F.col("bits")).alias("q"))
    stats = cut(stats)
    total = stats.agg(F.sum("n").alias("an"), F.sum("s").alias("as"), F.sum("q").alias("aq"))
    n = F.col("n") + BACKED
    mean, square = ((F.col(x) + BACKED * F.try_divide(f"a{x}", "an")) / n for x in ("s", "q"))
    stats = stats.crossJoin(F.broadcast(total)).select(F.col("source").alias("of"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.01))).alias("deviation"))  # one row over all sources
    usual = F.coalesce(1 / (1 + F.exp((F.col("bits") - F.col("mean")) / F.col("deviation"))), F.lit(0.5))
    joined = rows.join(small_side(stats), F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("weight", F.greatest(F.col("form") * (1 + usual) / 2, F.lit(LEAST_WEIGHT))).drop("of", "mean", "deviation")
