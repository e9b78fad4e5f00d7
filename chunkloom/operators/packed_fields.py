"""Several values packed in one field: one row per value with its position.

The separators of a source (a table's field) are inferred from all its values. Each candidate
mark is scored on every value that holds it outside quotes and escapes, by two shares:

* regularity: the share of the pieces behind the mark that have the type of the source's pieces. Where
  most pieces are absolute paths, that is the type; else it is a vocabulary: a piece is regular if it
  also occurs in a value that does not hold the mark. This share is held against the share of all pieces
  that occur in more values than one, so a field whose entries seldom recur is no less regular;
* consistency: how far the piece counts under the mark agree with those under the other regular marks
  (overlap of the two histograms), as a list is as long whatever its writer's mark.

Regularity, lowered by up to a half for lack of consistency, makes a mark a separator everywhere (``STRONG`` or
more); among paths, whose type is certain, nearly all values must be regular as well (``SURE``). Any other mark separates
only the values all of whose pieces are regular, or before a path, if these are not too rare (``WEAK`` or more), else it is ordinary text.
Both are shares, so the same data split alike at every size. Only a handful of values says too little: there a
usual mark has the benefit of the doubt (upper confidence limit of its share, ``DOUBT``). Blanks never separate.
The vocabulary is a distributed table joined by hash of the piece, exact at any number of pieces.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.model import BLANKS
from chunkloom.session import cut

#: Marks that may separate entries; line breaks count as one mark.
USUAL = (",", ";", "|", "\t", "\n")
CANDIDATES = (*USUAL, ":", "/", "-", "=", "&", "#", "_", ".")
STRONG, SURE, WEAK = 0.4, 0.75, 0.02
#: Standard deviations by which the share of a usual mark may be doubted; at 5 values or more that cannot turn text into a separator.
DOUBT = 1.64
#: Regularity from which a mark's piece counts are a yardstick for the others.
YARDSTICK = 0.5
#: Piece counts from here on fall into one class of the histograms.
LONG_LIST = 64

_PATH = re.compile(r"(?:/|[A-Za-z]:[\\/]|\\\\)")
_INNER_BLANKS = "".join(c for c in BLANKS if c not in "\t\n\r")


def is_path(text: str) -> bool:
    """Whether the text has the form of an absolute path, Unix or Windows."""
    return bool(_PATH.match(text))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _listed(text: str) -> list[str] | None:
    """Entries of a JSON list or a list literal with single quotes; null if the text is neither."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(found, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found if x is not None]
    return None


@dataclass(frozen=True)
class Separators:
    """The inferred marks of a source: those that always separate, and those that do in consistent values."""

    strong: str = "".join(USUAL)
    weak: str = ""
    paths: bool = False


class Splitter:
    """Splits values at given marks outside quotes and escapes."""

    def __init__(self, marks: str) -> None:
        if "\n" in marks:
            marks += "\r"
        group = "[" + re.escape(marks) + "]"
        other = "[^" + re.escape(marks) + "]"
        blank = f"[{re.escape(_INNER_BLANKS)}]*"
        quoted = "|".join(rf'{q}(?P<{name}>(?:{q}{q}|\\{q}|[^{q}])*?){q}{blank}(?={group}|\Z)' for q, name in (('"', "double"), ("'", "single")))
        self._piece = re.compile(rf"{blank}(?:{quoted}|(?P<bare>(?:\\{group}|{other})*))", re.DOTALL)
        self._escape = re.compile(rf"\\({group}|[\"'])")
        self.marks = marks

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(entry, protected by quotes) in order; empty entries are left out."""
        return [(entry, protected) for entry, protected, _ in self.parts(text)]

    def parts(self, text: str) -> list[tuple[str, bool, str]]:
        """As ``pieces``, with the mark before each; line breaks count as one mark."""
        out, at, mark = [], 0, ""
        while at <= len(text):
            m = self._piece.match(text, at)
            if m["bare"] is not None:
                entry, protected = m["bare"], False
            else:
                q = '"' if m["double"] is not None else "'"
                entry, protected = m["double"] if q == '"' else m["single"], True
                entry = entry.replace("\\" + q, q).replace(q + q, q)
            entry = entry.strip(BLANKS)
            if entry:
                out.append((entry, protected, mark if out else ""))
            at = m.end() + 1
            mark = text[m.end() : at].replace("\r", "\n")
        return out

    def entries(self, text: str) -> list[tuple[str, bool]]:
        """As ``pieces``, with the escapes of unprotected entries undone."""
        return [(e if p else self._escape.sub(r"\1", e), p) for e, p in self.pieces(text)]


class PathSplitter:
    """Splits at a mark; if some piece is no path, only where a path follows, so a path may hold the mark itself."""

    def __init__(self, mark: str) -> None:
        self._every = Splitter(mark)
        self._at = re.compile(rf"(?<!\\){re.escape(mark)}(?=[{re.escape(_INNER_BLANKS)}]*{_PATH.pattern})")
        self._end = re.compile(rf"{re.escape(mark)}+\Z")

    def entries(self, text: str) -> list[tuple[str, bool]]:
        found = self._every.entries(text)
        if all(is_path(p) for p, _ in found):
            return found
        parts = (p.strip(BLANKS) for p in self._at.split(self._end.sub("", text)))
        return [(p, False) for p in parts if p]


def split_value(text: str | None, strong: Splitter, weak: dict[str, Splitter | PathSplitter], regular: Callable[[str, str], bool]) -> list[str]:
    """Entries of one value in order; ``regular`` tells whether a piece is, behind a weak mark."""
    text = (text or "").strip(BLANKS)
    if not text:
        return []
    listed = _listed(text)
    if listed is not None:
        return [x for x in (e.strip(BLANKS) for e in listed) if x]
    out = []
    for entry, protected in strong.pieces(text):
        if not protected:
            for mark, splitter in weak.items():
                if mark in entry:
                    parts = splitter.entries(entry)
                    if all(regular(p, mark) for p, _ in parts):
                        out += [strong._escape.sub(r"\1", p) for p, _ in parts]
                        break
            else:
                out.append(strong._escape.sub(r"\1", entry))
        else:
            out.append(entry)
    return out


class Reader:
    """Applies the separators of a source to values; picklable, compiled once per worker."""

    def __init__(self, separators: Separators) -> None:
        self.separators = separators
        self.strong = Splitter(separators.strong)
        self.weak = {m: (PathSplitter if separators.paths else Splitter)(m) for m in separators.weak}

    def split(self, text: str | None, consistent: str = "") -> list[str]:
        """Entries in order; ``consistent`` names the weak marks that separate in this value, if it holds no paths."""
        paths = self.separators.paths
        return split_value(text, self.strong, self.weak, lambda piece, mark: is_path(piece) if paths else mark in consistent)


_EVIDENCE = "value bigint, mark string, n_pieces int, pieces array<bigint>, n_paths int, held int"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per value and mark it holds: the number of pieces, those behind the mark by hash, and how many are paths.

    A row without a mark has all pieces of the value at the usual marks; ``held`` has a bit per mark of the value.
    """
    every = Splitter("".join(USUAL))
    others = {m: Splitter(m) for m in CANDIDATES if m not in USUAL}
    bit = {m: 1 << i for i, m in enumerate(CANDIDATES)}
    for batch in batches:
        rows: list[tuple[int, str, int, list[int], int, int]] = []
        for v in batch.column(0).to_pylist():
            text = (v or "").strip(BLANKS)
            if not text or _listed(text) is not None:
                continue
            parts = every.parts(text)
            behind: dict[str, list[str]] = {}
            for entry, protected, before in parts:
                if before:
                    behind.setdefault(before, []).append(entry)
                if not protected:
                    for m, splitter in others.items():
                        if m in entry:
                            behind.setdefault(m, []).extend(e for e, _ in splitter.entries(entry)[1:])
            held, key = sum(bit[m] for m in behind), _hash(text)
            rows.append((key, "", len(parts), [_hash(e) for e, _, _ in parts], sum(is_path(e) for e, _, _ in parts), held))
            rows += [(key, m, 1 + len(found), [_hash(e) for e in found], sum(map(is_path, found)), held) for m, found in behind.items() if found]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["value", "mark", "n_pieces", "pieces", "n_paths", "held"])


@dataclass(frozen=True)
class Score:
    """What the values that hold a mark say of it; all but the number of values are shares."""

    n_values: int
    regularity: float
    consistency: float
    consistent_values: float

    @property
    def total(self) -> float:
        return self.regularity * (1 + self.consistency) / 2


def _at_most(share: float, n: int) -> float:
    """Upper Wilson limit of a share seen in n values."""
    z = DOUBT * DOUBT / n
    return (share + z / 2 + DOUBT * ((share * (1 - share) + z / 4) / n) ** 0.5) / (1 + z)


def _overlap(a: dict[int, int], b: dict[int, int]) -> float:
    n, m = sum(a.values()), sum(b.values())
    return sum(min(x / n, b.get(k, 0) / m) for k, x in a.items()) if n and m else 1.0


def candidate_scores(values: DataFrame) -> tuple[dict[str, Score], bool, DataFrame]:
    """Score per mark of a one-column frame of texts; whether it holds paths; (value, mark, share) with the
    share of regular pieces behind the mark. The driver sees a bounded histogram per mark."""
    rows = cut(values.mapInArrow(_evidence, _EVIDENCE))
    pieces, marked = rows.where(F.col("mark") == ""), rows.where(F.col("mark") != "")
    n = pieces.agg(F.sum("n_pieces").alias("n"), F.sum("n_paths").alias("paths")).first()
    paths = (n["paths"] or 0) * 2 > (n["n"] or 0)
    recurring = 1.0
    if paths:
        shares = marked.select("value", "mark", "n_pieces", (F.col("n_paths") / F.size("pieces")).alias("share"))
    else:
        bits = F.create_map(*(x for i, m in enumerate(CANDIDATES) for x in (F.lit(m), F.lit(1 << i))))
        vocabulary = pieces.select("value", "held", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.bit_and("held").alias("always"), F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
        vocabulary = cut(vocabulary.select("piece", "always", "n", (F.col("first") != F.col("last")).alias("recurs")))
        seen = vocabulary.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("recurs"), F.col("n"))).alias("recurring")).first()
        recurring = (seen["recurring"] or 0) / max(seen["n"] or 0, 1)
        asked = marked.select("value", "mark", "n_pieces", F.explode("pieces").alias("piece")).join(vocabulary.select("piece", "always"), "piece", "left")
        known = F.coalesce(F.col("always").bitwiseAND(bits[F.col("mark")]) == 0, F.lit(False))
        shares = asked.groupBy("value", "mark", "n_pieces").agg(F.avg(known.cast("double")).alias("share"))
    shares = cut(shares)
    found: dict[str, dict[int, tuple[int, float, int]]] = {}
    for r in shares.groupBy("mark", F.least("n_pieces", F.lit(LONG_LIST)).alias("n_pieces")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"), F.count_if(F.col("share") == 1).alias("whole")).collect():
        found.setdefault(r["mark"], {})[r["n_pieces"]] = (r["n"], r["share"], r["whole"])
    counts = {m: {k: n for k, (n, _, _) in by.items()} for m, by in found.items()}
    total = {m: sum(c.values()) for m, c in counts.items()}
    regular = {m: min(1.0, sum(s for _, s, _ in by.values()) / total[m] / recurring) if recurring else 0.0 for m, by in found.items()}
    scores = {}
    for m, by in found.items():
        yardstick: dict[int, int] = {}
        for other in counts:
            if other != m and regular[other] >= YARDSTICK:
                for k, n_values in counts[other].items():
                    yardstick[k] = yardstick.get(k, 0) + n_values
        scores[m] = Score(total[m], _at_most(regular[m], total[m]) if m in USUAL else regular[m], _overlap(counts[m], yardstick), sum(w for _, _, w in by.values()) / total[m])
    return scores, paths, shares


def infer(values: DataFrame) -> tuple[Reader, DataFrame]:
    """Reader with the separators of a one-column frame of texts, and ``shares`` of ``candidate_scores``."""
    scores, paths, shares = candidate_scores(values)
    strong = [m for m in CANDIDATES if m in scores and scores[m].total >= STRONG and (not paths or scores[m].consistent_values >= SURE or m in USUAL and _at_most(scores[m].consistent_values, scores[m].n_values) >= SURE)]
    weak = [m for m in CANDIDATES if m in scores and m not in strong and scores[m].consistent_values >= WEAK]
    return Reader(Separators("".join(strong) or "\n", "".join(weak), paths)), shares


def _split(separators: Separators) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(separators)
        for batch in batches:
            rows, pos, entries = [], [], []
            for i, (v, consistent) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = own.split(v, consistent or "")
                rows += [i] * len(found)
                pos += range(len(found))
                entries += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(entries, pa.string())], names=["record_id", "pos", "entry"])

    return run


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("hash", pa.array([_hash(v.strip(BLANKS)) for v in batch.column(1).to_pylist()], pa.int64()))


def unpack(records: DataFrame, id_column: str, field: str) -> DataFrame:
    """(record_id, pos, entry): the entries of ``field``, counted from 0 per record.

    Null, blank and empty values give no row; repeated entries stay; rows equal in id and value
    count once. A text that opens with ``[`` and is no list is read like any other.
    """
    rows = cut(records.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(field).alias("value")).where(F.length(F.btrim("value")) > 0).distinct())
    reader, shares = infer(rows.select("value"))
    separators = reader.separators
    if separators.weak and not separators.paths:
        # the marks that separate in a value, by its hash
        marks = shares.where(F.col("mark").isin(*separators.weak) & (F.col("share") == 1)).groupBy("value").agg(F.concat_ws("", F.collect_set("mark")).alias("consistent")).withColumnRenamed("value", "hash")
        rows = rows.mapInArrow(_with_hash, "record_id bigint, value string, hash bigint").join(marks, "hash", "left").select("record_id", "value", "consistent")
    else:
        rows = rows.withColumn("consistent", F.lit(""))
    return rows.mapInArrow(_split(separators), "record_id bigint, pos int, entry string")


def packed_entries(bookmarks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(source_table, record_id, pos, entry) of the tags of bookmarks and the paths of tasks."""
    return (
        unpack(bookmarks, "id", "tags")
        .select(F.lit("archive_bookmarks").alias("source_table"), "record_id", "pos", "entry")
        .unionByName(unpack(tasks, "id", "paths_to_backup").select(F.lit("scheduled_tasks").alias("source_table"), "record_id", "pos", "entry"))
    )
