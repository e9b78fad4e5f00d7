"""Content-defined chunking after FastCDC (Xia et al., USENIX ATC 2016) and payload compression.

The gear table comes from a fixed rule, so boundaries are stable but are not those of any other
implementation. Inputs up to the least size are one chunk, whose id is the SHA-256 of the bytes.
"""

from __future__ import annotations

import hashlib
import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.scalars import check_sizes

#: One 64-bit number per byte value: the first eight bytes of the SHA-256 of the value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "big") for i in range(256)], dtype=np.uint64)
#: A position's rolling hash depends on this many bytes before it.
WINDOW = 64


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at every position: each byte's number, shifted left once per byte since."""
    out = GEAR[data]
    shift = 1
    while shift < WINDOW:  # doubling: sums of 2, 4, 8 ... shifted numbers
        out[shift:] = out[shift:] + (out[:-shift] << np.uint64(shift))
        shift *= 2
    return out


def boundaries(data: bytes, least: int, mean: int, greatest: int) -> list[int]:
    """End of each chunk. Normalised: a stricter mask up to the mean size, a looser one beyond."""
    check_sizes(least, mean, greatest)
    n = len(data)
    if n <= least:
        return [n] if n else []
    bits = max(1, round(np.log2(mean)))
    h = _hashes(np.frombuffer(data, dtype=np.uint8))
    strict = np.flatnonzero((h >> np.uint64(64 - min(bits + 1, 63))) == 0) + 1
    loose = np.flatnonzero((h >> np.uint64(64 - max(bits - 1, 1))) == 0) + 1
    ends, at = [], 0
    while at < n:
        end = min(at + greatest, n)
        for cuts, a, b in ((strict, at + least, min(at + mean, end)), (loose, at + mean, end)):
            i = int(np.searchsorted(cuts, a))
            if i < len(cuts) and cuts[i] < b:
                end = int(cuts[i])
                break
        if n - at <= least:
            end = n
        ends.append(end)
        at = end
    return ends


def chunk(rows: DataFrame, key: str, column: str, least: int, mean: int, greatest: int) -> DataFrame:
    """(key, pos, start, size, chunk_id) of each row's bytes; null and empty give no chunk."""
    check_sizes(least, mean, greatest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, start, size, ids = [], [], [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                begin = 0
                for k, end in enumerate(boundaries(data or b"", least, mean, greatest)):
                    at.append(i)
                    pos.append(k)
                    start.append(begin)
                    size.append(end - begin)
                    ids.append(hashlib.sha256(data[begin:end]).hexdigest())
                    begin = end
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.string())], names=[key, "pos", "start", "size", "chunk_id"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("binary")).mapInArrow(run, f"`{key}` {kind}, pos int, start bigint, size bigint, chunk_id string")


def overlap(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, and bytes that deduplication keeps."""
    per = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_stored"))


def _codecs() -> dict:
    import zstandard

    codecs = {
        "none": (lambda b: b, lambda b: b),
        "zlib": (zlib.compress, zlib.decompress),
        "lzma": (lambda b: lzma.compress(b, format=lzma.FORMAT_ALONE), lambda b: lzma.decompress(b, format=lzma.FORMAT_ALONE)),
        "xz": (lzma.compress, lzma.decompress),
        "zstd": (lambda b: zstandard.ZstdCompressor(level=3).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b)),
    }
    lz4 = pa.Codec("lz4_raw")
    codecs["lz4"] = (lambda b: len(b).to_bytes(4, "little") + lz4.compress(b, asbytes=True), lambda b: lz4.decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True))
    return codecs


def compress_bytes(data: bytes, algorithm: str, min_size: int = 0, keep_smaller: bool = True) -> tuple[str, bytes]:
    """(algorithm used, payload): raw below ``min_size``, and if compressing gains nothing and ``keep_smaller``."""
    if algorithm == "none" or len(data) < min_size:
        return "none", data
    out = _codecs()[algorithm][0](data)
    return ("none", data) if keep_smaller and len(out) >= len(data) else (algorithm, out)


def decompress_bytes(data: bytes, algorithm: str) -> bytes:
    return _codecs()[algorithm][1](data)


def round_trip(chunks: DataFrame, algorithm: str) -> DataFrame:
    """(chunk_id, size, stored_size, is_equal) of (chunk_id, data) after compressing and decompressing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            data = [bytes(x) if x is not None else b"" for x in pdf["data"]]
            done = [compress_bytes(d, algorithm) for d in data]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "size": [len(d) for d in data], "stored_size": [len(b) for _, b in done], "is_equal": [decompress_bytes(b, used) == d for (used, b), d in zip(done, data, strict=True)]})

    return chunks.select("chunk_id", "data").mapInPandas(run, "chunk_id string, size bigint, stored_size bigint, is_equal boolean")


def compressed_sizes(rows: DataFrame, key: str, column: str, algorithm: str, min_size: int = 128) -> DataFrame:
    """(key, size, used, stored_size) of each row's bytes; nulls count as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            data = [bytes(x) if x is not None else b"" for x in pdf.iloc[:, 1]]
            done = [compress_bytes(d, algorithm, min_size) for d in data]
            yield pd.DataFrame({key: pdf.iloc[:, 0], "size": [len(d) for d in data], "used": [u for u, _ in done], "stored_size": [len(b) for _, b in done]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("binary")).mapInPandas(run, f"`{key}` {kind}, size bigint, used string, stored_size bigint")


def compression_stats(sizes: DataFrame) -> DataFrame:
    """One row: bytes in and out, payloads compressed and raw, ratio (1 of nothing) and percent saved."""
    total_in, total_out = F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("stored_size"), F.lit(0))
    ratio = F.when(total_in > 0, total_out / total_in).otherwise(1.0)
    return sizes.agg(total_in.alias("bytes_in"), total_out.alias("bytes_out"), F.count_if(F.col("used") != "none").alias("n_compressed"), F.count_if(F.col("used") == "none").alias("n_raw"), ratio.alias("ratio"), ((1 - ratio) * 100).alias("percent_saved"))
