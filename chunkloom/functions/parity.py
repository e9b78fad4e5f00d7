"""Parity of stored objects: 16 data shards and up to 4 parity shards over GF(256).

The blob starts with 16 bytes (mark, version, counts of data and parity shards, a zero, length of the object),
then the CRC-32 of each data shard, then the parity shards. The layout is that of other
implementations, the coefficients are our own, those of a Cauchy matrix, so any data shards as many as there are parity shards can be restored. The checksums
tell which shards are damaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA_SHARDS = 16
#: Mark at the start of a parity blob, and the field's polynomial (fixed values).
MARK, POLYNOMIAL = b"PARR", 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power, log, x = np.zeros(512, dtype=np.uint8), np.zeros(256, dtype=np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = (x << 1) ^ (POLYNOMIAL if x & 0x80 else 0)
    return power, log


POWER, LOG = _tables()


def _times(factor: int, data: np.ndarray) -> np.ndarray:
    if not factor:
        return np.zeros_like(data)
    return np.where(data == 0, 0, POWER[LOG[data] + LOG[factor]]).astype(np.uint8)


def _inverse(x: int) -> int:
    return int(POWER[255 - LOG[x]])


def coefficient(parity: int, shard: int) -> int:
    """Factor of a data shard in a parity shard: 1 / (x + y) of the Cauchy matrix."""
    return _inverse((DATA_SHARDS + parity) ^ shard)


def _shards(data: bytes) -> np.ndarray:
    width = -(-len(data) // DATA_SHARDS)
    return np.frombuffer(data.ljust(width * DATA_SHARDS, b"\0"), dtype=np.uint8).reshape(DATA_SHARDS, width)


def encode(data: bytes, parity: int) -> bytes:
    """Parity blob of an object; empty without parity shards."""
    if not parity:
        return b""
    shards = _shards(data)
    blob = MARK + bytes([1, DATA_SHARDS, parity, 0]) + len(data).to_bytes(8, "little") + b"".join(zlib.crc32(s.tobytes()).to_bytes(4, "little") for s in shards)
    for p in range(parity):
        row = np.zeros(shards.shape[1], dtype=np.uint8)
        for i, s in enumerate(shards):
            row ^= _times(coefficient(p, i), s)
        blob += row.tobytes()
    return blob


def repair(data: bytes, blob: bytes) -> bytes:
    """The object with damaged shards restored; raises ValueError if there are more of them than parity shards."""
    if blob[:4] != MARK or len(blob) < 80:
        raise ValueError("no parity blob")
    parity, length = blob[6], int.from_bytes(blob[8:16], "little")
    shards = _shards(data[:length].ljust(length, b"\0")).copy()
    sums = [int.from_bytes(blob[16 + 4 * i : 20 + 4 * i], "little") for i in range(DATA_SHARDS)]
    lost = [i for i, s in enumerate(shards) if zlib.crc32(s.tobytes()) != sums[i]]
    if len(lost) > parity:
        raise ValueError(f"{len(lost)} of {DATA_SHARDS} shards are damaged, {parity} can be restored")
    width = shards.shape[1]
    rows = np.frombuffer(blob[80:], dtype=np.uint8).reshape(parity, width)[: len(lost)].copy()
    matrix = [[coefficient(p, i) for i in lost] for p in range(len(lost))]
    for p in range(len(lost)):
        for i in range(DATA_SHARDS):
            if i not in lost:
                rows[p] ^= _times(coefficient(p, i), shards[i])
    for k in range(len(lost)):  # elimination; a Cauchy matrix needs no exchange of rows
        scale = _inverse(matrix[k][k])
        matrix[k] = [int(_times(scale, np.array([c], dtype=np.uint8))[0]) for c in matrix[k]]
        rows[k] = _times(scale, rows[k])
        for r in range(len(lost)):
            if r != k and (factor := matrix[r][k]):
                matrix[r] = [a ^ int(_times(factor, np.array([b], dtype=np.uint8))[0]) for a, b in zip(matrix[r], matrix[k], strict=True)]
                rows[r] ^= _times(factor, rows[k])
    for k, i in enumerate(lost):
        shards[i] = rows[k]
    return shards.tobytes()[:length]


def with_parity(chunks: DataFrame, shards: int) -> DataFrame:
    """(chunk_id, parity) of (chunk_id, data); a null payload counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "parity": [encode(bytes(d or b""), shards) for d in pdf["data"]]})

    return chunks.select("chunk_id", F.col("data").cast("binary").alias("data")).mapInPandas(run, "chunk_id string, parity binary")
