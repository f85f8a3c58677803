"""A membership filter of bounded size over 64-bit codes, built by the executors.

A code sets three bits of a map of ``2**k`` bits.  Codes that were put in are
always found; others are taken for members at a small rate, which grows if
there are more than a tenth as many codes as bits, so what passes the filter
must be joined with the codes themselves.  A map holds 64 MB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and the largest map, as powers of two.
LEAST, MOST = 16, 29
#: Bits for each code, as long as the map isn't the largest.
PER_CODE = 64
#: Bits of a piece of the map, which one group makes.
_PIECE = 16
# Odd multipliers that spread a code over the map.
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(codes * np.uint64(m)) >> np.uint64(64 - bits) for m in _SPREAD]


def build(codes: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """The map of a table of codes (bigint): its size as a power of two, and its words.

    Nulls are left out; no codes give an empty map.
    """
    rows = codes.select(F.col(column).cast("long").alias("code")).where("code IS NOT NULL").distinct()
    n = rows.count()
    bits = min(MOST, max(LEAST, (PER_CODE * max(1, n) - 1).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _PIECE, pa.int64()), pa.array(at & ((1 << _PIECE) - 1), pa.int64())], names=["piece", "at"])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(1 << _PIECE, np.uint8)
        own[table.column("at").to_numpy()] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bytes": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    # A piece holds 65,536 different places at most; repeats go before the shuffle.
    pieces = rows.mapInArrow(spread, "piece long, at long").distinct().groupBy("piece").applyInArrow(fill, "piece long, bytes binary")
    out = np.zeros(1 << (bits - 6), np.uint64)
    step = 1 << (_PIECE - 6)
    for r in pieces.collect():  # 8 kB each, 64 MB together at most
        out[r.piece * step : (r.piece + 1) * step] = np.frombuffer(r.bytes, np.uint64)
    return bits, out


def members(bits: int, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The places in ``codes`` (uint64) of those that are in the map, or are taken to be."""
    left = np.arange(len(codes))
    for at in _places(codes, bits):
        at = at[left]
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        if not len(left):
            break
    return left
