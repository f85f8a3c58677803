"""A partitioned array of sorted suffixes, and the runs of it that lie across a split.

Texts here are bit strings.  Their suffixes, each known by its leading bits
and by the point where it starts, are sorted over range partitions, which cut
even a run of equal suffixes evenly; adjacent suffixes are compared for the
length of their common prefix, and where that reaches the whole of the leading
bits they are of one run.  Runs that two partitions share are put together
from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = pa.schema([("block", pa.int32()), ("prefix", pa.int64()), ("train", pa.bool_()), ("held", pa.bool_()), ("n", pa.int64())])


def common_bits(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length of the common prefix of two arrays of leading bits, ``size`` bits each."""
    apart = np.frexp((a ^ b).astype(np.float64))[1]  # the number of bits of the difference
    return size - apart


def _runs(sizes: tuple[int, ...]):
    """A pass over a sorted partition (block, prefix, train, held): its runs of two and more with both sides, and, for what they share with neighbours, its first and last run."""
    size_of = np.array(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first = None, True  # the last run may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            block, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
            train, held = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            ones = np.ones(len(block), np.int64)
            if open_ is not None:
                block, prefix, train, held, ones = (np.concatenate([[o], x]) for o, x in zip(open_, (block, prefix, train, held, ones)))
            size = size_of[block[1:]]
            goes_on = (block[1:] == block[:-1]) & (common_bits(prefix[1:], prefix[:-1], size) >= size)
            starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            t, h, n = np.logical_or.reduceat(train, starts), np.logical_or.reduceat(held, starts), np.add.reduceat(ones, starts)
            keep = t & h & (n > 1)
            keep[0] |= first
            keep[-1] = False
            open_ = block[starts[-1]], prefix[starts[-1]], t[-1], h[-1], n[-1]
            first = first and len(starts) == 1
            at = starts[keep]
            yield pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), pa.array(prefix[at]), pa.array(t[keep]), pa.array(h[keep]), pa.array(n[keep])], schema=_RUN)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(open_[0]), int(open_[1]), bool(open_[2]), bool(open_[3]), int(open_[4])), _RUN)], schema=_RUN)

    return run


def cross_runs(suffixes: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``block`` and ``prefix`` of every run of two or more suffixes with both sides in it.

    ``suffixes`` has block (where the suffix starts), prefix (its leading
    bits, ``sizes[block]`` of them), text (what it is a suffix of), train and
    held.  No suffixes give no runs.
    """
    rows = suffixes.select("block", "prefix", "train", "held", "text").repartitionByRange("block", "prefix", "text").sortWithinPartitions("block", "prefix", "text")
    parts = rows.select("block", "prefix", "train", "held").mapInArrow(_runs(sizes), "block int, prefix long, train boolean, held boolean, n long")
    whole = parts.groupBy("block", "prefix").agg(F.bool_or("train").alias("train"), F.bool_or("held").alias("held"), F.sum("n").alias("n"))
    return whole.where("train AND held AND n > 1").select("block", "prefix")
