"""Slices of documents, blocks of the hash space, and compact blocks of sorted hashes for exchanges between them.

A slice is a set of documents chosen by a hash of the id; a block is a range of
64-bit hashes. For each slice and block one row travels, with the sorted hashes
as byte planes of their differences. A hash that is frequent is sent once by
each slice, so no block grows with a hot passage beyond one entry a slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers without their leading zero bytes: width and number, then as many byte planes.

    The highest plane holds few different values, so it is deflated; the others are random.
    """
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = 8
    while width > 1 and len(raw) and not raw[:, width - 1].any():
        width -= 1
    low, high = raw[:, : width - 1].T, raw[:, width - 1]
    return bytes([width]) + len(raw).to_bytes(4, "little") + np.ascontiguousarray(low).tobytes() + zlib.compress(np.ascontiguousarray(high).tobytes(), 1)


def unplanes(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    end = 5 + (width - 1) * n
    out = np.zeros((n, 8), np.uint8)
    out[:, : width - 1] = np.frombuffer(data[5:end], np.uint8).reshape(width - 1, n).T
    out[:, width - 1] = np.frombuffer(zlib.decompress(data[end:]), np.uint8)
    return out.reshape(-1).view("<u8")


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned integers: the first, then the differences."""
    return int(x[0]).to_bytes(8, "little") + planes(np.diff(x))


def unpack_sorted(data: bytes) -> np.ndarray:
    first = np.frombuffer(data[:8], "<u8")
    return np.cumsum(np.concatenate([first, unplanes(data[8:])]), dtype=np.uint64)


def block_edges(blocks: int) -> np.ndarray:
    """The first hash of each block but the first."""
    return np.array([(i << 64) // blocks for i in range(1, blocks)], dtype=np.uint64)


def cut(sorted_hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block of the sorted hashes starts; one more than blocks."""
    return np.concatenate([[0], np.searchsorted(sorted_hashes, block_edges(blocks)), [len(sorted_hashes)]])


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def sized(docs: DataFrame, total: int, each: int) -> int:
    """How many slices or blocks: about ``each`` bytes of text apiece, and no fewer than shuffle partitions."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // each), 1)


def slice_of(slices: int, *columns: Column) -> Column:
    """By id and text, so that rows without an id, or with one and the same, don't meet in one slice."""
    return F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int")


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """For the jobs run inside, Arrow batches that go to Python hold about ``most`` bytes, or one longer row.

    Spark's limits (10,000 rows, 64 MB) let a batch of texts grow to tens of MB, once in the executor's JVM and once in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
