"""Vectorised word and n-gram hashing over Arrow string columns.

Words are hashed once per distinct spelling in a slice (64-bit SipHash), and
n-grams are combined from word hashes with one polynomial prefix sum, so the
cost per word is a few dozen nanoseconds whatever the n-gram length is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lower-cased; every other ASCII byte that is no digit or letter becomes a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
#: Byte tables for :func:`words`: unchanged, A-Z lower-cased, lower-cased letters and digits only.
AS_IS, LOWER, LOWER_ALNUM = None, _LOWER, _ALNUM


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 6 << 20
) -> Iterator[pa.Table]:
    """Cut batches into runs of rows with about ``max_bytes`` of text each.

    A row longer than that is a slice of its own; nothing is cut inside a row.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        size = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy().cumsum()
        start = 0
        while start < table.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield table.slice(start, end - start)
            start = end


def _translated(text: pa.Array, table: bytes | None) -> pa.Array:
    text = pc.fill_null(text, "").cast(pa.large_string())
    if table is None or not len(text):
        return text
    text = pa.concat_arrays([text.slice(0, 0), text]) if text.offset else text
    _, offsets, data = text.buffers()
    raw = data.to_pybytes().translate(table) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(text), offsets, pa.py_buffer(raw))


def words(text: pa.ChunkedArray | pa.Array, table: bytes | None) -> tuple[pa.Array, np.ndarray]:
    """All words of a column, flat, and the offsets of each row's words (one more than rows).

    Words are separated by U+0020 and U+0009 to U+000D. A null text has none.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    lists = pc.ascii_split_whitespace(_translated(text, table))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()
    kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not kept.all():
        ends = np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]]
        flat = flat.filter(pa.array(kept))
    return flat, np.asarray(ends - ends[0] if len(ends) else [0], dtype=np.int64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; the same for equal words everywhere."""
    if not len(flat):
        return np.empty(0, U64)
    coded = flat.dictionary_encode()
    own = pd.util.hash_array(
        coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False
    )
    return own[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of any run of words in one slice, from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        one = np.ones(1, U64)  # a plain 1 would turn the powers into floats
        self.up = np.multiply.accumulate(np.concatenate([one, np.full(n, _BASE, U64)]))
        down = np.multiply.accumulate(np.concatenate([one, np.full(n, _BASE_INV, U64)]))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * down[:n], dtype=U64)])

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """One hash for the ``length`` words from each ``start``; lengths are told apart."""
        raw = (self.sums[start + length] - self.sums[start]) * self.up[start]
        return mix(raw + np.asarray(length).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of ``width`` words inside rows, and the row of each."""
    per_row = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(per_row)), per_row)
    first = np.cumsum(per_row) - per_row
    return np.arange(per_row.sum()) - np.repeat(first - offsets[:-1], per_row), rows
