"""Benchmark decontamination with suffix arrays over the training shards.

Every shard (a slice of the documents) gets an array of its word suffixes in
sorted order. Every suffix of every benchmark item is searched in it by bisection, one
word deeper each round until nothing matches, which gives the longest verbatim match and
all of its places. Matches of a whole window (10 words, or the whole of a shorter item)
mark the words they cover.

The array is sparse: a suffix that opens with a word no item has cannot match,
so it is left out. Windows that match the same places are one class, and classes with the
same items one set, so a passage shared by K items and M places takes K + M entries.

The benchmark goes to the workers in blocks of ``block_bytes``, and no more than
``pass_bytes`` of it at a time: a larger benchmark takes several passes over the documents,
each written to the shared folder before the next. A text is cut into words once a pass.

Defined cases: null and empty texts have no words, are not contaminated and
have no items; null item texts have no windows; rows with a null item id are
not searched for; equal item ids are one item; repeated documents are answered
each; very long texts are one shard, never cut; without items nothing is hit. Null document
ids are kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sparkloom.llm import _rows, _text
from sparkloom.llm._graph import saved

ITEM_WINDOW = 10
_SCHEMA = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long"


@dataclass
class Items:
    """A block of benchmark items as word ranks; the rank 0 stands for every other word."""

    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray  # ranks from 1, all items one after the other
    offsets: np.ndarray

    @classmethod
    def of(cls, names: list[str], texts: list[str | None]) -> Items:
        flat, offsets = _text.words(pa.array(texts, pa.large_string()), _text.LOWER_ALNUM)
        hashes = _text.word_hashes(flat)
        vocabulary, ranks = np.unique(hashes, return_inverse=True)
        return cls(names, vocabulary, ranks.astype(np.int64) + 1, offsets)


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that open with a known word, sorted by their first ``depth`` words.

    Ranks are doubled: the order by 2k words comes from the order by k words here and k words on.
    """
    order = ranks.copy()
    n = len(ranks)
    width = 1
    while width < depth:
        step = min(width, depth - width)
        onward = np.zeros(n, np.int64)
        onward[: max(n - step, 0)] = order[step:] if n > step else 0
        at = np.flatnonzero(ranks)
        key = order[at] * (int(order.max(initial=0)) + 1) + onward[at]
        new = np.zeros(n, np.int64)
        new[at] = np.unique(key, return_inverse=True)[1] + 1
        # a suffix is known by its first word, so unknown ones stay 0
        order, width = new, width + step
    at = np.flatnonzero(ranks)
    return at[np.argsort(order[at], kind="stable")]


class Shard:
    """The suffix array of one slice of documents, for one block of items."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, items: Items):
        at = np.minimum(np.searchsorted(items.vocabulary, hashes), max(len(items.vocabulary) - 1, 0))
        known = items.vocabulary[at] == hashes if len(items.vocabulary) else np.zeros(len(hashes), bool)
        # a mark after each document keeps suffixes from running into the next one
        self.offsets = offsets + np.arange(len(offsets))
        self.ranks = np.zeros(len(hashes) + len(offsets), np.int64)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.ranks[place] = np.where(known, at + 1, 0)
        self.order = suffix_array(self.ranks, int(np.diff(items.offsets).max(initial=1)))

    def search(self, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth, the suffixes of items that still match, and their ranges in the array."""
        n = len(items.words)
        left = np.repeat(items.offsets[1:], np.diff(items.offsets)) - np.arange(n)  # words to the item's end
        suffix, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.order))
        depth = 0
        while len(suffix):
            on = left[suffix] > depth
            suffix, low, high = suffix[on], low[on], high[on]
            want = items.words[suffix + depth]
            low, high = self._bisect(low, high, want, depth), self._bisect(low, high, want + 1, depth)
            on = high > low
            suffix, low, high = suffix[on], low[on], high[on]
            depth += 1
            if len(suffix):
                yield depth, suffix, low, high

    def _bisect(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
        """The first place in each range whose word ``depth`` words on is ``want`` or later."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = np.minimum(self.order[np.minimum(middle, len(self.order) - 1)] + depth, len(self.ranks) - 1)
            less = open_ & (self.ranks[at] < want)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low


def _flat_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each is of."""
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size), which


Found = tuple[list[tuple[int, int]], list[str], int]


def match(hashes: np.ndarray, offsets: np.ndarray, items: Items, width: int) -> list[Found]:
    """For each text: spans of words inside windows of items, the items, the longest match in words."""
    shard = Shard(hashes, offsets, items)
    n = len(offsets) - 1
    item_of = np.repeat(np.arange(len(items.names)), np.diff(items.offsets))
    size = np.diff(items.offsets)
    edges = np.zeros(len(shard.ranks) + 1, np.int64)
    found: list[np.ndarray] = []
    deepest = np.zeros(len(shard.order), np.int64)  # by place in the array
    row_of = np.repeat(np.arange(n + 1), np.append(np.diff(shard.offsets), 1))[: len(shard.ranks)]
    for depth, suffix, low, high in shard.search(items):
        # ranges of one depth are equal or apart
        first = np.unique(low, return_index=True)[1]
        deepest[_flat_ranges(low[first], high[first])[0]] = depth
        whole = (depth == width) | ((depth < width) & (size[item_of[suffix]] == depth))
        if not whole.any():
            continue
        _, first, cls = np.unique(low[whole], return_index=True, return_inverse=True)
        places, of_class = _flat_ranges(low[whole][first], high[whole][first])
        starts = shard.order[places]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + depth, -1)
        found.append(_pairs(row_of[starts], of_class, cls, item_of[suffix[whole]], len(items.names)))
    longest = np.zeros(n + 1, np.int64)
    np.maximum.at(longest, row_of[shard.order], deepest)
    hit = np.cumsum(edges)[:-1] > 0
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
    of_row = np.split(pairs % max(len(items.names), 1), np.searchsorted(pairs // max(len(items.names), 1), np.arange(1, n)))
    change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    rows = row_of[starts] if len(starts) else starts
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans[r].append((a - int(shard.offsets[r]), b - int(shard.offsets[r])))
    return [(spans[i], [items.names[j] for j in of_row[i]] if n else [], int(longest[i])) for i in range(n)]


def _pairs(rows: np.ndarray, of_class: np.ndarray, cls: np.ndarray, item: np.ndarray, many: int) -> np.ndarray:
    """Distinct row * many + item, from the rows of each class and the items of each class.

    Classes with equal items are one set first.
    """
    members = np.unique(cls * many + item)
    cls, item = members // many, members % many
    key = np.zeros(int(cls[-1]) + 1, np.uint64)
    np.add.at(key, cls, _text.mix(item.astype(np.uint64) + np.uint64(1)))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    pairs = np.unique(rows * len(first) + number[of_class])
    row, one = pairs // len(first), first[pairs % len(first)]  # a class that stands for the set
    at, which = _flat_ranges(np.searchsorted(cls, one), np.searchsorted(cls, one, side="right"))
    return np.unique(row[which] * many + item[at])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark, a bounded part at a time: no more than one block is held by the driver."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    for i in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        got = sorted((r["item"], r["text"]) for r in part.collect())
        yield Items.of([g[0] for g in got], [g[1] for g in got])


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = ITEM_WINDOW, block_bytes: int = 8 << 20, pass_bytes: int = 64 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: str | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, spans, items, longest``, and the struct column ``keep`` as it was.

    A narrow stage over the documents: they are not shuffled, whatever the benchmark's size.
    """
    columns = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")] + ([F.col(f"`{keep}`").alias("row")] if keep else [])
    found = docs.select(*columns)
    held, room = [], pass_bytes
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if held and room < block_bytes:
            found = saved(_pass(found, held, width))
            for b in held:
                b.destroy()
            held, room = [], pass_bytes
        held.append(docs.sparkSession.sparkContext.broadcast(block))
        room -= block_bytes
    found = _pass(found, held, width).drop("text")
    return found.withColumnRenamed("row", keep) if keep else found


def _pass(source: DataFrame, blocks: list, width: int) -> DataFrame:
    """The documents with what was found in these blocks, and in those before."""
    answer = _parse_datatype_string(_SCHEMA)
    kept = [f for f in source.schema.fields if f.name not in answer.names]
    schema = StructType(kept + answer.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text"):
            flat, offsets = _text.words(part["text"], _text.LOWER_ALNUM)
            hashes = _text.word_hashes(flat)
            each = [match(hashes, offsets, b.value, width) for b in blocks]
            if "spans" in part.column_names:
                before = zip(*(part[c].to_pylist() for c in ("spans", "items", "longest")), strict=True)
                each.append([([(s["start"], s["end"]) for s in spans], items, longest) for spans, items, longest in before])
            rows = each[0] if len(each) == 1 else [_joined(x) for x in zip(*each, strict=True)]
            columns = [part[f.name].combine_chunks() for f in kept]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            spans = pa.array([[{"start": a, "end": b} for a, b in r[0]] for r in rows], arrow.field("spans").type)
            items = pa.array([sorted(set(r[1])) for r in rows], arrow.field("items").type)
            values = [pa.array(np.diff(offsets), pa.int64()), spans, items, pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(f.name).type) for c, f in zip(columns, kept, strict=True)), *values], schema=arrow)

    return source.mapInArrow(run, schema)


def _joined(parts: tuple[Found, ...]) -> Found:
    """One answer from the answers of several blocks."""
    spans: list[list[int]] = []
    for a, b in sorted(s for p in parts for s in p[0]):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans], [i for p in parts for i in p[1]], max(p[2] for p in parts)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`contamination`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "longest",
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns."""
    found = contamination(_rows.packed(docs, doc_id=id_col, text=text_col), benchmark, keep="row", **options)
    return _rows.unpacked(found.filter(F.size("spans") == 0), docs)
