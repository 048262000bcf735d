"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against an index of all earlier documents.

The reference of a document is every document with a smaller id. It is indexed
by segments: each window of 13 words is known by its anchor, the one of its five-word
n-grams with the least hash; consecutive windows with one anchor make a segment, of
about five windows. So equal windows always lie in segments with equal
anchors, and inside a copied passage the segments are equal as a whole.

1. Every slice of documents sends one row for each distinct segment: anchor, hash,
   and the first place (id, word) it has there. Spark deals the rows by anchor, and
   each segment gets the earliest place it has anywhere.
2. Only where one anchor has different segments (at the edges of copied
   passages) must windows be compared singly: these segments are sent once more
   as windows, which also find their earliest places.
3. A document is then parsed greedily: a factor starts at the first window that stands
   in the reference and grows as long as the next window's earliest place is the next
   word of the same document. A factor so is verbatim in its source, has at least 13
   words, and is returned with source and place. The windows across the border of two
   factors were looked up like all others, so no covered word is missed.

The source is the earliest one, not the one with the longest match: which words are
removed doesn't depend on it. Hashes have 64 bits: two different texts share one
with a chance of n^2 / 2^65, about one in 10^4 for 30 million segments.

Shuffles: the texts once (by a hash of the row, used by all three passes), a row of
some 25 bytes for each distinct segment of a slice (a fifth of its words), and one row
back for each segment that is found. All are plain rows, so what is exchanged grows in
proportion to the corpus. A passage that stands in a third of all documents is a few rows a slice.

Defined cases: a null text has no words; texts of fewer than 13 words have no
windows and stay whole; very long texts are one row of one slice, never cut; words
that repeat inside one document only are kept; rows that share an id are judged alike
and never against each other; rows with a null id come after all others and are not
judged against each other; ids of other than whole-number types are refused; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from sparkloom.llm import _exchange as X
from sparkloom.llm import _rows, _text

WINDOW, ANCHOR = 13, 5
_LAST = np.iinfo(np.int64).max
_SEGMENTS = pa.schema([("slice", pa.int32()), ("anchor", pa.int64()), ("hash", pa.int64()), ("id", pa.int64()), ("place", pa.int32())])
_WINDOWS = pa.schema([("slice", pa.int32()), ("hash", pa.int64()), ("id", pa.int64()), ("place", pa.int32()), ("most", pa.int64())])


class Segments:
    """The windows of one slice and the segments they lie in."""

    def __init__(self, table: pa.Table, width: int):
        self.width, anchor = width, min(ANCHOR, width)
        self.ids = pc.fill_null(table["id"], _LAST).to_numpy()
        self.flat, self.offsets = _text.words(table["text"], _text.AS_IS)
        self.starts, self.rows = _text.window_starts(self.offsets, width)
        self.rolling = _text.Rolling(_text.word_hashes(self.flat))
        if not len(self.starts):
            self.number = self.first = self.row = np.empty(0, np.int64)
            self.anchor = self.hash = np.empty(0, np.int64)
            return
        grams = self.rolling.runs(np.arange(len(self.flat) - anchor + 1), anchor)
        least = np.lib.stride_tricks.sliding_window_view(grams, width - anchor + 1).argmin(axis=1)
        at = self.starts + least[self.starts]  # the anchor of each window
        new = np.concatenate([[True], at[1:] != at[:-1]])
        self.number = np.cumsum(new) - 1  # of the segment, by window
        self.first = np.flatnonzero(new)
        last = np.append(self.first[1:], len(at)) - 1
        self.row = self.rows[self.first]
        self.anchor = grams[at[self.first]].view(np.int64)
        self.hash = self.rolling.runs(self.starts[self.first], self.starts[last] - self.starts[self.first] + width).view(np.int64)

    def places(self, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        return start - self.offsets[row]

    def windows(self) -> np.ndarray:
        return self.rolling.runs(self.starts, self.width).view(np.int64)


def _earliest(key: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each distinct key, which entry has the smallest id and place."""
    order = np.lexsort((places, ids, key))
    return order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order


def _send(width: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        s = Segments(table, width)
        ids, places = s.ids[s.row], s.places(s.starts[s.first], s.row)
        e = _earliest(s.hash, ids, places)
        return pa.Table.from_arrays([pa.array(np.full(len(e), key[0].as_py(), np.int32)), pa.array(s.anchor[e]), pa.array(s.hash[e]), pa.array(ids[e]), pa.array(places[e].astype(np.int32))], schema=_SEGMENTS)

    return send


def _send_windows(width: int):
    """The single windows of the segments that were asked for, with the smallest and the largest id of each."""

    def send(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _WINDOWS.empty_table()
        s = Segments(table, width)
        on = np.isin(s.hash, asked["hash"].to_numpy())[s.number] if len(s.number) else np.empty(0, bool)
        hashes, rows = s.windows()[on], s.rows[on]
        ids, places = s.ids[rows], s.places(s.starts[on], rows)
        e = _earliest(hashes, ids, places)
        most = np.full(len(e), np.iinfo(np.int64).min)
        np.maximum.at(most, np.searchsorted(hashes[e], hashes), ids)
        return pa.Table.from_arrays([pa.array(np.full(len(e), key[0].as_py(), np.int32)), pa.array(hashes[e]), pa.array(ids[e]), pa.array(places[e].astype(np.int32)), pa.array(most)], schema=_WINDOWS)

    return send


class Sources:
    """What came back to a slice: the earliest place of segments and windows, by hash."""

    def __init__(self, back: pa.Table):
        key, ids, places = back["hash"].to_numpy(), back["source"].to_numpy(), back["place"].to_numpy().astype(np.int64)
        e = _earliest(key, ids, places)
        self.key, self.ids, self.places = key[e], ids[e], places[e]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.full(len(key), _LAST), np.zeros(len(key), np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        on = self.key[i] == key
        return np.where(on, self.ids[i], _LAST), np.where(on, self.places[i], 0)


def parse(s: Segments, sources: Sources) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The factors of all rows: row, first word, word after the last, source id, first word there."""
    starts = s.starts[s.first] if len(s.first) else s.first
    # the segment's earliest place: in this slice, or elsewhere
    own = s.places(starts, s.row)
    e = _earliest(s.hash, s.ids[s.row], own)
    at = np.searchsorted(s.hash[e], s.hash)
    here, place = s.ids[s.row[e]][at], own[e][at]
    there, other = sources.find(s.hash)
    here, place = np.where(there < here, there, here), np.where(there < here, other, place)
    # by window; single windows may have been found where their segment was not
    source, place = here[s.number], place[s.number] + s.starts - starts[s.number]
    single, other = sources.find(s.windows())
    mine = s.ids[s.rows]
    use = (source >= mine) & (single < mine)
    source, place = np.where(use, single, source), np.where(use, other, place)
    found = np.flatnonzero(source < mine)
    if not len(found):
        return found, found, found, found, found
    source, shift = source[found], place[found] - s.starts[found]
    grows = (np.diff(found) == 1) & (np.diff(s.rows[found]) == 0) & (np.diff(source) == 0) & (np.diff(shift) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~grows]))
    last = np.append(first[1:], len(found)) - 1
    return s.rows[found[first]], s.starts[found[first]], s.starts[found[last]] + s.width, source[first], place[found[first]]


def _cut(width: int, kept_columns: list[str], schema: pa.Schema):
    def cut(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        s = Segments(table, width)
        row, start, end, source, place = parse(s, Sources(back))
        n, total = len(s.offsets) - 1, len(s.flat)
        edges = np.zeros(total + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, end, -1)
        gone = np.cumsum(edges)[:-1] > 0
        counts = np.concatenate([[0], np.cumsum(~gone)])[s.offsets]
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), s.flat.filter(pa.array(~gone)).cast(pa.string())), " ")
        fields = [start - s.offsets[row], end - s.offsets[row], source, place] if len(row) else [np.empty(0, np.int64)] * 4
        spans = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "end", "source", "source_start"])
        n_words = np.diff(s.offsets)
        out = {
            "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - np.diff(counts), pa.int64()),
            "factors": pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), spans).cast(schema.field("factors").type),
            "kept": words.cast(schema.field("kept").type),
        }
        return pa.Table.from_arrays([table[c].cast(schema.field(c).type) for c in kept_columns] + [out[f] for f in schema.names[len(kept_columns) :]], schema=schema)

    return cut


def segments(by_slice, width: int) -> DataFrame:
    """``slice, anchor, hash, id, place``: the distinct segments of each slice."""
    return by_slice.applyInArrow(_send(width), "slice int, anchor long, hash long, id long, place int")


def _looked_up(entries: DataFrame, *key: str) -> DataFrame:
    """With ``source, place``: the earliest place of each entry's hash anywhere."""
    order = Window.partitionBy(*key).orderBy("id", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("source", F.first("id").over(order)).withColumn("source_place", F.first("place").over(order))


def substring_dedup(
    docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None, slice_bytes: int = 6 << 20
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, factors, kept``, and the column ``keep`` as it was.

    ``factors`` are word ranges with the id and first word of their source; they may overlap.
    ``kept`` is the other words joined by one space.
    """
    slices = X.sized(docs, X.text_bytes(docs, text_col), slice_bytes)
    columns = [_rows.whole_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id")]
    columns += [F.col(f"`{keep}`").alias("row")] if keep else []
    source = docs.select(*columns).withColumn("slice", X.slice_of(slices, F.col("id"), F.col("text")))
    passed = ["doc_id"] + (["row"] if keep else [])
    out = StructType(
        [StructField(c, source.schema[c].dataType) for c in passed]
        + _parse_datatype_string("n_words long, n_removed long, factors array<struct<start:long,end:long,source:long,source_start:long>>, kept string").fields
    )
    by_slice = source.groupBy("slice")
    anchors = Window.partitionBy("anchor").orderBy("hash", "id", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entries = segments(by_slice, width).withColumn("many", F.first("hash").over(anchors) != F.last("hash").over(anchors))
    entries = _looked_up(entries, "anchor", "hash")
    asked = entries.filter("many and source = id").select("slice", "hash")
    windows = by_slice.cogroup(asked.groupBy("slice")).applyInArrow(_send_windows(width), "slice int, hash long, id long, place int, most long")
    # equal segments inside a slice are known there; a window may also be found in another segment of its own slice
    # (the test of "many" keeps both uses of the entries alike, so that Spark exchanges them once)
    answers = entries.filter("source < id and many is not null"), _looked_up(windows, "hash").filter("source < most")
    back = answers[0].unionByName(answers[1], allowMissingColumns=True).select("slice", "hash", "source", F.col("source_place").alias("place"))
    found = by_slice.cogroup(back.groupBy("slice")).applyInArrow(_cut(width, passed, to_arrow_schema(out)), out)
    return found.withColumnRenamed("row", keep) if keep else found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts.

    Texts that lose nothing stay as they were, white space too; rows that lose every word go.
    """
    done = substring_dedup(_rows.packed(docs, doc_id=id_col, text=text_col), keep="row", **options).filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    was = F.col("row").getField(f"c{docs.columns.index(text_col)}")
    return _rows.unpacked(done, docs, **{text_col: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(was)})
