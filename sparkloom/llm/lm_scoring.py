"""Stupid-backoff scores over count tables partitioned by hash.

Every slice of documents explodes its texts into n-grams and sends each distinct one,
with its count, to the block of the hash space it belongs to. The blocks are the count
tables, partitioned by hash: joined there with what the slices sent, every n-gram's count
over all documents goes back to the slices that have it, where scores are summed per document.

The n-grams of a slice and block travel as one row, sorted and packed: as single
rows of a join (some 150 million for 0.5 GB of Parquet, 14 bytes each, both ways) they need
more than four times the input on disk. So the count and the join of a block are done in its task.

A document is scored by all others: its own counts are taken off first, so text
that stands nowhere else backs off instead of predicting itself.

    s(w | u v) = c(u v w) / c(u v)   if c(u v w) > 0, else backoff * s(w | v), ...
    s(w)       = c(w) / N, or half a count if w stands in no other document

An n-gram of order 3 or more is sent only where both n-grams inside it stand in
other documents too; otherwise its own count without the document is 0 anyway.

N-grams are told apart by 64-bit hashes, whatever the size of the corpus.

Defined cases: null and empty texts have 0 words, log score 0 and null means;
very long texts are scored whole, as one row of one slice; rows equal in id and text are
one document for counting (so they never predict each other) and are scored each; in a
corpus of one document every word gets half a count; ids of other than whole-number
types are refused. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _exchange as X
from sparkloom.llm import _rows, _text

ORDER, BACKOFF = 3, 0.4
_SENT = pa.schema([("order", pa.int32()), ("block", pa.int32()), ("slice", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("slice", pa.int32()), ("order", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])


class Level:
    """The n-grams of one order in one slice."""

    def __init__(self, rolling: _text.Rolling, offsets: np.ndarray, doc: np.ndarray, order: int):
        self.starts, rows = _text.window_starts(offsets, order)
        hashes = rolling.runs(self.starts, order)
        self.hashes, self.at, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        # how often each occurrence's n-gram stands in its own document
        key = doc[rows] * max(len(self.hashes), 1) + self.at
        _, again, n = np.unique(key, return_inverse=True, return_counts=True)
        self.own = n[again]
        self.sent = np.ones(len(self.hashes), bool)
        self.all = np.zeros(len(self.hashes), np.int64)

    def bounds(self, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes to send and where each block of them starts."""
        kept = self.hashes[self.sent]
        return kept, X.cut(kept, blocks)

    def others(self) -> np.ndarray:
        """Counts in other documents, by occurrence."""
        return np.maximum(self.all[self.at] - self.own, 0)


class Slice:
    def __init__(self, table: pa.Table, order: int, blocks: int):
        _, self.doc = np.unique(table["row"].to_numpy(), return_inverse=True)
        flat, self.offsets = _text.words(table["text"], _text.LOWER)
        self.rolling = _text.Rolling(_text.word_hashes(flat))
        self.order, self.blocks = order, blocks
        self.levels = {k: self._level(k) for k in range(1, min(order, 2) + 1)}

    def _level(self, k: int) -> Level:
        return Level(self.rolling, self.offsets, self.doc, k)

    def take(self, backs: list[dict]) -> None:
        """Enter counts that came back, order by order, and open the next order."""
        by_order: dict[int, list[dict]] = {}
        for r in backs:
            by_order.setdefault(r["order"], []).append(r)
        for k in range(1, self.order + 1):
            if k not in self.levels:
                self.levels[k] = self._candidates(k)
            if k not in by_order and k > 2:
                return
            level = self.levels[k]
            _, bounds = level.bounds(self.blocks)
            counts = np.zeros(int(level.sent.sum()), np.int64)
            for r in by_order.get(k, []):
                counts[bounds[r["block"]] : bounds[r["block"] + 1]] = X.unplanes(r["counts"]).astype(np.int64)
            level.all[level.sent] = counts

    def _candidates(self, k: int) -> Level:
        level, below = self._level(k), self.levels[k - 1]
        known = np.zeros(len(self.rolling.up), bool)
        known[below.starts[below.others() > 0]] = True
        both = known[level.starts] & known[level.starts + 1]
        level.sent = np.zeros(len(level.hashes), bool)
        level.sent[level.at[both]] = True
        return level

    def messages(self, number: int, orders: list[int]) -> pa.Table:
        out = []
        for k in orders:
            level = self.levels[k]
            kept, bounds = level.bounds(self.blocks)
            counts = level.counts[level.sent]
            out += [
                {"order": k, "block": i, "slice": number, "hashes": X.pack_sorted(kept[a:b]), "counts": X.planes(counts[a:b])}
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                if b > a
            ]
        return pa.Table.from_pylist(out, schema=_SENT)

    def scores(self, total: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, summed log score, and words that the highest order predicted, by row."""
        n = np.diff(self.offsets)
        row = np.repeat(np.arange(len(n)), n)
        words_of = np.bincount(self.doc, weights=n)
        rest = np.maximum(total - words_of[self.doc[row]], 1)
        one = self.levels[1].others()
        value = np.maximum(one, 0.5) / rest
        top = np.zeros(len(row), bool)
        before = {1: one}
        for k in range(2, self.order + 1):
            level = self.levels[k]
            seen = level.others()
            context = np.zeros(len(row), np.int64)
            context[self.levels[k - 1].starts] = before[k - 1]
            last, first = level.starts + k - 1, level.starts
            used = seen > 0
            value[last] *= backoff  # words too near the start have no longer context to back off from
            value[last[used]] = seen[used] / np.maximum(context[first[used]], seen[used])
            top = np.zeros(len(row), bool)
            top[last[used]] = True
            before[k] = seen
        return n, np.bincount(row, weights=np.log(value), minlength=len(n)), np.bincount(row, weights=top, minlength=len(n)).astype(np.int64)


def _look_up(key: tuple, table: pa.Table) -> pa.Table:
    """One block of a count table: the sum over all slices, for each of them."""
    rows = table.to_pylist()
    hashes = [X.unpack_sorted(r["hashes"]) for r in rows]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([X.unplanes(r["counts"]) for r in rows])).astype(np.int64)[at]
    ends = np.cumsum([len(h) for h in hashes])
    out = [
        {"slice": r["slice"], "order": r["order"], "block": r["block"], "counts": X.planes(total[e - len(h) : e])}
        for r, h, e in zip(rows, hashes, ends.tolist(), strict=True)
    ]
    return pa.Table.from_pylist(out, schema=_BACK)


_OUT = "doc_id long, n_words long, log_score double, mean_log_score double, n_top long, top_share double"


def lm_scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 12 << 20
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, log_score, mean_log_score, n_top, top_share``.

    ``n_top`` counts the words that an n-gram of the full order predicted; ``top_share`` is their share.
    """
    text = F.col(f"`{text_col}`")
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    size, total = docs.agg(F.sum(F.octet_length(text)), F.sum(words)).first()
    size, total = size or 0, total or 0
    slices = blocks = X.sized(docs, size, slice_bytes)
    own = docs.select(_rows.whole_ids(docs, id_col).alias("id"), text.alias("text")).withColumn("row", F.xxhash64("id", "text"))
    by_slice = own.withColumn("slice", X.slice_of(slices, F.col("id"), F.col("text"))).groupBy("slice")
    sent_type, back_type = "order int, block int, slice int, hashes binary, counts binary", "slice int, order int, block int, counts binary"

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return Slice(table, order, blocks).messages(key[0].as_py(), list(range(1, min(order, 2) + 1)))

    def further(k: int):
        def send(key: tuple, table: pa.Table, backs: pa.Table) -> pa.Table:
            own = Slice(table, order, blocks)
            own.take(backs.to_pylist())
            return own.messages(key[0].as_py(), [k]) if k in own.levels else pa.Table.from_pylist([], schema=_SENT)

        return send

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64()), ("n_top", pa.int64()), ("top_share", pa.float64())])

    def score(key: tuple, table: pa.Table, backs: pa.Table) -> pa.Table:
        own = Slice(table, order, blocks)
        own.take(backs.to_pylist())
        n, log, top = own.scores(total, backoff)
        mean, share = (pa.array(x / np.maximum(n, 1), mask=n == 0) for x in (log, top))
        return pa.Table.from_arrays([table["id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(log), mean, pa.array(top), share], schema=schema)

    backs = by_slice.applyInArrow(first, sent_type).groupBy("order", "block").applyInArrow(_look_up, back_type)
    for k in range(3, order + 1):
        sent = by_slice.cogroup(backs.groupBy("slice")).applyInArrow(further(k), sent_type)
        backs = backs.unionByName(sent.groupBy("order", "block").applyInArrow(_look_up, back_type))
    return by_slice.cogroup(backs.groupBy("slice")).applyInArrow(score, _OUT)
