"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of n-grams are one class, and only classes are
compared. The n-grams of each class are put in one order: those that a sample
finds in many classes last. Two classes that link must share at least l of the
first n - ceil(0.8 n) + l n-grams (l is a tenth of the set): the size-derived
bound. So only these prefixes enter the product:

1. The columns (n-grams) are dealt to blocks by hash. A block multiplies its
   part of the incidence with its transpose and gives partial overlaps of pairs,
   pairs of incompatible size excluded. Partial overlaps are summed, and pairs below the
   bound are discarded.
2. A column that more than ``dense`` classes share is not squared. A class with k such
   columns in its prefix can share k of the l there, so its pairs need l - k others. Only
   classes with k >= l can link by dense columns alone: each such column ties them
   into one group by a star, so its cost is linear.
3. The surviving pairs and stars fall into groups that no link can leave. Each
   group's whole sets are multiplied again, densely, in row blocks of bounded
   size; this is exact, and gives links and, by union-find, what they connect.
   Groups larger than a block are multiplied block against block, in tasks of
   their own.

The order is the same for all and so changes the cost only, never the result;
the sample and the limit on the list of frequent n-grams are therefore safe.
Sets are held as 64-bit hashes of n-grams, and classes as 64-bit sums of them.

Shuffles: a row of some 25 bytes for each n-gram of a prefix (three tenths of all), the
partial overlaps, and the texts of the groups. All are plain rows, in proportion to the
corpus, but for step 3: a group of G different texts costs G^2 / ``rows``
copies of a text.

Defined cases: null and empty texts have an empty set and link with nothing (each is a
component of its own); fewer words than n make one n-gram; equal sets always
link; very long texts are compared whole; repeated rows are one row each in the result, and
copies of each other; rows with a null id are answered but linked with nothing; ids of other
than whole-number types are refused. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _exchange as X
from sparkloom.llm import _rows, _text
from sparkloom.llm._graph import components, saved

WORDS, PERCENT = 5, 80
#: Text whose sets are made at a time. A set takes some 30 times its text while it is made, and a slice's are gone before the next.
SLICE_BYTES = 2 << 20


class Sets:
    """The n-gram sets of some texts: ``hashes`` sorted within each row, ``offsets`` by row, ``n``, ``key`` of the set."""

    def __init__(self, texts, words: int = WORDS):
        flat, offsets = _text.words(texts, _text.LOWER)
        rolling = _text.Rolling(_text.word_hashes(flat))
        per_row = np.diff(offsets)
        starts, rows = _text.window_starts(offsets, words)
        short = np.flatnonzero((per_row > 0) & (per_row < words))
        hashes = np.concatenate([rolling.runs(starts, words), rolling.runs(offsets[:-1][short], per_row[short])])
        rows = np.concatenate([rows, short])
        order = np.argsort(hashes, kind="stable")
        order = order[np.argsort(_small_ints(rows[order]), kind="stable")]
        hashes, rows = hashes[order], rows[order]
        if len(rows):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])
            hashes, rows = hashes[new], rows[new]
        self.hashes, self.rows = hashes, rows
        self.n = np.bincount(rows, minlength=len(per_row))
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(hashes), dtype=np.uint64)])
        self.key = _text.mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def _small_ints(x: np.ndarray) -> np.ndarray:
    """As 16-bit integers where they fit: those are sorted by radix."""
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set it links with."""
    return -(-percent * n // 100)


def _depth(n):
    """How many n-grams of the prefixes must be shared, from one set's size."""
    return np.maximum(n // 10, 1)


def members(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, cls`` of every row of ``id, text``; ``cls`` is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text", SLICE_BYTES):
            yield of(part)

    def of(part: pa.Table) -> pa.RecordBatch:
        sets = Sets(part["text"], words)
        return pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(sets.n, pa.int64()), pa.array(sets.key, mask=sets.n == 0)], ["doc_id", "n_shingles", "cls"])

    return docs.select("id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long")


def frequent(docs: DataFrame, text_col: str, words: int, sample: int, least: int, most: int) -> np.ndarray:
    """Up to ``most`` n-grams of at least ``least`` classes of a sample of one in ``sample`` classes, sorted."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text", SLICE_BYTES):
            yield of(part)

    def of(part: pa.Table) -> pa.RecordBatch:
        sets = Sets(part["text"], words)
        _, first = np.unique(sets.key, return_index=True)
        taken = np.zeros(len(sets.n), bool)
        taken[first] = True
        taken &= sets.key % sample == 0
        got, n = np.unique(sets.hashes[taken[sets.rows]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])

    source = docs.select(F.col(f"`{text_col}`").alias("text"))
    counted = saved(source.mapInArrow(send, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    # from the highest counts down, as many whole counts as fit; the driver gets a histogram, then ``most`` at most
    cut, room = None, most
    for r in sorted(counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["n"]):
        if r["rows"] > room:
            break
        cut, room = r["n"], room - r["rows"]
    if cut is None:
        return np.empty(0, np.uint64)
    top = counted.filter(F.col("n") >= cut).select("hash").toArrow()
    return np.sort(top["hash"].to_numpy().view(np.uint64))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
_DENSE = pa.schema([("cls", pa.int64()), ("hash", pa.int64()), ("n", pa.int64())])


def prefixes(docs: DataFrame, text_col: str, words: int, percent: int, blocks: int, last) -> DataFrame:
    """The prefix incidence: ``block, hash, cls, n``, each class once for each slice that has it; a block is a partition.

    Dealt by a hash of their numbers, several blocks would meet in one task, which sorts them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.text_slices(batches, "text", SLICE_BYTES):
            yield of(part)

    def of(part: pa.Table) -> pa.RecordBatch:
        late, edges = last.value, X.block_edges(blocks)
        sets = Sets(part["text"], words)
        some = np.flatnonzero(sets.n > 0)
        _, first = np.unique(sets.key[some], return_index=True)
        chosen = np.zeros(len(sets.n), bool)
        chosen[some[first]] = True
        hot = np.isin(sets.hashes, late).astype(np.int64) if len(late) else np.zeros(len(sets.hashes), np.int64)
        order = np.argsort(_small_ints(sets.rows * 2 + hot), kind="stable")
        rows = sets.rows[order]
        place = np.arange(len(rows)) - sets.offsets[rows]
        n = sets.n[rows]
        kept = chosen[rows] & (place < n - _need(n, percent) + _depth(n))
        hashes, rows = sets.hashes[order][kept], rows[kept]
        # prefixes hold the lowest hashes of their sets, so ranges of hashes would leave most blocks nearly empty
        block = np.searchsorted(edges, _text.mix(hashes), side="right").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(hashes.view(np.int64)), pa.array(sets.key[rows]), pa.array(sets.n[rows].astype(np.int32))], ["block", "hash", "cls", "n"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "block int, hash long, cls long, n int").repartitionById(blocks, F.col("block"))


class Incidence:
    """One block of columns: the classes of each column, by column; ``starts`` and ``length`` of the columns."""

    def __init__(self, table: pa.Table):
        cls, column = table["cls"].to_numpy(), table["hash"].to_numpy()
        self.classes, first, who = np.unique(cls, return_index=True, return_inverse=True)
        self.n = table["n"].to_numpy()[first].astype(np.int64)
        order = np.lexsort((who, column))
        column, who = column[order], who[order]
        new = np.concatenate([[True], (column[1:] != column[:-1]) | (who[1:] != who[:-1])])  # copies in several slices
        self.column, self.who = column[new], who[new]
        self.starts = np.flatnonzero(np.concatenate([[True], self.column[1:] != self.column[:-1]]))
        self.length = np.diff(np.append(self.starts, len(self.column)))


def _product(percent: int, dense: int, room: int = 1 << 17):
    """Partial overlaps of the pairs of classes of one block of columns; about ``room`` pairs are made at a time."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = Incidence(table)
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for m in np.unique(x.length[(x.length > 1) & (x.length <= dense)]).tolist():
            own, (i, j) = x.starts[x.length == m], np.triu_indices(m, 1)
            step = max(1, room // len(i))
            for at in range(0, len(own), step):
                block = x.who[own[at : at + step, None] + np.arange(m)]
                a, b = block[:, i].ravel(), block[:, j].ravel()
                fits = percent * np.maximum(x.n[a], x.n[b]) <= 100 * np.minimum(x.n[a], x.n[b])
                pairs, counts = _added(pairs, counts, a[fits] * len(x.classes) + b[fits])
        a, b = pairs // len(x.classes), pairs % len(x.classes)
        return pa.Table.from_arrays([pa.array(x.classes[a]), pa.array(x.classes[b]), pa.array(counts), pa.array(x.n[a]), pa.array(x.n[b])], schema=_PAIRS)

    return run


def _dense(dense: int):
    """The entries of the dense columns of one block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = Incidence(table)
        on = np.repeat(x.length > dense, x.length)
        return pa.Table.from_arrays([pa.array(x.classes[x.who[on]]), pa.array(x.column[on]), pa.array(x.n[x.who[on]])], schema=_DENSE)

    return run


def candidates(posted: DataFrame, percent: int, dense: int) -> DataFrame:
    """``u, v``: pairs of classes that reach the bound, and stars of those that dense columns alone might link."""
    by_block = posted.groupBy("block")
    depth = lambda n: F.greatest(F.floor(n / 10), F.lit(1))
    heavy = by_block.applyInArrow(_dense(dense), "cls long, hash long, n long")
    heavy = saved(heavy)
    many = saved(heavy.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")))
    k = lambda side: many.select(F.col("cls").alias(side), F.col("k").alias(f"k{side}"))
    overlaps = by_block.applyInArrow(_product(percent, dense), "a long, b long, shared long, na long, nb long")
    overlaps = overlaps.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.least(F.first("na"), F.first("nb")).alias("n"))
    bound = depth(F.col("n")) - F.coalesce(F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))), F.lit(0))
    pairs = overlaps.join(k("a"), "a", "left").join(k("b"), "b", "left").filter(F.col("shared") >= bound).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # the smallest partner of a class of n n-grams has percent n / 100 of them
    able = many.filter(F.col("k") >= depth(F.floor(F.col("n") * percent / 100))).select("cls")
    tied = heavy.join(able, "cls").select("cls", "hash")
    hubs = tied.groupBy("hash").agg(F.min("cls").alias("hub"))
    stars = tied.join(hubs, "hash").filter("hub <> cls").select(F.col("hub").alias("u"), F.col("cls").alias("v")).distinct()
    return pairs.unionByName(stars)


def _added(pairs: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got, n = np.unique(more, return_counts=True)
    if not len(pairs):
        return got, n.astype(np.int64)
    both, at = np.unique(np.concatenate([pairs, got]), return_inverse=True)
    return both, np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for linked pairs."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _overlaps(sets: Sets, left: np.ndarray, right: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Overlaps of every left row with every right row: a dense product over the columns they share."""
    columns, at, n = np.unique(sets.hashes, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    kept = n[at] > 1
    column, row = number[at[kept]], sets.rows[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = int((n > 1).sum())
    out = np.zeros((len(left), len(right)), np.float64)
    of_left, of_right = np.full(len(sets.n), -1), np.full(len(sets.n), -1)
    of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
    for start in range(0, total, chunk):
        a, b = np.searchsorted(column, [start, start + chunk])
        c, r = column[a:b] - start, row[a:b]
        x, y = np.zeros((len(left), chunk), np.float32), np.zeros((len(right), chunk), np.float32)
        on = of_left[r] >= 0
        x[of_left[r[on]], c[on]] = 1
        on = of_right[r] >= 0
        y[of_right[r[on]], c[on]] = 1
        out += x @ y.T
    return out


_LINKED = pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("parts", pa.int32())])


def _verify(words: int, percent: int):
    """All groups, or pairs of row blocks, of one task: exact links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cls", "ascending")])
        comp, i, j = (table[c].to_numpy() for c in ("comp", "i", "j"))
        starts = np.flatnonzero(np.concatenate([[True], (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(comp)), strict=True):
            part = table.slice(int(a), int(b - a))
            sets = Sets(part["text"], words)
            cls, own, copies = part["cls"].to_numpy(), part["own"].to_numpy(), part["copies"].to_numpy()
            # one id may have several rows: of those with the class's own set, one stands for it
            right_text = np.zeros(len(cls), bool)
            same = np.flatnonzero(sets.key == cls)
            right_text[same[np.unique(cls[same], return_index=True)[1]]] = True
            one = i[a] == j[a]
            left = np.flatnonzero(right_text & ((own == i[a]) | one))
            right = left if one else np.flatnonzero(right_text & (own == j[a]))
            shared = _overlaps(sets, left, right).astype(np.int64)
            linked = 100 * shared >= percent * (sets.n[left][:, None] + sets.n[right][None, :] - shared)
            if one:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(cls), np.int64)
            links[left] += linked @ copies[right]
            if not one:
                links[right] += linked.T @ copies[left]
            x, y = np.nonzero(linked)
            root = _roots(len(cls), left[x], right[y])
            at = left if one else np.concatenate([left, right])
            out.append(pa.Table.from_arrays([pa.array(cls[at]), pa.array(cls[root[at]]), pa.array(links[at]), pa.array(part["parts"].to_numpy()[at].astype(np.int32))], schema=_LINKED))
        return pa.concat_tables(out)

    return run


def ngram_jaccard(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    sample: int = 8, least: int = 3, most: int = 500_000, dense: int = 64, rows: int = 512, slice_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, n_links``.

    ``n_links`` counts the linked rows, copies included. ``sample``, ``least``, ``most`` and ``dense``
    change the cost only; ``rows`` is the size of a row block in the exact product.
    """
    total = X.text_bytes(docs, text_col)
    blocks = X.sized(docs, total, 2 * slice_bytes)
    docs = docs.select(_rows.whole_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    with X.batch_bytes(docs.sparkSession, slice_bytes):  # all jobs with Python run in here
        own = saved(members(docs, words))
        classes = own.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        last = docs.sparkSession.sparkContext.broadcast(frequent(docs, "text", words, sample, least, most))  # 8 bytes each, ``most`` at most
        posted = prefixes(docs.filter("id is not null"), "text", words, percent, blocks, last)
        tied = candidates(posted, percent, dense)
        group = components(tied).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
        size = group.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        parts = F.when(F.col("size") <= 2 * rows, 1).otherwise(F.ceil(F.col("size") / rows)).cast("int")
        placed = group.join(size, "comp").join(classes, "cls").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
        tasks = X.sized(docs, total, slice_bytes)
        placed = placed.withColumn("task", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(tasks)).cast("int"))
        texts = docs.select(F.col("id").alias("rep"), "text")
        ready = texts.join(placed, "rep").select("task", "comp", "i", "j", "own", "parts", "cls", "copies", "text")
        found = saved(ready.groupBy("task").applyInArrow(_verify(words, percent), "cls long, root long, links long, parts int"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    whole = found.filter("parts = 1").select("cls", "root")
    split = found.filter("parts > 1")
    across = components(split.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "root")
    rooted = whole.unionByName(across).join(classes, "cls")
    named_root = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    answer = rooted.join(named_root, "root").select("cls", "least")
    # saved, so the join below gets its rows by an exchange of its own, whose large partitions can be split
    per_class = saved(classes.join(links, "cls", "left").join(answer, "cls", "left").select(
        "cls", F.coalesce(F.least("least", "rep"), "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ))
    answered = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(per_class, "cls", "left")
    return answered.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component; of rows that share it, the one whose text, then row, has the least hash.

    Rows with a null id stay.
    """
    found = ngram_jaccard(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    rows = _rows.packed(docs.filter(F.col(f"`{id_col}`").isNotNull()), doc_id=id_col, text=text_col)
    plain = [F.col("row").getField(f"c{i}") for i, f in enumerate(docs.schema.fields) if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    held = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.struct(F.xxhash64("text"), F.xxhash64(*plain)).alias("h")).join(kept, "doc_id", "left_semi")
    one = held.groupBy("doc_id").agg(F.min_by("row", "h").alias("row"))
    return _rows.unpacked(one, docs).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
