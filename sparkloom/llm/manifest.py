"""A Merkle manifest of a dataset: one tree for each language over its documents, one over the languages' roots.

A document's leaf is the SHA-256 of its columns, each as byte count, ``:`` and value (``-`` where null). A language's
leaves stand in ascending order of id; every ``FAN`` consecutive nodes become their parent until one is left, the language's subroot. The
subroots, by language (null first, then bytewise), become the root in the same way. Digests are lowercase hex, also where they are hashed.

The trees grow in supersteps over an RDD, as in Pregel. In each one every node sends its digest to the block that its parents are in;
a block that has heard from all its nodes (it knows how many from the number of nodes on their level) hashes them, ``STEPS`` levels high, and its top is a node
of the next superstep; a node that is alone on its level is done. Then the supersteps run in reverse: each block sends down to each
of its nodes the digests of the siblings on the way to its top and the path that the top got itself. A leaf so gets its whole proof, and folds its own digest
with it to a root, which verifies the document. The last step down is taken inside blocks, so a path is sent to each block of leaves once.

Every exchange is by (language, number of the block): no key has more than ``BLOCK`` rows, however large a language is. Leaves are numbered after a sort by language, id and leaf into ranges:
each range tells the driver how many leaves of its first and last language it has, and nothing else, and so learns where its first one starts.
Texts are hashed where they are read; after that only ids and digests are exchanged. Lost partitions are made anew from the exchanges before
them, in the same order.

``tampered`` documents (those whose CRC-32 of the decimal id is a multiple of 3) are verified with a text whose A-Z are lower-cased, so
a manifest that notices changes tells exactly those apart that the change alters.

Defined cases: null columns as said. Ids may repeat or be null (null first); rows of one id stand in the order of their leaves, and rows that are
equal have equal leaves. A lone leaf is its language's subroot, a lone subroot the root; the proof of a leaf without any sibling is the hash of nothing. Texts are hashed whole. Other columns aren't read. An
empty table has no leaves and gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _rows
from sparkloom.llm._graph import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Levels that a superstep grows, and the nodes of a block, which grows them in one task.
STEPS = 3
BLOCK = FAN**STEPS
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def leaf_of(head: list[bytes | None], text: bytes | None) -> str:
    h = sha256(b"".join(map(_field, head)))
    h.update(_field(text))
    return h.hexdigest()


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, lang, leaf, presented``: the leaf of each row, and that of the row as it is verified (null where they are the same)."""
    for batch in batches:
        made, shown = [], []
        columns = [batch[c].cast(pa.binary()) for c in FIELDS]
        for row in zip(*columns, strict=True):
            own = [v.as_py() for v in row]
            made.append(leaf_of(own[:-1], own[-1]))
            tampered = own[-1] is not None and own[0] is not None and zlib.crc32(own[0]) % 3 == 0
            shown.append(leaf_of(own[:-1], own[-1].translate(_LOWER)) if tampered else None)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["lang"], pa.array(made, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "lang", "leaf", "presented"])


def _ends(rows: Iterator) -> Iterator[tuple]:
    """Of a sorted partition: its first and last language with their leaves, how many languages it has, and the leaves of the largest."""
    first = last = None
    at_first = at_last = langs = most = 0
    for row in rows:
        if not langs or row[1] != last:
            last, at_last, langs = row[1], 0, langs + 1
            first = last if langs == 1 else first
        at_last += 1
        at_first += langs == 1
        most = max(most, at_last)
    return iter([(first, at_first, last, at_last, langs, most)])


def _starts(ends: list[tuple]) -> list[tuple[int, int, dict[int, int]]]:
    """For each partition: the number of its first language, how many leaves that one has before it, and the sizes of its first and last language."""
    at: list[tuple[int, int, int]] = []
    sizes: dict[int, int] = {}
    number, before, last = -1, 0, None
    for first, at_first, end, at_end, langs, _ in ends:
        if langs:
            if number < 0 or first != last:
                number, before = number + 1, 0
            sizes[number] = sizes.get(number, 0) + at_first
            at.append((number, before, langs))
            if langs > 1:
                number, before = number + langs - 1, 0
                sizes[number] = sizes.get(number, 0) + at_end
            before, last = before + (at_end if langs > 1 else at_first), end
        else:
            at.append((0, 0, 0))
    return [(n, b, {x: sizes[x] for x in ((n, n + langs - 1) if langs else ())}) for n, b, langs in at]


def numbered(rows: RDD, starts: list[tuple[int, int, dict[int, int]]]) -> RDD:
    """``((language, position), (leaves of the language, leaf, row))`` for each row of the sorted partitions."""
    known = rows.context.broadcast(starts)  # a few numbers for each partition

    def run(i: int, part: Iterator) -> Iterator:
        number, at, border = known.value[i]
        begun, last, waiting = False, None, []
        for row in part:
            if begun and row[1] != last:
                yield from (((number, k), (len(waiting), r[2], r)) for k, r in enumerate(waiting))
                number, at, waiting = number + 1, 0, []
            begun, last = True, row[1]
            if number in border:
                yield (number, at), (border[number], row[2], row)
                at += 1
            else:  # a language that begins and ends in this partition
                waiting.append(row)

    return rows.mapPartitionsWithIndex(run)


def _heard(message: tuple) -> tuple:
    """A block whose nodes have all arrived: nodes left after its levels, the digest of its top, its nodes in order, its levels.

    A block holds ``BLOCK`` consecutive nodes of one level, or a whole smaller tree, and grows ``STEPS`` levels, or up to the tree's top.
    """
    (tree, number), got = message
    nodes = sorted(got, key=lambda c: c[0])
    size = nodes[0][1]
    if len(nodes) != min(BLOCK, size - BLOCK * number):
        raise RuntimeError(f"block {number} of tree {tree} heard from {len(nodes)} nodes")
    levels = [[c[2] for c in nodes]]
    while size > 1 and len(levels) <= STEPS:
        last = levels[-1]
        levels.append([digest(last[i : i + FAN]) for i in range(0, len(last), FAN)])
        size = -(-size // FAN)
    return (tree, number), (size, levels[-1][0], nodes, levels)


def climb(nodes: RDD, most: int, parts: int) -> tuple[list[RDD], RDD]:
    """The blocks of each superstep, and ``(tree, digest)`` of the tops, of trees of nodes ``((tree, position), (nodes of the level, digest, more))``.

    ``most`` is the size of the largest tree.
    """
    blocks, tops = [], []
    while True:
        sent = nodes.map(lambda x: ((x[0][0], x[0][1] // BLOCK), (x[0][1], *x[1])))
        heard = sent.groupByKey(parts).map(_heard, preservesPartitioning=True)
        blocks.append(heard)
        tops.append(heard.filter(lambda x: x[1][0] == 1).map(lambda x: (x[0][0], x[1][1])))
        if most <= BLOCK:
            return blocks, nodes.context.union(tops) if len(tops) > 1 else tops[0]
        nodes = heard.filter(lambda x: x[1][0] > 1).map(lambda x: (x[0], (x[1][0], x[1][1], None)))
        parts, most = -(-parts // FAN), -(-most // BLOCK)


def _children(nodes: list[tuple], levels: list[list[str]]) -> Iterator[tuple]:
    """Each node of a block with the digests of the siblings, left and right, that it meets on its way to the block's top."""
    for k, node in enumerate(nodes):
        path, at = [], k
        for level in levels[:-1]:
            first = at // FAN * FAN
            path.append((level[first:at], level[at + 1 : first + FAN]))
            at //= FAN
        yield node, path


def _met(blocks: RDD, paths: RDD) -> RDD:
    """Blocks and what their tops were told, by key: only paths are exchanged."""
    n = blocks.getNumPartitions()
    return blocks.cogroup(paths.partitionBy(n), n)


def _told(message: tuple) -> Iterator[tuple]:
    """What a block sends to each of its nodes: the siblings there, before the path that its top was told. Told of no block, it waits: its tree is lower."""
    (tree, number), (blocks, told) = message
    for top, path in told:
        for _, _, nodes, levels in blocks:
            for node, own in _children(nodes, levels):
                yield (tree, node[0]), (top, own + path)
        if not len(blocks):
            yield (tree, number), (top, path)


def descend(blocks: list[RDD], paths: RDD) -> RDD:
    """``(node, (top, path))`` of the nodes of the lowest blocks, from those of the tops, ``((tree, 0), (top, path))``."""
    for step in reversed(blocks):
        paths = _met(step, paths).flatMap(_told)
    return paths


def fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> str:
    for left, right in path:
        leaf = digest([*left, leaf, *right])
    return leaf


def _proven(message: tuple) -> Iterator[tuple]:
    """The rows of a block of leaves."""
    _, (blocks, told) = message
    for subroot, path in told:
        for _, _, nodes, levels in blocks:
            for (_, _, leaf, row), own in _children(nodes, levels):
                whole = own + path
                yield row[0], leaf, subroot, digest([d for left, right in whole for d in left + right]), fold(row[3] or leaf, whole)


def manifest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs`` (columns ``source, lang, n_chars, text`` besides the id)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(_rows.whole_ids(docs, id_col).alias("id"), *[F.col(f"`{id_col if c == 'doc_id' else c}`").cast("string").alias(c) for c in FIELDS])
    made = written(own.mapInArrow(leaves, "doc_id long, lang string, leaf string, presented string"))
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    rows = made.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd.map(tuple)
    ends = rows.mapPartitions(_ends).collect()  # one row for each partition
    starts = _starts(ends)
    langs = max((n + e[4] for (n, _, _), e in zip(starts, ends, strict=True) if e[4]), default=0)
    if not langs:
        return spark.createDataFrame([], RESULT)
    most = max(max([e[5], *border.values()]) for (_, _, border), e in zip(starts, ends, strict=True))
    blocks, tops = climb(numbered(rows, starts), most, parts)
    above, top = climb(tops.map(lambda x: ((0, x[0]), (langs, x[1], None))), langs, parts)
    root = top.first()[1]
    told = descend(above, spark.sparkContext.parallelize([((0, 0), (root, []))], 1)).map(lambda x: (x[0][1], x[1][1]))
    paths = descend(blocks[1:], tops.join(told, parts).map(lambda x: ((x[0], 0), x[1])))
    columns = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    proven = spark.createDataFrame(_met(blocks[0], paths).flatMap(_proven), columns, verifySchema=False)
    return proven.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
