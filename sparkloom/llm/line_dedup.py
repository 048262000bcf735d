"""Line deduplication in DataFrame functions only: repeated lines go from all documents but the newest that has them.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at its ends, A-Z
lower-cased. A key of at least ``least_chars`` code points that stands in at least
``least_docs`` documents loses all its lines, save those of the document with the largest id.

No text is exchanged to find them. Each line of a document that is long enough sends its key's
MD5, the document and the position. The MD5s are cut into ranges, and inside a range rows are
sorted by MD5, document (largest first) and position; a window runs down that stream, so the first occurrence
of each key names the document that keeps it, and the rank of the last one tells in how many it stands.
What comes back for each document is its keep bitmap, run-length coded: the runs of lines that stay.

A key that fills more than ``hot`` lines doesn't enter that stream, where it would be
one task's work: its documents are counted and its largest id found by an aggregation that sums up before it shuffles,
and that verdict (of the ``most_hot`` most frequent keys at most, so it may be broadcast) meets the
lines where they are. Both ways give the same lines; a key beyond ``most_hot`` has less than 1 / ``most_hot`` of all lines.

Defined cases: a null or empty text is one empty line. Documents are told apart by id: rows that repeat an id count
once, and all keep or lose a line together; null ids count as one, the smallest. Without lines left the text is
empty. Very long lines and texts are taken whole. An empty table gives an empty one. Columns besides id and text are
returned as they are by :func:`without_repeated_lines`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _rows
from sparkloom.llm._graph import saved

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """``k`` (MD5 of the key), ``id``, ``t`` (hash of the text), ``pos``: one row for each line that is long enough. From ``id, text``."""
    keyed = F.transform(lines_of(F.col("text")), lambda x: _code(key_of(x), least_chars))
    return docs.select("id", F.xxhash64("text").alias("t"), F.posexplode(keyed).alias("pos", "k")).filter("k IS NOT NULL")


def _code(key: Column, least_chars: int) -> Column:
    return F.when(F.char_length(key) >= least_chars, F.md5(key.cast("binary")))


def hot_keys(found: DataFrame, hot: int, most_hot: int) -> DataFrame:
    """``k, docs, newest`` of the most frequent keys with more than ``hot`` lines."""
    counted = found.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("id").alias("newest"))
    return counted.filter(F.col("n") > hot).orderBy(F.desc("n"), "k").limit(most_hot).drop("n")


def repeated(docs: DataFrame, least_chars: int, least_docs: int, hot: int, most_hot: int) -> DataFrame:
    """``id, t, pos`` of the lines that go. From ``id, text``."""
    rows = saved(occurrences(docs, least_chars))
    by_doc = rows.groupBy("k", "id").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(hot_keys(by_doc, hot, most_hot))  # most_hot rows at most
    older = lambda of: F.col("id").isNull() & F.col(of).isNotNull() | (F.col("id") < F.col(of))
    at_once = rows.join(known, "k").filter((F.col("docs") >= least_docs) & older("newest"))
    key = Window.partitionBy("k")
    stream = key.orderBy(F.desc_nulls_last("id"))
    rest = rows.join(known, "k", "left_anti").repartitionByRange("k")
    ranked = rest.withColumn("newest", F.first("id").over(stream.orderBy(F.desc_nulls_last("id"), "t", "pos"))).withColumn("rank", F.dense_rank().over(stream))
    streamed = ranked.withColumn("docs", F.max("rank").over(key)).filter((F.col("docs") >= least_docs) & older("newest"))
    return at_once.select("id", "t", "pos").unionByName(streamed.select("id", "t", "pos"))


def kept_runs(dropped: Column, n: Column) -> Column:
    """Runs of lines that stay, as ``from, lines``, given the sorted positions of the others and the number of lines."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    ends = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), ends).alias("after"), F.concat(starts, F.array(n)).alias("before"))
    runs = F.transform(edges, lambda e: F.struct((e["after"] + 1).alias("from"), (e["before"] - e["after"] - 1).alias("lines")))
    return F.filter(runs, lambda r: r["lines"] > 0)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, hot: int = 1_000, most_hot: int = 20_000,
) -> DataFrame:
    """``id, t, dropped, keep`` of the documents that lose lines; ``t`` is the hash of the text, ``keep`` the bitmap's runs, the last one open."""
    own = docs.select(_rows.whole_ids(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    gone = repeated(own, least_chars, least_docs, hot, most_hot)
    by_doc = gone.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone"))  # the lines of one text
    return by_doc.select("id", "t", F.size("gone").alias("dropped"), kept_runs(F.col("gone"), F.lit(2**31 - 1)).alias("keep"))


def apply_bitmap(text: Column, keep: Column) -> Column:
    """The text without the lines outside the runs of ``keep``; unchanged where that is null."""
    lines = lines_of(text)
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["from"] + 1, r["lines"]))), "\n"))


def _met(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    marks = keep_bitmaps(docs, id_col, text_col, **limits).toDF("mark_id", "mark_t", "dropped", "keep")
    own = _rows.packed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).withColumn("t", F.xxhash64("text"))
    return own.join(marks, F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("t") == F.col("mark_t")), "left")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, keep, kept`` for each row of ``docs``; ``keep`` is null where every line stays."""
    met = _met(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col, **limits)
    n = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    kept = F.coalesce(apply_bitmap(F.col("text"), F.col("keep")), F.lit(""))
    return met.select(
        F.col("row.c0").alias(id_col), n.cast("long").alias("n_lines"), F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep", kept.alias("kept")
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` with all its rows and columns, the repeated lines cut out of the texts."""
    return _rows.unpacked(_met(docs, id_col, text_col, **limits), docs, **{text_col: apply_bitmap(F.col("text"), F.col("keep"))})
