"""Divergence of the sources of each language, term by term and summed over the vocabulary.

Every group (language and source) and every language gives each term of the language's vocabulary
a probability in billionths, smoothed by one: p = 1 + floor(10^9 (count + 1) / (N + V)). How far a group's p
is from another's q is f = floor((p - q)^2 / q), summed over all V terms for each ordered pair of sources.

Most terms are in few sources, so the sum isn't taken over V terms for each pair. It starts from the
baseline V f(p0, q0), as if no term stood in either source, and an inverted index of postings (term, source, count)
corrects it:

* a term of the one source alone changes f to f(p, q0) or f(p0, q): that depends on its count only, so
  each source sends how many of its terms have each count, not the terms;
* a term of both sources adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0): the postings of a term meet
  those of the same term, and corrections of 0 aren't sent.

Terms are counted in Python, slice by slice of some MB of text, over Arrow buffers; all else is joins and sums.
A text's terms never leave their slice: a row for each term, source and slice does. Counts are summed up before they are shuffled by term and source, so neither a
frequent term nor a large source is one task's work; a term's postings are at most as many as there are sources. The
200 terms of a group that stand out most are ranked by a window with a limit, which each task applies to its own rows first.

All arithmetic is in whole numbers (decimals of 38 digits where counts are multiplied). Probabilities are at most 10^9 + 1, and sums of f for a pair below 5 * 10^18.

Defined cases: null text, language and source are read as ''. A source without terms is a group like others, with N = 0.
A language without a vocabulary gives 0 for every pair. Repeated rows are documents of their own; ids aren't read. Other columns aren't either. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _text
from sparkloom.llm._graph import saved, written

SCALE = 10**9
#: A-Z lower-cased; letters and what is beyond ASCII stay, all else becomes a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def counted(batches: Iterator[pa.RecordBatch], slice_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """How often each term stands in each group of a slice, and in how many documents. A group's own row has no term.

    A slice takes some 15 times its text in memory, and is gone before the next one is counted.
    """
    for table in _text.text_slices(batches, "text", slice_bytes):
        yield from _counted(table).to_batches(64_000)


def _counted(table: pa.Table) -> pa.Table:
    lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    groups, group_of = np.unique(pair, return_inverse=True)
    flat, offsets = _text.words(table["text"], _TERM)
    coded = flat.dictionary_encode()
    del flat
    word, terms = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(table.num_rows), np.diff(offsets))
    at, n = np.unique(group_of[row] * terms + word, return_counts=True)
    once = np.unique(row * terms + word)  # each term once in each document
    docs = np.unique(group_of[once // terms] * terms + once % terms, return_counts=True)[1]
    own = np.concatenate([np.arange(len(groups)), at // terms])
    zero = np.zeros(len(groups), np.int64)
    return pa.table({
        "lang": lang.dictionary.take(pa.array(groups[own] // len(source.dictionary))),
        "source": source.dictionary.take(pa.array(groups[own] % len(source.dictionary))),
        "term": pa.concat_arrays([pa.nulls(len(groups), pa.string()), coded.dictionary.take(pa.array(at % terms)).cast(pa.string())]),
        "n": pa.array(np.concatenate([zero, n])), "docs": pa.array(np.concatenate([zero, docs])),
    })


def postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n, lang_n, lead`` for the terms that each language keeps, and one row with a null term for each group.

    ``lang_n`` counts the term in its language; ``lead`` is 1 in one posting of each term.
    """
    summed = docs.mapInArrow(counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = summed.withColumns({
        "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "lead": (F.min("source").over(of_term) == F.col("source")).cast("long"),
    })
    return whole.filter((F.col("lang_docs") >= least_docs) | F.col("term").isNull()).drop("docs", "lang_docs")


def chance(n: Column | int, total: str, size: str) -> Column:
    """A probability in billionths, smoothed by one, from a count, all counts and the size of the vocabulary."""
    more = (F.lit(n) if isinstance(n, int) else n).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * more).alias("scaled")
    return F.when(F.col(size) > 0, F.lit(1) + F.call_function("div", scaled, (F.col(total) + F.col(size)).cast("decimal(19,0)"))).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(found: DataFrame) -> DataFrame:
    """For each group ``lang, source, total, lang_total, size``, and ``p0``, the probability of a term that isn't there."""
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term").isNotNull(), F.col("lead")).otherwise(0)).alias("led"))
    whole = Window.partitionBy("lang")
    sized = own.select("lang", "source", "total", F.sum("total").over(whole).alias("lang_total"), F.sum("led").over(whole).alias("size"))
    return sized.withColumn("p0", chance(0, "total", "size"))


def _with_others(rows: DataFrame, groups: DataFrame, small: bool, salts: int = 32) -> DataFrame:
    """Each row of a source with each other source of its language, as ``other, other_p0``.

    Where the groups aren't few enough to be sent everywhere, rows are dealt by language and salt, for a language may have most of them.
    """
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    if small:
        met = rows.join(F.broadcast(others), "lang")
    else:
        salted = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
    return met.filter("source <> other")


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, most_terms: int = 200, few_groups: int = 20_000,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources of each group by divergence, and the terms that stand out in it."""
    none = F.lit("")
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), none).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    found = written(postings(own, least_docs))
    groups = saved(group_sizes(found))
    small = groups.count() <= few_groups
    known = found.filter("term IS NOT NULL").join(F.broadcast(groups) if small else groups, ["lang", "source"])
    known = known.withColumns({"p": chance(F.col("n"), "total", "size"), "q": chance(F.col("lang_n"), "lang_total", "size")})
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("other_p0")

    base = _with_others(groups.select("lang", "source", "p0", "size"), groups, small)
    base = base.select("lang", "source", "other", F.when(F.col("size") > 0, F.col("size") * apart(p0, q0)).otherwise(0).alias("value"))
    # terms of the one source alone: by count, not by term
    alike = known.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = _with_others(alike, groups, small)
    forth = alone.select("lang", "source", "other", (F.col("terms") * (apart(p, q0) - apart(p0, q0))).alias("value"))
    back = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), (F.col("terms") * (apart(q0, p) - apart(q0, p0))).alias("value"))
    # terms of both: the postings of a term meet
    first = known.select("lang", "term", "source", "p", "p0")
    second = first.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("p0").alias("other_p0"))
    op = F.col("other_p")
    met = first.join(second, ["lang", "term"]).filter("source < other").select(
        "lang", "source", "other",
        (apart(p, op) - apart(p, q0) - apart(p0, op) + apart(p0, q0)).alias("there"), (apart(op, p) - apart(op, p0) - apart(q0, p) + apart(q0, p0)).alias("back"),
    ).filter("there <> 0 OR back <> 0").groupBy("lang", "source", "other").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    both = met.select("lang", "source", "other", F.col("there").alias("value")).unionByName(met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))
    summed = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    over = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(p, F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(over).filter(F.col("rank") <= most_terms))
