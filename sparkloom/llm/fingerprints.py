"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies within a band, that
is, whose inverse document frequency does. A text's distinct terms of the lexicon
are sorted, and for each of several randomised subsets of the lexicon those that
fall into the subset are hashed: the fingerprint is the list of these hashes.
Subsets differ in size: of a long text only small ones survive an edit, of a short
text only large ones hold a term at all. The likeness of two fingerprints is
the share of equal hashes among the subsets of one size that hold a term of
either text.

The subsets of the densest level cut the whole lexicon into parts, so a text with any
term of the lexicon has a hash that isn't empty.
The lexicon's size has a proven bound: each of its terms is in at least
``low`` of all documents, so there are at most (distinct terms of a mean
document) / ``low`` terms, whatever the number of documents. It is broadcast
only if its counted size is below ``table_terms``; beyond that the same join
shuffles.

Order: "the next document" is the one with the next smaller id, and after the
last one comes the first. Documents are dealt to ranges of ids, about ``range_bytes`` of
text each, and each range is handed a copy of the first document of the range after it, so
no global sort or single task is needed. The texts are shuffled once.

Defined cases: a null text is empty; a text without terms of the lexicon has
only empty hashes, and two such texts are alike to 1 if they have the same
distinct words, and else to 0; very long texts are one row of one range, never cut; rows with
equal ids follow each other by a hash of the text, and so do rows with a null id, which come
last (so either may be cut into ranges; only rows equal in both stay together); a table of
one row is its own next document; an empty table gives an empty result; ids of other than
whole-number types are refused. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _exchange as X
from sparkloom.llm import _rows
from sparkloom.llm._graph import saved
from sparkloom.operators.ranges import bounds, range_of

#: Levels of subsets: how many, and into how many random parts the lexicon is cut for them (powers of two).
#: A subset is one of the first parts; which part a term is in depends on bits of its hash, others on each level.
#: The first level has all its parts, so every term is in a subset.
LEVELS = ((16, 16), (12, 64), (14, 256), (14, 1024))
#: So many subsets of a level that has all its parts are picked together.
GROUP = 4
#: A level tells two texts apart if so many of its subsets hold a term of either.
TELLING = 4
#: Over how many keys a term is spread where the lexicon is joined by a shuffle.
SALT = 32
#: The hash of an array without elements (its seed).
_EMPTY = 42


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words of a text, sorted."""
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, low: float, high: float, text_col: str = "text") -> DataFrame:
    """``term``: the hash of each term that is in at least ``low`` and at most ``high`` of all texts, and in two or more."""
    n = docs.count()
    least, most = max(2, low * n), max(2, high * n)
    words = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(least, most)).select("term")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """``key, id, text`` by ``part``, a range of keys, and, as ``guest``, a copy of the first document of the next range.

    Keys ascend where ids descend. The driver gets a sample of keys, and the first key of each range.
    """
    spark = docs.sparkSession
    text, id_ = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _rows.whole_ids(docs, id_col)
    key = F.struct(id_.isNull().alias("k0"), F.bitwise_not(id_).alias("k1"), F.xxhash64(text).alias("k2"))
    own = docs.select(id_.alias("id"), text.alias("text"), key.alias("key"))
    ranges = ranges or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-X.text_bytes(docs, text_col) // range_bytes))
    dealt = own.withColumn("part", range_of(F.col("key"), bounds(own.select("key.*"), ranges))).withColumn("guest", F.lit(0))
    firsts = {r["part"]: r["key"] for r in dealt.groupBy("part").agg(F.min("key").alias("key")).collect()}
    here = sorted(firsts)
    if not here:
        return dealt
    # at most one guest for each range, though its key may be that of several equal rows
    hosts = [(*firsts[q], q, p) for p, q in zip(here, [*here[1:], here[0]], strict=True)]
    hosts = spark.createDataFrame(hosts, "k0 boolean, k1 long, k2 long, part int, host int").select(F.struct("k0", "k1", "k2").alias("key"), "part", "host")
    guests = dealt.join(F.broadcast(hosts), ["part", "key"]).groupBy("host").agg(F.first("key").alias("key"), F.first("id").alias("id"), F.first("text").alias("text"))
    return dealt.unionByName(guests.select("id", "text", "key", F.col("host").alias("part"), F.lit(1).alias("guest")))


def edited(text: Column, following: Column) -> Column:
    """The last third of a text's code points replaced by the first as many of another text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def _part_of(shift: int, parts: int):
    return lambda t: F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(parts - 1))


def _hashed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """For each array of sorted term hashes, the array of the hashes of its lexicon subsets, under a new name.

    The terms of a group of subsets are a column of their own, so they are picked once and not once a subset.
    """
    shift, picked, cells = 0, {}, {c: [] for c in columns}
    for i, (many, parts) in enumerate(LEVELS):
        part = _part_of(shift, parts)
        shift += parts.bit_length() - 1
        wide = many if many < parts else GROUP
        for first in range(0, many, wide):
            for c in columns:
                name = f"{c}_{i}_{first}"
                picked[name] = _filtered(c, part, first, first + wide)
                cells[c].append(_each(name, part, first, wide))
    return rows.withColumns(picked).withColumns({new: F.concat(*cells[c]) for c, new in columns.items()})


def _filtered(column: str, part, first: int, end: int) -> Column:
    return F.filter(column, lambda t: (part(t) >= first) & (part(t) < end) if first else part(t) < end)


def _each(column: str, part, first: int, many: int) -> Column:
    """The hashes of ``many`` subsets. (The column is named twice, so Catalyst keeps it and doesn't pick its terms for each subset.)"""
    hashes = F.transform(F.sequence(F.lit(first), F.lit(first + many - 1)), lambda k: F.xxhash64(F.filter(column, lambda t: part(t) == k)))
    return F.when(F.size(column) == 0, F.array_repeat(F.lit(_EMPTY).cast("long"), many)).otherwise(hashes)


def _digits(hashes: Column) -> Column:
    """Eight hex digits a subset; ``-`` if it is empty."""
    return F.array_join(F.transform(hashes, lambda h: F.when(h == _EMPTY, "-").otherwise(F.lpad(F.hex(h.bitwiseAND(0xFFFFFFFF)), 8, "0"))), ".")


def likeness(a: Column, b: Column, same_words: Column) -> Column:
    """The share of equal hashes among the subsets of which either text has a term, on one level.

    Without any such subset it is told by ``same_words``: whether both texts have the same distinct words.

    That is the sparsest level with ``TELLING`` such subsets, or else the densest: where a subset
    holds many terms of a text, any edit changes its hash.
    """
    at, levels = 1, []
    for many, _ in LEVELS:
        pairs = F.arrays_zip(F.slice(a, at, many).alias("x"), F.slice(b, at, many).alias("y"))
        told = F.size(F.filter(pairs, lambda p: (p["x"] != _EMPTY) | (p["y"] != _EMPTY)))
        same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != _EMPTY)))
        levels.append((told, same))
        at += many
    told, same = levels[0]
    out = F.when(told == 0, same_words.cast("double")).when(a == b, 1.0).otherwise(same / told)
    for told, same in levels[1:]:
        out = F.when((told >= TELLING) & (a != b), same / told).otherwise(out)
    return out.cast("double")


def _by_table(rows: DataFrame, words: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Keep the lexicon's terms of array columns of sorted terms: each term is looked up in its bin of one table.

    The table is two constant arrays, the terms by bin and where each bin starts, so no row is exploded.
    """
    bins = 1 << max(size, 1).bit_length()
    place = lambda t: F.shiftrightunsigned(t, 32).bitwiseAND(F.lit(bins - 1)).cast("int")
    listed = sorted((r["bin"], r["term"]) for r in words.select(place(F.col("term")).alias("bin"), "term").collect())
    starts = [0] * (bins + 1)
    for b, _ in listed:
        starts[b + 1] += 1
    for b in range(bins):
        starts[b + 1] += starts[b]
    constant = lambda x, kind: F.split(F.lit(",".join(map(str, x)) or "0"), ",").cast(f"array<{kind}>")
    table = F.struct(constant([t for _, t in listed], "bigint").alias("every"), constant(starts, "int").alias("start"))

    def known(table: Column, t: Column) -> Column:
        every, start, at = table["every"], table["start"], place(t)
        first, end = F.get(start, at), F.get(start, at + 1)
        # most bins are empty or hold one term
        one = F.get(every, first) == t
        return F.when(end == first, False).when(one, True).when(end == first + 1, False).otherwise(F.array_contains(F.slice(every, first + 1, end - first), t))

    # the table stands in the plan once, bound by a lambda, for a plan that names it at every use takes the driver's memory
    kept = F.transform(F.array(table), lambda x: F.struct(*[F.filter(c, lambda t: known(x, t)).alias(c) for c in columns]))
    found = rows.withColumn("kept", F.get(kept, F.lit(0)))
    return found.withColumns({c: F.col("kept").getField(c) for c in columns}).drop("kept")


def _by_join(rows: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a lexicon too large for one table: terms are exploded and joined by a shuffle.

    A term stands in up to ``high`` of all texts, so both sides are salted: a term is spread over ``SALT`` keys.
    """
    words = words.select("term", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("known"))
    tagged = F.flatten(F.array(*[_tagged(c, i) for i, c in enumerate(columns)]))
    exploded = rows.select(*[k for k in rows.columns if k not in columns], F.explode_outer(tagged).alias("x"))
    rest = [c for c in exploded.columns if c != "x"]
    salt = F.pmod(F.xxhash64("part", "number"), F.lit(SALT)).cast("int").alias("salt")
    known = exploded.select(*rest, "x.term", "x.of", salt).join(words, ["term", "salt"], "left")
    picks = [F.sort_array(F.collect_list(F.when(F.col("known") & (F.col("of") == i), F.col("term")))).alias(c) for i, c in enumerate(columns)]
    return known.groupBy(*rest).agg(*picks)


def _tagged(column: str, number: int) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(number).alias("of")))


def fingerprints(
    docs: DataFrame, low: float = 0.001, high: float = 0.2, id_col: str = "doc_id", text_col: str = "text", table_terms: int = 200_000
) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    words = saved(lexicon(docs, low, high, text_col))
    size = words.count()
    order = Window.partitionBy("part").orderBy(F.asc("guest"), F.asc("key"), F.asc("text"))
    rows = with_next(docs, id_col, text_col)
    following = F.coalesce(F.lead("text").over(order), F.col("text"))
    # the row number tells rows with equal ids apart
    rows = rows.withColumn("next", following).withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next")))
    own, other = (terms(F.col(c)).alias(name) for c, name in (("text", "own"), ("edited", "other")))
    keys = ["part", "guest", "id", "number"]
    kept = [*keys, "n_chars", "edited_sha256"]
    base = rows.select(*keys, F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), own, other)
    # one hash of all words of each text, of the lexicon or not
    base = base.select(*kept, F.xxhash64("own").alias("a_words"), F.xxhash64("other").alias("b_words"), "own", "other")
    packed = _by_table(base, words, size, ["own", "other"]) if size <= table_terms else _by_join(base, words, ["own", "other"])
    hashed = _hashed(packed, {"own": "a", "other": "b"}).select(*kept, "a_words", "b_words", "a", "b")
    order = Window.partitionBy("part").orderBy("number")
    ahead = {new: F.coalesce(F.lead(c).over(order), F.col(c)) for c, new in (("a", "next"), ("a_words", "next_words"))}
    hashed = hashed.withColumns(ahead).filter("guest = 0")
    return hashed.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", _digits(F.col("a")).alias("fingerprint"), _digits(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("a_words") == F.col("b_words")).alias("near_edited"),
        likeness(F.col("a"), F.col("next"), F.col("a_words") == F.col("next_words")).alias("near_next"),
    )
