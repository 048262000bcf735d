"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source s holds t_s tokens. Its weight is t_s^a, normalised; a = 1 is the
natural mix, a = 0 the uniform one. The exponent is found by bisection, as the
smallest a in [0, 1] (the flattest mix) for which no source is repeated more
than ``max_repeats`` times, and, if ``max_entropy`` is given, the mix's entropy
is no more than that share of the uniform one's. Sources with no tokens have weight 0.

The budget is a number of tokens, or, if none is given, the least with which
every source is used whole once ("cover"). A source's quota is its weight times the
budget. It is realised in epochs: each epoch is a permutation of the source's
blocks and of the rows inside them, by a hash of epoch, seed and row, and rows are
taken in that order as long as they fit into the quota whole. All epochs but
the last take every row, so only the last one needs a cut. The cut is found by
refining block sums: the first digits of the hash give the block where the
quota ends, the next digits the part of that block, and so on, until the part
is small enough for a running sum. So no source, however large, is sorted or
summed in one task.

Only per-source and per-digit sums reach the driver: at most ``most_sources`` sources
(checked) times the digits. What is worked out for each source goes back as a small
table, one row a source, that is joined to the rows.

Defined cases: a null source is a source of its own; null and empty texts have 0
tokens and come with every epoch that is taken whole, and with the last one if it
is cut after them; rows are told apart by their id, so rows that repeat an id are
taken together, and rows without an id are told apart by text and source; very long texts count all their words; an empty table gives an empty mix. The input's columns are
returned as they are, with ``mix_epoch``, ``mix_block``, ``mix_key``,
``mix_tokens`` and ``mix_weight`` behind them (in place of columns of these names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _rows
from sparkloom.llm._graph import saved

ADDED = ("mix_epoch", "mix_block", "mix_key", "mix_tokens", "mix_weight")
#: Hex digits of the key that name a block.
BLOCK_DIGITS = 2
_STEP = 2


def tokens(text: Column) -> Column:
    """The words of a text: runs of other characters than space and the controls U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weights(sizes: dict, exponent: float) -> dict:
    powers = {s: float(n) ** exponent if n > 0 else 0.0 for s, n in sizes.items()}
    total = math.fsum(powers.values()) or 1.0
    return {s: p / total for s, p in powers.items()}


def entropy(shares: dict) -> float:
    return -math.fsum(p * math.log(p) for p in shares.values() if p > 0)


def cover(sizes: dict, shares: dict) -> float:
    """The least budget with which every source is used whole once."""
    return max((n / shares[s] for s, n in sizes.items() if n > 0), default=0.0)


def solve(sizes: dict, budget: float | None, max_repeats: float | None, max_entropy: float | None, rounds: int = 60) -> tuple[float, dict, float]:
    """The exponent, the weights and the budget."""
    some = sum(n > 0 for n in sizes.values())

    def fits(exponent: float) -> bool:
        shares = weights(sizes, exponent)
        total = cover(sizes, shares) if budget is None else budget
        if max_repeats is not None and any(shares[s] * total > max_repeats * n * (1 + 1e-12) for s, n in sizes.items() if n > 0):
            return False
        return max_entropy is None or some < 2 or entropy(shares) <= max_entropy * math.log(some)

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    else:
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    shares = weights(sizes, high)
    return high, shares, cover(sizes, shares) if budget is None else budget


def _key(epoch: Column, id_column: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), id_column).cast("binary"))


def _table(rows: DataFrame, values: dict, names: str) -> DataFrame:
    """``s`` and the values of each source. One row a source, and their number was checked, so every executor can have it."""
    kind = rows.schema["s"].dataType.simpleString()
    return F.broadcast(rows.sparkSession.createDataFrame([(s, *v) for s, v in values.items()], f"s {kind}, {names}"))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of the table's sources with their values; a null source is one like others."""
    return rows.join(table.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")


def _cuts(rows: DataFrame, left: dict, small: int) -> dict:
    """For each source with a rest, ``(taken prefix, tokens before it)``: keys below the prefix are taken whole.

    Goes two hex digits deeper each time, into the one part where the rest ends, until that part
    has ``small`` rows or fewer (or the digits end). Each step is one aggregation over the part's rows.
    """
    prefix = {s: "" for s in left}
    before = dict.fromkeys(left, 0)
    open_ = set(left)
    depth = 0
    while open_ and depth < 16:
        depth += _STEP
        inside = _with(rows, _table(rows, {s: (prefix[s],) for s in open_}, "prefix string")).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("s", F.substring("key", 1, depth).alias("digits")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        by: dict = {}
        for r in sums:
            by.setdefault(r["s"], []).append((r["digits"], r["n"], r["rows"]))
        for s in list(open_):
            for digits, n, count in sorted(by.get(s, [])):
                if before[s] + n > left[s]:
                    prefix[s] = digits
                    if count <= small:
                        open_.discard(s)
                    break
                before[s] += n
            else:  # the rest takes all that is there
                prefix[s] = "g"
                open_.discard(s)
    return {s: (prefix[s], before[s]) for s in left}


def mix(
    docs: DataFrame, max_repeats: float | None = 4.0, max_entropy: float | None = None, budget: int | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most_sources: int = 10_000, small: int = 2_000,
) -> DataFrame:
    """One row for each time a row of ``docs`` is drawn."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    measured = _rows.packed(own, id=id_col, s=source_col, text=text_col).withColumn("n", tokens(F.col("text")))
    unnamed = F.concat(F.lit("?"), F.hex(F.xxhash64("text", "s")))
    measured = measured.withColumn("id", F.coalesce(F.col("id").cast("string"), unnamed)).drop("text")
    light = saved(measured.select("s", "id", "n"))
    totals = light.groupBy("s").agg(F.sum("n").alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = {r["s"]: r["n"] for r in totals}
    _, shares, whole = solve(sizes, budget, max_repeats, max_entropy)
    quota = {s: int(math.floor(shares[s] * whole + 1e-6)) for s in sizes}
    full = {s: quota[s] // n if n else int(budget is None) for s, n in sizes.items()}
    rest = {s: quota[s] - full[s] * n for s, n in sizes.items() if n}
    rest = {s: n for s, n in rest.items() if n > 0}
    keyed = lambda df: df.withColumn("key", _key(F.col("epoch"), F.col("id"), seed))
    cuts = _cuts(keyed(_with(light, _table(light, {s: (full[s],) for s in rest}, "epoch int"))), rest, small)
    values = {s: (shares[s], full[s], *((cuts[s][0], rest[s] - cuts[s][1]) if s in cuts else ("", 0))) for s in sizes}
    known = _with(measured, _table(measured, values, "weight double, full int, prefix string, left long"))
    whole_epochs = keyed(known.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))))
    last = keyed(known.filter("prefix <> ''").withColumn("epoch", F.col("full")))
    order = Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    edge = last.filter(F.col("key").startswith(F.col("prefix"))).withColumn("upto", F.sum("n").over(order)).filter("upto <= left").drop("upto")
    taken = whole_epochs.unionByName(last.filter("key < prefix")).unionByName(edge)
    added = (F.col("epoch"), F.substring("key", 1, BLOCK_DIGITS), F.col("key"), F.col("n"), F.col("weight"))
    return _rows.unpacked(taken, own, tuple(c.alias(name) for c, name in zip(added, ADDED, strict=True)))
