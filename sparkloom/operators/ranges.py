"""Cutting a table into ranges of a key, by bounds that are constants of the plan.

Unlike a range exchange, which samples anew in each job, the same row falls into the same range in every job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def bounds(keys: DataFrame, ranges: int, each: int = 40, n: int | None = None) -> list[Row]:
    """Up to ``ranges`` - 1 keys that cut a sample of some ``each`` keys a range into equal parts.

    ``keys`` has the parts of the key as columns, the first one first, and ``n`` rows. The driver gets the sample only.
    """
    n = keys.count() if n is None else n
    if not n or ranges < 2:
        return []
    sample = keys.sample(min(1.0, each * ranges / n), seed=5).orderBy(*keys.columns).collect()
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []


def range_of(key: Column, cuts: list[Row], kind: str | None = None) -> Column:
    """How many bounds are not above the key, a struct of the same parts: first by group of bounds, then inside the group.

    ``kind``: the type of the first part, if the bounds have its texts.
    """
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    lit = lambda v, first: F.lit(v).cast(kind) if kind and first else F.lit(v)
    made = lambda b: F.struct(*[lit(v, i == 0).alias(n) for i, (n, v) in enumerate(b.asDict().items())])
    heads, inside = F.array(*[made(g[0]) for g in groups]), F.array(*[F.array(*[made(b) for b in g]) for g in groups])
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    group = below(heads)
    return F.when(group == 0, 0).otherwise((group - 1) * wide + below(F.get(inside, group - 1))).cast("int")
