"""Rows of a caller's table carried through an operator whole, under names that can't meet the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType


def packed(docs: DataFrame, **roles: str) -> DataFrame:
    """One column for each role (``name=column of docs``), and ``row``: all columns as one struct, its fields named by position."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = [F.col(f"c{docs.columns.index(column)}").alias(name) for name, column in roles.items()]
    return plain.select(*own, F.struct(*plain.columns).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, more: tuple[Column, ...] = (), **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``; those in ``changed`` get the value given, ``more`` follow behind."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)], *more)


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The id as ``long``. Ids are ordered and compared as whole numbers, so other types are refused."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col!r} is of type {kind.simpleString()}; whole numbers are needed")
    return F.col(f"`{id_col}`").cast("long")
