"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.checkpoints import saved, shared_folder

__all__ = ["components", "saved", "shared_folder", "written"]


def written(df: DataFrame) -> DataFrame:
    """As :func:`saved`, in columns (Parquet): smaller where values repeat, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``, any direction); the root is the smallest node.

    Each round shuffles the edges; rounds grow with the logarithm of the longest path.
    """
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = saved(_small(_large(now)))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
