"""What N jobs that take a shard each need to know of a table, counted once: rows by file, or by range of a column."""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranges import bounds, range_of

#: Up to so many rows of an index are sent to every task; more are joined by a shuffle.
_FEW = 100_000


def _starts(counts: list[int]) -> list[int]:
    return [0, *accumulate(counts)]


@dataclass(frozen=True)
class FileIndex:
    """The files of a Parquet folder in the order of their numbers, with their rows. A row's position is its file's start and its place in the file."""

    path: str
    files: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, spark: SparkSession, path: str, names: list[str]) -> FileIndex:
        counted = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()  # of footers only
        rows = {r["f"]: r["n"] for r in counted}
        return cls(path, tuple((n, rows.get(n, 0)) for n in names))

    @property
    def total(self) -> int:
        return sum(n for _, n in self.files)

    def to_json(self) -> str:
        return json.dumps({"path": self.path, "files": self.files})

    @classmethod
    def from_json(cls, text: str) -> FileIndex:
        raw = json.loads(text)
        return cls(raw["path"], tuple((n, rows) for n, rows in raw["files"]))

    def overlapping(self, first: int, end: int) -> list[tuple[str, int]]:
        """The files with rows at these positions, and where each starts."""
        starts = _starts([n for _, n in self.files])
        return [(name, at) for (name, n), at in zip(self.files, starts, strict=False) if n and at < end and at + n > first]

    def numbered(self, df: DataFrame, position: str, first: int = 0, end: int | None = None) -> DataFrame:
        """Rows from ``first`` to before ``end`` with their positions. ``df`` is the folder, read whole; only the files that overlap are read."""
        spark, end = df.sparkSession, self.total if end is None else end
        wanted = self.overlapping(first, end)
        if not wanted:
            return df.limit(0).withColumn(position, F.lit(0).cast("long"))
        table = spark.createDataFrame(wanted, "__file string, __start long")
        rows = spark.read.schema(df.schema).parquet(*[f"{self.path}/{n}" for n, _ in wanted])
        rows = rows.select(F.struct("*").alias("row"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        met = rows.join(F.broadcast(table) if len(wanted) <= _FEW else table, rows["file"] == table["__file"])
        placed = met.select("row.*", (F.col("__start") + F.col("at")).alias(position))
        return placed.filter((F.col(position) >= first) & (F.col(position) < end))


def tie(df: DataFrame) -> Column:
    """A hash of the whole row: rows that share one are equal, and so may change places."""
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    other = [f.name for f in df.schema.fields if f.name not in plain]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain], *[F.to_json(F.struct(F.col(f"`{c}`"))) for c in other])


@dataclass(frozen=True)
class KeyIndex:
    """Ranges of a column, ties cut by a hash of the row, and the rows of each: the same positions in every job, however rows are dealt.

    ``cuts`` are the keys, as texts, that ranges begin with, but for the first.
    """

    order: str
    kind: str
    cuts: tuple[tuple[str | None, int], ...]
    counts: tuple[int, ...]

    @classmethod
    def of(cls, df: DataFrame, order: str, each: int = 50_000, most: int = 10_000) -> KeyIndex:
        """Ranges of some ``each`` rows, and no fewer than shuffle partitions; at most ``most``, so the driver's sample is bounded."""
        keyed = df.select(F.col(f"`{order}`").alias("v"), tie(df).alias("h"))
        n = keyed.count()
        ranges = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // each), most)
        cuts = bounds(keyed, ranges, each=20, n=n)
        counted = keyed.groupBy(range_of(F.struct("v", "h"), cuts).alias("p")).count().collect()
        rows = {r["p"]: r["count"] for r in counted}
        texts = keyed.sparkSession.createDataFrame(cuts, keyed.schema).select(F.col("v").cast("string"), "h").collect() if cuts else []
        return cls(order, df.schema[order].dataType.simpleString(), tuple((r[0], r[1]) for r in texts), tuple(rows.get(p, 0) for p in range(len(cuts) + 1)))

    @property
    def total(self) -> int:
        return sum(self.counts)

    def to_json(self) -> str:
        return json.dumps({"order": self.order, "kind": self.kind, "cuts": self.cuts, "counts": self.counts})

    @classmethod
    def from_json(cls, text: str) -> KeyIndex:
        raw = json.loads(text)
        return cls(raw["order"], raw["kind"], tuple((v, h) for v, h in raw["cuts"]), tuple(raw["counts"]))

    def overlapping(self, first: int, end: int) -> tuple[int, int]:
        """The ranges, the last excluded, that hold these positions."""
        starts = _starts(list(self.counts))
        low = min(bisect_right(starts, first) - 1, len(self.counts) - 1)
        return low, max(low, bisect_right(starts, max(end - 1, first)))

    def numbered(self, df: DataFrame, position: str, first: int, end: int) -> DataFrame:
        """Rows from ``first`` to before ``end`` with their positions. Only the ranges that overlap are shuffled and sorted."""
        low, high = self.overlapping(first, end)
        high = min(high, len(self.counts))
        value = F.col(f"`{self.order}`")
        cut = lambda i: (F.lit(self.cuts[i][0]).cast(self.kind), F.lit(self.cuts[i][1]))
        key = lambda v, h: F.struct(v.alias("v"), h.alias("h"))
        if low > 0 and self.cuts[low - 1][0] is not None:  # plain comparisons, which reach the scan
            df = df.filter(value >= cut(low - 1)[0])
        if high <= len(self.cuts):
            df = df.filter(value.isNull() | (value <= cut(high - 1)[0])) if self.cuts[high - 1][0] is not None else df.filter(value.isNull())
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key(value, tie(df)).alias("key"))
        if low > 0:
            packed = packed.filter(F.col("key") >= key(*cut(low - 1)))
        if high <= len(self.cuts):
            packed = packed.filter(F.col("key") < key(*cut(high - 1)))
        inside = [Row(v=self.cuts[i][0], h=self.cuts[i][1]) for i in range(low, high - 1)]
        starts = _starts(list(self.counts))
        part = (range_of(F.col("key"), inside, self.kind) if inside else F.lit(0)) + low
        placed = packed.withColumn("part", part)
        if high - low > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            placed = placed.repartition(high - low, "part")  # as many tasks as ranges, so none grows with the table
        place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
        start = F.get(F.lit(starts[low:high] or [0]).cast("array<bigint>"), F.col("part") - low)
        numbered = placed.withColumn("position", start + place)
        wanted = numbered.filter((F.col("position") >= first) & (F.col("position") < end))
        return wanted.select("row.*", F.col("position").alias(position))
