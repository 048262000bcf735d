"""Positional shards: assignment, writing with a manifest, and merging."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.checkpoints import saved
from sparkloom.operators.shard_index import FileIndex, KeyIndex
from sparkloom.sources import Dataset, arrow_dir
from sparkloom.sources.loaders import ArrowDirConfig
from sparkloom.sources.loaders import saved as saved_dataset

POSITION, SHARD = "__position", "__shard"
MANIFEST = "_shards.json"
#: Rows of a file that one task writes.
FILE_ROWS = 20_000


def check_range(num_shards: int, shard_id: int) -> None:
    if num_shards < 1:
        raise ValueError(f"num_shards must be at least 1, not {num_shards}")
    if not 0 <= shard_id < num_shards:
        raise ValueError(f"shard_id must be from 0 to {num_shards - 1}, not {shard_id}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with more underscores in front if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _starts(counts: dict[int, int]) -> tuple[list[int], int]:
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    return starts or [0], total


def _by_scan(df: DataFrame, position: str) -> tuple[DataFrame, int]:
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = saved(df)  # a shuffle may deal its rows otherwise when it runs again, or runs for fewer columns
    # the id holds the partition in its high bits and the row's place in it in the low 33
    number = free_name(df, "__number")
    marked = df.withColumn(number, F.monotonically_increasing_id())
    part, place = F.shiftright(number, 33).cast("int"), F.col(number).bitwiseAND((1 << 33) - 1)
    starts, total = _starts(dict(marked.groupBy(part.alias("p")).count().collect()))
    return marked.withColumn(position, F.get(F.lit(starts).cast("array<bigint>"), part) + place).drop(number), total


def _numbered(df: DataFrame, order: str | None, position: str, index: FileIndex | KeyIndex | None = None) -> tuple[DataFrame, int]:
    """Rows with their position, in the order of the scan or of a column, and how many there are.

    Counts by partition or range are all that reaches the driver; no row goes through one task.
    """
    if order or index:
        index = index or KeyIndex.of(df, order)
        return index.numbered(df, position, 0, index.total), index.total
    return _by_scan(df, position)


def with_shard(
    df: DataFrame, num_shards: int, layout: str = "contiguous", order: str | None = None, position_col: str = POSITION, shard_col: str = SHARD,
    index: FileIndex | KeyIndex | None = None,
) -> DataFrame:
    """Adds the row's position and shard. Contiguous shards differ by one row at most, larger ones first."""
    check_range(num_shards, 0)
    if clash := {position_col, shard_col} & set(df.columns):
        raise ValueError(f"the table has columns {sorted(clash)}; name others")
    numbered, n = _numbered(df, order, position_col, index)
    pos = F.col(position_col)
    if layout == "strided":
        return numbered.withColumn(shard_col, F.pmod(pos, F.lit(num_shards)).cast("int"))
    if layout != "contiguous":
        raise ValueError(f"unknown layout {layout!r}")
    each, more = divmod(n, num_shards)
    head = (each + 1) * more  # rows in the larger shards
    shard = F.when(pos < head, F.floor(pos / (each + 1))).otherwise(F.floor((pos - head) / max(each, 1)) + more)
    return numbered.withColumn(shard_col, shard.cast("int"))


def span(total: int, num_shards: int, shard_id: int) -> tuple[int, int]:
    """The positions of a contiguous shard, the end excluded."""
    each, more = divmod(total, num_shards)
    start = each * shard_id + min(shard_id, more)
    return start, start + each + (shard_id < more)


def shard(
    df: DataFrame, num_shards: int, shard_id: int, layout: str = "contiguous", order: str | None = None, index: FileIndex | KeyIndex | None = None
) -> DataFrame:
    """One shard's rows. With an index nothing is counted, and a contiguous shard reads only the files or ranges that it overlaps."""
    check_range(num_shards, shard_id)
    if num_shards == 1:
        return df
    if index is not None and layout == "contiguous":
        position = free_name(df, POSITION)
        return index.numbered(df, position, *span(index.total, num_shards, shard_id)).drop(position)
    position, number = free_name(df, POSITION), free_name(df, SHARD)
    return with_shard(df, num_shards, layout, order, position, number, index).filter(F.col(number) == shard_id).drop(position, number)


def pieces(rows: int, least: int = 1) -> int:
    """How many files a table of so many rows is written to: at least so many, and more as it grows, so none grows along."""
    return max(least, -(-rows // FILE_ROWS))


def each_split(data: Dataset, f: Callable[[DataFrame], DataFrame]) -> Dataset:
    return {k: f(t) for k, t in data.items()} if isinstance(data, dict) else f(data)


class _Files:
    """The Hadoop file system of a path: whatever Spark can write, this can list."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.base = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *names: str):
        out = self.base
        for n in names:
            out = self.jvm.org.apache.hadoop.fs.Path(out, n)
        return out

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.path(*names))

    def folders(self, *names: str) -> list[str]:
        if not self.exists(*names):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(*names)) if s.isDirectory())

    def read(self, *names: str) -> str:
        stream = self.fs.open(self.path(*names))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def files(self, *names: str) -> list[str]:
        """Data files of a folder by the number in their names: the order in which they were written."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(*names)) if s.isFile()]
        number = lambda n: int(m[1]) if (m := re.search(r"(\d+)", n)) else -1
        return sorted((n for n in found if not n.startswith(("_", "."))), key=lambda n: (number(n), n))

    def claim(self, text: str, *names: str) -> bool:
        """Writes a file if there is none yet, in one step: of several writers at a time one succeeds."""
        self.fs.mkdirs(self.base)
        made, target = self.path(f"_{uuid.uuid4().hex}.tmp"), self.path(*names)
        self.write(text, made.getName())
        try:
            if self.fs.getUri().getScheme() != "file":
                return not self.fs.exists(target) and self.fs.rename(made, target)
            disk = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(disk(self.fs.makeQualified(target)), disk(self.fs.makeQualified(made)))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(made, False)

    def put(self, made: str, name: str) -> None:
        """A finished folder under its name, in place of what is there. Whoever reads sees one or the other whole; of several writers the last stays."""
        for _ in range(20):
            if self.exists(name):
                old = f"_old-{uuid.uuid4().hex}"
                if self.fs.rename(self.path(name), self.path(old)):
                    self.fs.delete(self.path(old), True)
                continue
            if self.fs.rename(self.path(made), self.path(name)) and not self.exists(name, made):
                return
            if self.exists(name, made):  # another was faster, and the folder went into its own
                self.fs.rename(self.path(name, made), self.path(made))
        raise RuntimeError(f"{self.path(name)} is being written by others")

    def write(self, text: str, *names: str) -> None:
        stream = self.fs.create(self.path(*names), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def _write(data: Dataset, target: str, kind: str) -> None:
    """As ``parquet``, or as a saved dataset that ``loadable`` reads; splits are folders in the target."""
    if kind not in ("parquet", "loadable"):
        raise ValueError(f"unknown output format {kind!r}")
    if kind == "loadable":
        arrow_dir.write_splits(data, target) if isinstance(data, dict) else arrow_dir.write(data, target)
        return
    for path, table in {f"{target}/{n}": t for n, t in data.items()}.items() if isinstance(data, dict) else [(target, data)]:
        table.write.mode("overwrite").parquet(path)


def write_shard(spark: SparkSession, data: Dataset, output_dir: str, shard_id: int, num_shards: int = 1, kind: str = "parquet") -> str:
    """Writes ``shard_<id>`` (splits as folders in it). Refuses a folder begun with another number of shards.

    The number is claimed before anything is written, so of two launches that disagree one is refused. A shard is written
    beside its place and moved there once it is whole.
    """
    check_range(num_shards, shard_id)
    files = _Files(spark, output_dir)
    if not files.claim(json.dumps({"num_shards": num_shards}), MANIFEST) and (there := json.loads(files.read(MANIFEST))["num_shards"]) != num_shards:
        raise ValueError(f"{output_dir} holds shards of {there}, not of {num_shards}; merging would repeat rows")
    made, name = f"_writing-{shard_id}-{uuid.uuid4().hex}", f"shard_{shard_id}"
    try:
        _write(data, f"{output_dir}/{made}", kind)
        files.put(made, name)
    finally:
        files.fs.delete(files.path(made), True)
    return f"{output_dir}/{name}"


def in_order(spark: SparkSession, path: str, most_files: int = 500) -> DataFrame:
    """A Parquet folder's rows in the order in which they were written: file by file, by the number in the name.

    Spark's own scan packs files by size. Each file is a scan of its own here, up to ``most_files``; of more, rows are sorted by their positions.
    """
    files, whole = _Files(spark, path), spark.read.parquet(path)
    names = files.files()
    if len(names) < 2:
        return whole
    if len(names) <= most_files:
        return reduce(DataFrame.unionAll, [spark.read.schema(whole.schema).parquet(f"{path}/{n}") for n in names])
    position = free_name(whole, POSITION)
    placed = FileIndex.of(spark, path, names).numbered(whole, position)
    return placed.repartitionByRange(position).sortWithinPartitions(position).drop(position)


def delete(spark: SparkSession, path: str) -> None:
    files = _Files(spark, path)
    files.fs.delete(files.base, True)


def file_index(spark: SparkSession, path: str, kept: str | None = None) -> FileIndex:
    """The index of a Parquet folder; ``kept``: a file that the first job writes and the others read."""
    names = _Files(spark, path).files()
    return _kept(spark, kept, lambda: FileIndex.of(spark, path, names), FileIndex.from_json, lambda i: [n for n, _ in i.files] == names)


def key_index(df: DataFrame, order: str, kept: str | None = None) -> KeyIndex:
    """The index of a table by a column; ``kept`` as for :func:`file_index`."""
    return _kept(df.sparkSession, kept, lambda: KeyIndex.of(df, order), KeyIndex.from_json, lambda i: i.order == order)


def _kept(spark: SparkSession, path: str | None, build: Callable, read: Callable, fits: Callable):
    if path is None:
        return build()
    folder, _, name = path.rpartition("/")
    files = _Files(spark, folder)
    if not files.exists(name):
        files.claim(build().to_json(), name)
    found = read(files.read(name))  # of several jobs that counted at a time, all take the one that is there
    if not fits(found):
        raise ValueError(f"{path} is the index of another table; delete it if that has changed")
    return found


def shard_dirs(spark: SparkSession, path: str) -> list[str]:
    """Folders that begin with ``shard_``, by number; other suffixes count as 0."""
    number = lambda n: int(n[6:]) if n[6:].isdigit() else 0
    return sorted((n for n in _Files(spark, path).folders() if n.startswith("shard_")), key=number)


def dataset_dirs(spark: SparkSession, path: str) -> list[str | None]:
    """Names of the sub-folders with shards; ``[None]`` if only the folder itself has some."""
    found = [n for n in _Files(spark, path).folders() if shard_dirs(spark, f"{path}/{n}") and not n.startswith("shard_")]
    if found:
        return found
    if shard_dirs(spark, path):
        return [None]
    raise RuntimeError(f"no shards in {path}")


def concat(tables: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a table lacks are null, columns of other types are an error."""
    if not tables:
        raise RuntimeError("nothing to merge")
    types: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.schema.fields:
            if not _fits(types.setdefault(f.name, f.dataType), f.dataType):
                raise RuntimeError(f"column {f.name!r} is {types[f.name].simpleString()} and {f.dataType.simpleString()}")
            types[f.name] = f.dataType if isinstance(types[f.name], T.NullType) else types[f.name]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _fits(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return all(_fits(a[n].dataType, b[n].dataType) for n in a.names if n in b.names)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _fits(a.elementType, b.elementType)
    return a.simpleString() == b.simpleString()


def concat_datasets(parts: list[Dataset]) -> Dataset:
    """Tables one after the other; splits by name, each from the parts that have it."""
    if not parts:
        raise RuntimeError("nothing to merge")
    if len({isinstance(p, dict) for p in parts}) > 1:
        raise RuntimeError("tables and splits can't be merged")
    if not isinstance(parts[0], dict):
        return concat(parts)
    names = sorted({n for p in parts for n in p})
    if not names:
        raise RuntimeError("nothing to merge")
    return {n: concat([p[n] for p in parts if n in p]) for n in names}


def read_shard(spark: SparkSession, path: str) -> Dataset:
    files = _Files(spark, path)
    if not files.exists():
        raise FileNotFoundError(path)
    if files.exists("state.json") or files.exists("dataset_dict.json"):
        return saved_dataset(spark, ArrowDirConfig(path))
    if names := [n for n in files.folders() if not n.startswith("_")]:
        return {n: in_order(spark, f"{path}/{n}") for n in names}
    if not files.exists("_SUCCESS"):
        raise FileNotFoundError(f"{path} wasn't finished")
    return in_order(spark, path)


def merge(spark: SparkSession, input_dir: str, output_dir: str, kind: str = "parquet") -> dict[str, dict]:
    """Merges every dataset below a folder; what was read, skipped and missing, by dataset."""
    report = {}
    for name in dataset_dirs(spark, input_dir):
        source = input_dir if name is None else f"{input_dir}/{name}"
        target = output_dir if name is None else f"{output_dir}/{name}"
        parts, absent, empty, numbers = [], 0, 0, []
        for d in shard_dirs(spark, source):
            numbers.append(int(d[6:]) if d[6:].isdigit() else 0)
            try:
                part = read_shard(spark, f"{source}/{d}")
            except FileNotFoundError:
                absent += 1
                continue
            if all(t.isEmpty() for t in (part.values() if isinstance(part, dict) else [part])):
                empty += 1
            else:
                parts.append(part)
        if not parts:
            raise RuntimeError(f"no shard of {source} can be merged: {absent} not found, {empty} empty")
        files = _Files(spark, source)
        count = json.loads(files.read(MANIFEST))["num_shards"] if files.exists(MANIFEST) else max(numbers) + 1
        whole = concat_datasets(parts)
        _write(whole, target, kind)
        report[name or ""] = {"merged": len(parts), "not_found": absent, "empty": empty, "missing": sorted(set(range(count)) - set(numbers))}
    return report
