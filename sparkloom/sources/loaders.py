"""Loaders by type name. ``JSONL`` reads JSON lines, ``loadable`` saved datasets, ``parquet`` Parquet."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

logger = logging.getLogger(__name__)

#: One table, or tables by split name.
Dataset = DataFrame | dict[str, DataFrame]


class LoadError(RuntimeError):
    """No dataset could be loaded."""


@dataclass
class JsonlConfig:
    path: str | dict[str, str]
    output_dir: str = ""
    type: str = "JSONL"
    schema: str | None = None  # DDL; inferred if not given


@dataclass
class ArrowDirConfig:
    path: str
    output_dir: str = ""
    type: str = "loadable"
    columns: list[str] | None = None  # to decode only these; a plan that drops its source's columns asks for what it reads
    split_bytes: int | None = None


@dataclass
class ParquetConfig:
    path: str | dict[str, str]
    output_dir: str = ""
    type: str = "parquet"


@dataclass(frozen=True)
class Loader:
    config: type
    load: Callable[[SparkSession, object], Dataset | None]


LOADERS: dict[str, Loader] = {}


def loader(name: str, config: type):
    """Registers a function ``(spark, config) -> Dataset or None`` under a type name; returns it unchanged."""

    def add(f):
        LOADERS[name] = Loader(config, f)
        return f

    return add


def named(name: str) -> Loader:
    if name not in LOADERS:
        raise ValueError(f"unknown dataset type {name!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name]


def _by_split(path: str | dict[str, str], read: Callable[[str], DataFrame]) -> Dataset:
    return {split: read(p) for split, p in path.items()} if isinstance(path, dict) else read(path)


def _in_order(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """Inferred columns in the order in which a first record names them."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    try:
        keys = list(json.loads(first[0])) if first else []
    except (ValueError, TypeError):
        keys = []
    place = {k: i for i, k in enumerate(keys)}
    return T.StructType(sorted(schema.fields, key=lambda f: place.get(f.name, len(place))))


@loader("JSONL", JsonlConfig)
def jsonl(spark: SparkSession, config: JsonlConfig) -> Dataset:
    def read(path: str) -> DataFrame:
        reader = spark.read.option("mode", "FAILFAST")
        if config.schema:
            return reader.schema(config.schema).json(path)
        return reader.schema(_in_order(spark, path, reader.json(path).schema)).json(path)

    tables = _by_split(config.path, read)
    if isinstance(tables, dict) and len({t.schema.simpleString() for t in tables.values()}) > 1:
        tables = _same_columns(tables)
    return tables


def _same_columns(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Splits with all columns of all splits; those a split lacks are null."""
    empty = [t.limit(0) for t in tables.values()]
    whole = empty[0]
    for e in empty[1:]:
        whole = whole.unionByName(e, allowMissingColumns=True)
    return {s: whole.unionByName(t, allowMissingColumns=True) for s, t in tables.items()}


@loader("loadable", ArrowDirConfig)
def saved(spark: SparkSession, config: ArrowDirConfig) -> Dataset:
    from sparkloom.sources import arrow_dir

    spark.dataSource.register(arrow_dir.ArrowDir)
    more = {} if config.columns is None else {"columns": json.dumps(config.columns)}
    more |= {} if config.split_bytes is None else {"split_bytes": str(config.split_bytes)}
    read = lambda p: spark.read.format("arrow_dir").options(path=p, **more).load()
    names = arrow_dir.splits(config.path)
    return {n: read(f"{config.path}/{n}") for n in names} if names is not None else read(config.path)


@loader("parquet", ParquetConfig)
def parquet(spark: SparkSession, config: ParquetConfig) -> Dataset:
    return _by_split(config.path, spark.read.parquet)


def load(spark: SparkSession, config) -> Dataset | None:
    """One dataset; its schema and paths are resolved, so errors show here and not in a later job."""
    data = named(config.type).load(spark, config)
    for table in data.values() if isinstance(data, dict) else [] if data is None else [data]:
        if table.isStreaming:
            raise RuntimeError("a streaming dataset can't be loaded as a table")
        table.schema  # noqa: B018
    return data


def load_all(spark: SparkSession, configs: Iterable) -> list[tuple[object, Dataset]]:
    """Each config with its dataset. Those that fail are logged and left out; if all do, that is an error."""
    out, configs = [], list(configs)
    for config in configs:
        try:
            data = load(spark, config)
        except Exception as e:  # any failure of one dataset leaves the others
            logger.error("dataset %s was not loaded: %s", config.path, e)
            continue
        if data is not None:
            out.append((config, data))
    if not out:
        raise LoadError(f"none of {len(configs)} datasets could be loaded")
    return out


def rows(data: Dataset) -> int:
    return sum(t.count() for t in data.values()) if isinstance(data, dict) else data.count()
