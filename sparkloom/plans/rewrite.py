"""The rewriting plan: extract inputs, derive outputs in order, project the output schema.

Everything is checked and compiled on the driver; the result is one lazy
DataFrame with as many rows as the source, in its order.
"""

from __future__ import annotations

import dataclasses
import logging
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import templates
from sparkloom.functions import values as V
from sparkloom.functions.paths import compile_path, root_fields
from sparkloom.functions.values import PlanError, Value
from sparkloom.operators import generate, shards
from sparkloom.operators.generate import ROW, VARIABLES
from sparkloom.plans.config import Config, LoadingParams, ProcessingParams
from sparkloom.sources import ArrowDirConfig, Dataset, ParquetConfig, load_all

logger = logging.getLogger(__name__)


def validate(params: ProcessingParams) -> None:
    """Every output must be computable from the inputs and the outputs before it."""
    names = {v.name for v in params.inputs}
    for var in params.outputs:
        if not var.is_computable(names):
            raise PlanError(f"variable {var.name!r} needs {', '.join(sorted(var.needs() - names))}, which nothing before it gives")
        names.add(var.name)


def extract(df: DataFrame, params: ProcessingParams) -> DataFrame:
    """The row and the inputs, as one struct column each. A null input stops the run, used or not.

    The guard is a filter: one inside a projection would vanish with an unused column.
    """
    root = Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    found = {v.name: compile_path(v.key, root) for v in params.inputs}
    out = df.select(root.col.alias(ROW), generate.named_fields(found).alias(VARIABLES))
    if not found:
        return out
    guard = F.lit(True)
    for v in reversed(params.inputs):
        error = F.raise_error(F.lit(f"input {v.name!r}: {v.key!r} is null")).cast("boolean")
        guard = F.when(F.col(VARIABLES).getField(v.name).isNull(), error).otherwise(guard)
    return out.filter(guard)


def project(template: Any, names: dict[str, Value]) -> Value:
    """A nested output template as one value. Keys are not templates."""
    if isinstance(template, dict):
        if len(template) == 1 and next(iter(template.values())) is None:
            warnings.warn(f"{template!r} is a mapping with a null; a variable is written '{{{{ name }}}}'", stacklevel=2)
        return V.struct({str(k): project(v, names) for k, v in template.items()})
    if isinstance(template, list):
        return V.array([project(v, names) for v in template])
    if isinstance(template, str):
        for name in sorted(templates.free_variables(template) - set(names)):
            warnings.warn(f"{name!r} is not a variable and prints nothing in {template!r}", stacklevel=2)
        return templates.compile_template(template, names)
    return V.literal(template)


def processors(config: Config) -> dict[str, generate.Processor]:
    out: dict[str, generate.Processor] = {}
    for p in config.processors:
        if p.type in out:
            warnings.warn(f"a second processor of type {p.type!r} replaces the first", stacklevel=2)
        out[p.type] = generate.named(p.type).processor(p, batch_size=config.loading_params.batch_size)
    out.setdefault("expr", generate.ExprProcessor(generate.ExprConfig()))
    return out


def rewrite(df: DataFrame, config: Config) -> DataFrame:
    """One row of output for each row of ``df``."""
    params = config.processing_params
    validate(params)
    by_type = processors(config)
    columns = df.columns
    df = extract(df, params)
    if params.remove_columns:
        df = df.select(VARIABLES)  # before any generator, which would be handed all columns
    for var in params.outputs:
        if var.type not in by_type:
            raise PlanError(f"variable {var.name!r}: no processor of type {var.type!r} is configured")
        df = by_type[var.type].apply(df, var)
    names = generate.variables(df)
    made = {k: project(t, names) for k, t in params.output_schema.items()}
    made = {k: v.col.cast("string") if isinstance(v.type, T.NullType) else v.col for k, v in made.items()}
    if params.remove_columns:
        return df.select(*[c.alias(k) for k, c in made.items()])
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in columns if c not in made], *[c.alias(k) for k, c in made.items()])


def run(spark: SparkSession, config: Config) -> list[str]:
    """Loads, shards, rewrites and writes every dataset; the folders written."""
    loading = config.loading_params
    if not loading.datasets:
        raise PlanError("no datasets")
    validate(config.processing_params)
    was = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return _write_all(spark, config)
    finally:
        spark.conf.set("spark.sql.caseSensitive", was)


def _narrowed(dataset: Any, config: Config) -> Any:
    """A saved dataset of which only the columns that the plan reads are decoded."""
    read = [root_fields(v.key) for v in config.processing_params.inputs]
    if not isinstance(dataset, ArrowDirConfig) or dataset.columns is not None or not config.processing_params.remove_columns or not read or None in read:
        return dataset
    return dataclasses.replace(dataset, columns=sorted({*set().union(*read), *([config.loading_params.order] if config.loading_params.order else [])}))


def _part(spark: SparkSession, dataset: Any, data: Dataset, loading: LoadingParams) -> Dataset:
    """This job's shard. Parquet tables, and those ordered by a column, are counted by the first job only, which leaves an index for the others."""

    def one(table: DataFrame, path: str | None, split: str) -> DataFrame:
        kept = f"{dataset.output_dir}/_index{split}.json"
        index = None
        if loading.num_shards > 1 and loading.order:
            index = shards.key_index(table, loading.order, kept)
        elif loading.num_shards > 1 and path:
            index = shards.file_index(spark, path, kept)
        return shards.shard(table, loading.num_shards, loading.shard_id, loading.layout, index=index)

    paths = dataset.path if isinstance(dataset, ParquetConfig) else {}
    if isinstance(data, dict):
        return {name: one(t, paths.get(name) if isinstance(paths, dict) else None, f"-{name}") for name, t in data.items()}
    return one(data, paths if isinstance(paths, str) else None, "")


def _write_all(spark: SparkSession, config: Config) -> list[str]:
    loading, out = config.loading_params, []
    for dataset, data in load_all(spark, [_narrowed(d, config) for d in loading.datasets]):
        part = _part(spark, dataset, data, loading)
        done: Dataset = shards.each_split(part, lambda t: rewrite(t, config))
        out.append(shards.write_shard(spark, done, dataset.output_dir, loading.shard_id, loading.num_shards, loading.output_format))
        logger.info("wrote %s", out[-1])
    return out
