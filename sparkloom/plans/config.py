"""Configuration: YAML with environment variables, checked as a whole before anything is read."""

from __future__ import annotations

import dataclasses
import os
import warnings
from dataclasses import dataclass, field
from typing import Any

import yaml

from sparkloom.functions.values import PlanError
from sparkloom.operators import generate
from sparkloom.operators.shards import check_range
from sparkloom.sources import loaders


class ConfigError(PlanError):
    """A configuration that can't be used."""


@dataclass
class InputVar:
    name: str
    key: str


@dataclass
class LoadingParams:
    datasets: list[Any] = field(default_factory=list)
    num_shards: int = 1
    shard_id: int = 0
    batch_size: int = 1
    layout: str = "contiguous"
    order: str | None = None  # a column to number rows by; without it they are numbered in the order of the scan
    output_format: str = "parquet"  # or "loadable", the format of saved datasets

    def __post_init__(self) -> None:
        for name in ("num_shards", "shard_id", "batch_size"):
            try:
                setattr(self, name, int(getattr(self, name)))
            except (TypeError, ValueError):
                raise ConfigError(f"{name} must be a whole number, not {getattr(self, name)!r}") from None
        self.batch_size = max(self.batch_size, 1)
        if self.output_format not in ("parquet", "loadable"):
            raise ConfigError(f"output_format must be parquet or loadable, not {self.output_format!r}")
        try:
            check_range(self.num_shards, self.shard_id)
        except ValueError as e:
            raise ConfigError(str(e)) from None


@dataclass
class ProcessingParams:
    inputs: list[InputVar] = field(default_factory=list)
    outputs: list[generate.OutputVar] = field(default_factory=list)
    output_schema: dict[str, Any] = field(default_factory=dict)
    remove_columns: bool = False


@dataclass
class Config:
    processors: list[Any] = field(default_factory=list)
    loading_params: LoadingParams = field(default_factory=LoadingParams)
    processing_params: ProcessingParams = field(default_factory=ProcessingParams)


#: Keys that are taken and mean nothing.
_IDLE = {"conversations_field", "output_dir"}
#: Other spellings of keys.
_ALSO = {"sampling_params": "default_sampling_params"}


def expand(x: Any) -> Any:
    """Environment variables in all string values, keys left alone; unset ones stay as they are."""
    if isinstance(x, str):
        return os.path.expandvars(x)
    if isinstance(x, dict):
        return {k: expand(v) for k, v in x.items()}
    return [expand(v) for v in x] if isinstance(x, list) else x


def _made(cls: type, raw: Any, where: str) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    known = {f.name: f for f in dataclasses.fields(cls)}
    values = {}
    for key, value in raw.items():
        key = _ALSO[key] if key not in known and _ALSO.get(key) in known else key
        if key in known:
            values[key] = value
        elif key in _IDLE:
            warnings.warn(f"{where}.{key} has no effect", stacklevel=3)
        else:
            warnings.warn(f"{where}.{key} is not known and is left out", stacklevel=3)
    missing = [n for n, f in known.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigError(f"{where} lacks {', '.join(missing)}")
    return cls(**values)


def _typed(raw: Any, where: str, find) -> Any:
    if not isinstance(raw, dict) or "type" not in raw:
        raise ConfigError(f"{where} lacks a type")
    try:
        cls = find(raw["type"])
    except ValueError as e:
        raise ConfigError(f"{where}: {e}") from None
    return _made(cls, raw, where)


def _each(raw: dict, key: str, where: str) -> list:
    items = raw.get(key) or []
    if not isinstance(items, list):
        raise ConfigError(f"{where}.{key} must be a list")
    return items


def from_dict(raw: dict[str, Any] | None) -> Config:
    raw = expand(raw or {})
    loading, processing = raw.get("loading_params") or {}, raw.get("processing_params") or {}
    datasets = [_typed(d, f"datasets[{i}]", lambda t: loaders.named(t).config) for i, d in enumerate(_each(loading, "datasets", "loading_params"))]
    inputs = [_made(InputVar, v, f"inputs[{i}]") for i, v in enumerate(_each(processing, "inputs", "processing_params"))]
    outputs = [_typed(v, f"outputs[{i}]", lambda t: generate.named(t).output_var) for i, v in enumerate(_each(processing, "outputs", "processing_params"))]
    processors = [_typed(p, f"processors[{i}]", lambda t: generate.named(t).config) for i, p in enumerate(_each(raw, "processors", "config"))]
    for var in outputs:
        if isinstance(var, generate.LLMVar) and var.is_json:
            var.struct_type()
    return Config(
        processors,
        _made(LoadingParams, loading | {"datasets": datasets}, "loading_params"),
        _made(ProcessingParams, processing | {"inputs": inputs, "outputs": outputs}, "processing_params"),
    )


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))


__all__ = ["Config", "ConfigError", "InputVar", "LoadingParams", "ProcessingParams", "expand", "from_dict", "load_config"]
