"""Dataset sources: a registry of loaders, each giving one table or a table per split."""

from sparkloom.sources.loaders import (
    LOADERS,
    ArrowDirConfig,
    Dataset,
    JsonlConfig,
    LoadError,
    ParquetConfig,
    load,
    load_all,
    loader,
    rows,
)

__all__ = ["LOADERS", "ArrowDirConfig", "Dataset", "JsonlConfig", "LoadError", "ParquetConfig", "load", "load_all", "loader", "rows"]
