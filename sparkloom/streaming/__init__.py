"""The rewriting plan over a stream.

The plan keeps no state and treats rows one by one, so it works on unbounded
input as it is; the batch entry point refuses streams, this is the one for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkloom.plans.config import Config
from sparkloom.plans.rewrite import rewrite


def rewrite_stream(stream: DataFrame, config: Config, output_dir: str, checkpoint_dir: str, **trigger) -> StreamingQuery:
    """Starts writing rewritten rows as Parquet, each exactly once. ``trigger``: as for ``writeStream.trigger``."""
    if not stream.isStreaming:
        raise ValueError("a table is rewritten by sparkloom.plans.rewrite")
    writer = rewrite(stream, config).writeStream.format("parquet").option("path", output_dir).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(**trigger) if trigger else writer).start()
