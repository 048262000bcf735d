"""``spark-submit sparkloom/cli.py run --config FILE`` and ``... merge --input-dir DIR --output-dir DIR``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Rewrites datasets, or merges what was written in shards.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="rewrite the configured shard of every dataset")
    one.add_argument("--config", required=True)
    two = commands.add_parser("merge", help="merge the shards of every dataset below a folder")
    two.add_argument("--input-dir", required=True)
    two.add_argument("--output-dir", required=True)
    two.add_argument("--output-format", choices=("parquet", "loadable"), default="parquet")
    args = parser.parse_args(argv)
    from sparkloom.operators.shards import merge
    from sparkloom.plans.config import load_config
    from sparkloom.plans.rewrite import run

    config = load_config(args.config) if args.command == "run" else None
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if config:
        print("\n".join(run(spark, config)))
    else:
        for name, r in merge(spark, args.input_dir, args.output_dir, args.output_format).items():
            print(f"{name or args.input_dir}: {json.dumps(r)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
