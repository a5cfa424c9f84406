"""Command line: ``python -m postalloom.plans.cli full|incremental|file …``."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from postalloom.config import EngineConfig
from postalloom.plans import pipeline
from postalloom.sources import sinks

log = logging.getLogger("postalloom")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="postalloom")
    parser.add_argument("--config", help="JSON file with fields of EngineConfig")
    parser.add_argument("--threshold", type=float)
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("full", "incremental"):
        sub = modes.add_parser(name)
        sub.add_argument("--source-table", required=True)
        sub.add_argument("--result-table", required=True)
        sub.add_argument("--address-col", default="recipient_address_complete")
        sub.add_argument("--limit", type=int)
        if name == "incremental":
            sub.add_argument("--last-processed-time", required=True)
            sub.add_argument("--run", required=True, help="name of this run, part of new group ids")
    sub = modes.add_parser("file")
    for flag, more in (("--input", {"required": True}), ("--output", {"required": True}), ("--address-col", {"default": "address"}), ("--lon-col", {}), ("--lat-col", {}), ("--sample", {"type": int})):
        sub.add_argument(flag, **more)
    return parser.parse_args(argv)


def settings(args: argparse.Namespace) -> EngineConfig:
    config = EngineConfig()
    if args.config:
        with open(args.config, encoding="utf-8") as source:
            config = config.updated(**json.load(source))
    return config.updated(similarity_threshold=args.threshold) if args.threshold is not None else config


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("postalloom").getOrCreate()
    config = settings(args)
    if args.mode == "file":
        pipeline.file_run(spark, args.input, args.address_col, args.output, args.lon_col, args.lat_col, args.sample, config)
        log.info("wrote %s", args.output)
        return
    sinks.create_result_table(spark, args.result_table)
    source = spark.table(args.source_table)
    if args.mode == "full":
        _, rows = pipeline.full_run(source, args.address_col, config, args.limit)
    else:
        rows = pipeline.incremental_run(source, args.address_col, spark.table(args.result_table), args.last_processed_time, args.run, config, args.limit)
    sinks.append(rows, args.result_table)
    log.info("appended to %s", args.result_table)


if __name__ == "__main__":
    main()
