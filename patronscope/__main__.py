"""Command line: ``spark-submit`` or ``python -m patronscope --input ... --output ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from patronscope.config import SegmentationConfig
from patronscope.plans.pipeline import run
from patronscope.sources.transactions import read_csv, read_parquet


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="patronscope", description="Segment retail customers.")
    parser.add_argument("--input", required=True, help="transactions, Parquet or CSV with header")
    parser.add_argument("--input-format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--timestamp-format", help="pattern of invoice dates in CSV")
    parser.add_argument("--output", required=True, help="folder for the result tables")
    parser.add_argument("--output-format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--config", help="YAML settings")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("patronscope").getOrCreate()
    config = SegmentationConfig.from_yaml(options.config) if options.config else None
    if options.input_format == "csv":
        tx = read_csv(spark, options.input, options.timestamp_format)
    else:
        tx = read_parquet(spark, options.input)
    result = run(tx, options.output, config, fmt=options.output_format)
    result.summary.show(truncate=False)


if __name__ == "__main__":
    main()
