"""Run one report: ``spark-submit`` or ``python -m linkcensus --tables DIR --watchlist FILE``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from linkcensus import Scope, census, read_tables, watchlist_from_text


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkcensus", description="Count references to listed URLs by entity.")
    parser.add_argument("--tables", required=True, help="folder with one sub-folder per logical table")
    parser.add_argument("--format", default="parquet", help="Spark file format of the tables")
    parser.add_argument("--watchlist", required=True, help="text file or folder, one URL per line")
    parser.add_argument("--mode", choices=("like", "instr"), default="like",
                        help="like: listed URLs as they are; instr: their normalized paths and domains")
    parser.add_argument("--sites", help="comma-separated site ids; all sites if not given")
    parser.add_argument("--output", help="folder for the report as CSV; printed if not given")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("linkcensus").getOrCreate()
    sites = tuple(int(s) for s in args.sites.split(",")) if args.sites else None
    report = census(
        read_tables(spark, args.tables, args.format), watchlist_from_text(spark, args.watchlist), args.mode, Scope(sites=sites)
    )
    if args.output:
        report.coalesce(1).write.option("header", True).csv(args.output)
    else:
        for row in report.collect():
            print(f"{row.entity}\t{row.total_count}")


if __name__ == "__main__":
    main()
