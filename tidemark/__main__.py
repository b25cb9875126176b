"""Write the four reports of an order log.

    python -m tidemark --log <path> --out <folder> [--percentile 0.95 ...]
    python -m tidemark --log <path> --out-table <schema.prefix_> [--store-name "Brand" ...]
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from tidemark.config import StudyConfig
from tidemark.plans.study import Study
from tidemark.sources.order_log import read_grid_csv, read_order_log, read_order_log_csv


def _ids(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(","))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--log", required=True, help="order log: a file, folder or glob")
    parser.add_argument("--log-format", default="csv", help="csv, parquet, orc, ...")
    parser.add_argument("--grid", help="CSV with the times of day at which orders are counted; else every minute")
    out = parser.add_mutually_exclusive_group(required=True)
    out.add_argument("--out", help="folder for the reports")
    out.add_argument("--out-table", help="beginning of the reports' table names, such as sales.june_")
    parser.add_argument("--out-format", default="parquet")
    parser.add_argument(
        "--as-set", action="store_true", help="replace the last reports when all four are written: versions and a pointer"
    )
    for field in fields(StudyConfig):
        option = "--" + field.name.replace("_", "-")
        if isinstance(field.default, bool):
            parser.add_argument(option, action="store_true")
        elif field.name == "store_name":
            parser.add_argument(option, help="one brand of the selected stores")
        elif field.default is None:
            parser.add_argument(option, type=_ids, help="store ids, with commas between")
        else:
            parser.add_argument(option, type=type(field.default), default=field.default)
    args = vars(parser.parse_args(argv))

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    # clock times of the log are local already: a zone of the cluster must not move them
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log_format = args["log_format"]
    if log_format == "csv":
        log = read_order_log_csv(spark, args["log"])
    else:
        log = read_order_log(spark, args["log"], log_format)
    grid = read_grid_csv(spark, args["grid"]) if args["grid"] else None
    with Study(log, StudyConfig(**{f.name: args[f.name] for f in fields(StudyConfig)}), grid) as study:
        write = study.publish_reports if args["as_set"] else study.write_reports
        for place in write(args["out"], args["out_format"], args["out_table"]):
            print(place)


if __name__ == "__main__":
    main()
