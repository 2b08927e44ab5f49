"""Command line: run one named report over a dataset and write it.

    python -m tradelens list
    python -m tradelens run rfm_segments --data /data/export --out /data/reports/rfm \
        --format csv --param as_of=2018-10-01

``--layout marketplace`` (default) reads the export layout; ``--layout star`` reads the
test star schema with the test parameters.  Parameters override ``Params`` fields.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from tradelens.plans import catalog
from tradelens.plans import reports as R


def _coerce(field: dataclasses.Field, text: str):
    current = field.default
    if isinstance(current, bool):
        return text.lower() in ("1", "true", "yes")
    if isinstance(current, int):
        return int(text)
    if isinstance(current, tuple):
        items = [x.strip() for x in text.split(",") if x.strip()]
        return tuple(int(x) if x.lstrip("-").isdigit() else x for x in items)
    return text


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tradelens")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list report names")
    run = sub.add_parser("run", help="run a report and write it")
    run.add_argument("report")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--layout", choices=["marketplace", "star"], default="marketplace")
    run.add_argument("--input-format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--param", action="append", default=[], help="name=value, overrides a Params field")
    run.add_argument("--ui", action="store_true", help="keep Spark's web UI on (off by default)")
    args = parser.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(sorted(catalog.REPORTS)))
        return 0

    from pyspark.sql import SparkSession

    from tradelens.sources import marketplace_tables, star_tables, write_report

    if args.report not in catalog.REPORTS:
        parser.error(f"unknown report {args.report!r}; see `python -m tradelens list`")
    builder = SparkSession.builder.appName(f"tradelens-{args.report}")
    if not args.ui:
        builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    if args.layout == "star":
        tables, params = star_tables(spark, args.data), catalog.TEST_PARAMS
    else:
        tables, params = marketplace_tables(spark, args.data, args.input_format), R.Params()
    fields = {f.name: f for f in dataclasses.fields(R.Params)}
    overrides = {}
    for item in args.param:
        name, _, value = item.partition("=")
        if name not in fields:
            parser.error(f"unknown parameter {name!r}")
        overrides[name] = _coerce(fields[name], value)
    params = dataclasses.replace(params, **overrides)
    write_report(catalog.REPORTS[args.report](tables, params), args.out, fmt=args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
