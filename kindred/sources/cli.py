"""Command line: cluster, split and transform a CSV column."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import report, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred")
    sub = top.add_subparsers(dest="action", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    c = add("cluster", "cluster the values of a column")
    c.add_argument("--html", action="store_true")
    s = add("split", "one row per value of a cell")
    s.add_argument("--separator", default="|")
    t = add("transform", "change a column")
    t.add_argument("--chain", default="", help="transforms, comma-separated")
    t.add_argument("--eval", help="an SQL expression over value")
    t.add_argument("--after", action="store_true")
    for p in (s, t):
        p.add_argument("--target")
    for p in (c, s, t):
        p.add_argument("column")
        p.add_argument("file")
        p.add_argument("-o", "--output")
    h = add("help", "help on an action")
    h.add_argument("about", nargs="?")
    return top


def _emit(text: str, output: str | None) -> None:
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def _rows(df: DataFrame, output: str | None) -> None:
    if output:
        tables.write_csv(df, output)
        return
    import csv

    out = csv.writer(sys.stdout)
    out.writerow(df.columns)
    for row in df.toLocalIterator():
        out.writerow(row)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.action == "help":
        parser().parse_args([args.about, "--help"] if args.about else ["--help"])
        return 0
    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    df = tables.read_csv(spark, args.file, args.column)
    if args.action == "split":
        _rows(tables.split_column(df, args.column, args.separator, args.target), args.output)
    elif args.action == "transform":
        chain = [x for x in args.chain.split(",") if x]
        _rows(tables.transform_column(df, args.column, chain, args.eval, args.target, args.after), args.output)
    else:
        began = time.time()
        found = report.value_clusters(df, args.column).cache()
        totals = found.agg(F.count("*").alias("n"), F.sum("nb_values").alias("v"), F.sum("nb_rows").alias("r")).first()
        stats = {"nb_clusters": totals["n"], "nb_values": totals["v"] or 0, "nb_rows": totals["r"] or 0, "took": round(time.time() - began, 3)}
        render = report.html_report if args.html else report.toml_report
        _emit(render(found, {"algorithm": "fingerprint_collision", "column": args.column, "file": args.file}, stats), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
