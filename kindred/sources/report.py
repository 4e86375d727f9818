"""Cluster reports of a column's values, as TOML or HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, functions as F

from kindred.functions.text import fingerprint


def value_clusters(df: DataFrame, column: str) -> DataFrame:
    """(key, nb_values, nb_rows, harmonized, values): values with the same fingerprint.

    ``values`` are (n, value), the most frequent first, and the first is ``harmonized``.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("value is not null")
    keyed = counts.withColumn("key", fingerprint("value")).filter("key <> ''")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "value")))
    found = keyed.groupBy("key").agg(F.count("*").alias("nb_values"), F.sum("n").alias("nb_rows"), ranked.alias("v"))
    values = F.transform("v", lambda x: F.struct((-x["m"]).alias("n"), x["value"].alias("value")))
    return found.filter("nb_values > 1").select(
        "key", "nb_values", "nb_rows", F.get("v", F.lit(0))["value"].alias("harmonized"), values.alias("values")
    )


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _rows(clusters: DataFrame):
    """Clusters come to the driver one partition at a time, as a report is one file."""
    return clusters.orderBy(F.desc("nb_rows"), "key").toLocalIterator()


def toml_report(clusters: DataFrame, info: dict[str, str], stats: dict[str, object]) -> str:
    lines = ["[info]", *(f"{k} = {_quoted(str(v))}" for k, v in info.items()), "", "[stats]"]
    lines += [f"{k} = {v}" for k, v in stats.items()]
    for number, r in enumerate(_rows(clusters)):
        lines += [
            "", "[[cluster]]", f"id = {number}", f"nb_values = {r['nb_values']}", f"nb_rows = {r['nb_rows']}",
            "harmonize = false", f"harmonized = {_quoted(r['harmonized'])}", "values = [",
            *(f"  {_quoted(v['value'])}, # {v['n']} rows" for v in r["values"]), "]",
        ]
    return "\n".join(lines) + "\n"


def html_report(clusters: DataFrame, info: dict[str, str], stats: dict[str, object]) -> str:
    e = lambda x: html.escape(str(x))
    facts = "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in {**info, **stats}.items())
    parts = [
        f"<section><h2>{number}: {e(r['harmonized'])}</h2><p>{r['nb_values']} values, {r['nb_rows']} rows</p><ul>"
        + "".join(f"<li>{e(v['value'])} ({v['n']})</li>" for v in r["values"])
        + "</ul></section>"
        for number, r in enumerate(_rows(clusters))
    ]
    return f"<!doctype html><meta charset='utf-8'><title>Clusters</title><dl>{facts}</dl>" + "".join(parts)
