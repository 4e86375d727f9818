"""CSV in and out, and the split and transform actions on a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import text


def read_csv(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A CSV file with a header; every column is a string. A missing ``column`` is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if column is not None and column not in df.columns:
        raise ValueError(f"no column {column!r}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def split_column(df: DataFrame, column: str, separator: str = "|", target: str | None = None) -> DataFrame:
    """One row per value of a multi-valued cell; an empty cell keeps its row.

    The values take the column's place, or go to a new last column ``target``.
    """
    import re

    values = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), re.escape(separator)))
    if target is None:
        return df.select(*(values.alias(c) if c == column else F.col(c) for c in df.columns))
    return df.select("*", values.alias(target))


TRANSFORMS = {
    "fingerprint": text.fingerprint,
    "len": lambda c: F.length(c).cast("string"),
    "lower": F.lower,
    "squeeze": text.squeeze,
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "unidecode": text.fold,
    "upper": F.upper,
}


def transform_column(
    df: DataFrame, column: str, chain: list[str] = (), expression: str | None = None, target: str | None = None, after: bool = False
) -> DataFrame:
    """Apply named transforms in order, or an SQL expression over ``value``.

    The result takes the column's place, or goes to ``target``, last or just after the column.
    """
    value = F.col(column)
    for name in chain:
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {name!r}")
        value = TRANSFORMS[name](value)
    if expression is not None:
        df, value = df.withColumn("value", value), F.expr(expression)
    made = value.alias(target or column)
    columns = [c for c in df.columns if expression is None or c != "value"]
    if target is None:
        return df.select(*(made if c == column else F.col(c) for c in columns))
    out = [F.col(c) for c in columns]
    out.insert(columns.index(column) + 1 if after else len(out), made)
    return df.select(*out)
