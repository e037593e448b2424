"""Order, caps and unions of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of scored matches, and of those that only have a place.
BY_SCORE = ("-score", "archive", "nested_path", "member", "line")
BY_PLACE = ("archive", "route", "line")


def _order(keys: tuple[str, ...]) -> list[Column]:
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]


def top(df: DataFrame, n: int, keys: tuple[str, ...] = BY_SCORE) -> DataFrame:
    """The first n rows in a total order; Spark keeps n rows of each task."""
    return df.orderBy(*_order(keys)).limit(n)


def cap_per(df: DataFrame, group: str, n: int, keys: tuple[str, ...]) -> DataFrame:
    """At most n rows of each group, the first in order; Spark prunes each task's groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(*_order(keys))
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def tagged(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("execution_path", F.lit(path))


def hybrid(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Results of the archives that the index covers, and of those that were scanned."""
    return tagged(indexed, "index").unionByName(tagged(scanned, "scan"))
