"""Records around a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_window(records: DataFrame, keys: list[str], order: str, text: str, n: int) -> DataFrame:
    """Adds context_before and context_after, the n records before and after within keys, by one window."""
    w = Window.partitionBy(*keys).orderBy(order)
    empty = F.array().cast("array<string>")
    if not n:
        return records.withColumn("context_before", empty).withColumn("context_after", empty)
    return records.withColumn("context_before", F.collect_list(text).over(w.rowsBetween(-n, -1))).withColumn("context_after", F.collect_list(text).over(w.rowsBetween(1, n)))


def context_join(matches: DataFrame, records: DataFrame, keys: list[str], order: str, text: str, n: int) -> DataFrame:
    """The same for matches that are few (already limited): their neighbours are looked up, records are not sorted.

    order counts 1, 2, 3 ... within keys. The looked-up side has 2n + 1 rows for
    each match; whether it is broadcast is left to its size.
    """
    around = F.explode(F.sequence(F.col(order) - n, F.col(order) + n))
    wanted = matches.select(*keys, F.col(order).alias("_of"), around.alias(order)).filter(F.col(order) != F.col("_of"))
    near = records.select(*keys, order, text).join(wanted, [*keys, order])
    by = near.groupBy(*keys, F.col("_of").alias(order)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("said")))).alias("_near"))
    out = matches.join(by, [*keys, order], "left")
    pick = lambda test: F.coalesce(F.transform(F.filter("_near", test), lambda x: x["said"]), F.array().cast("array<string>"))
    return out.withColumn("context_before", pick(lambda x: x["at"] < F.col(order))).withColumn("context_after", pick(lambda x: x["at"] > F.col(order))).drop("_near")


def with_header(records: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds header, the first record of keys, to all records; the first records are a small side of the join."""
    first = records.filter(F.col(order) == 1).select(*keys, F.col(text).alias("header"))
    return records.join(first, keys, "left")
