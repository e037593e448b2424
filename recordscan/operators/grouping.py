"""Groups of matches by an exact key, and counts of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import emails, entities
from ..functions.text import phone_components
from ..options import ConfigurationError

MODES = ("exact", "phone", "email", "entity")


def group_key(text: Column, mode: str) -> Column:
    """The value that a match is grouped by: its first one of the mode's kind, or else its text."""
    if mode == "exact":
        return text
    if mode == "phone":
        return F.coalesce(F.get(phone_components(text), F.lit(0)), text)
    if mode == "email":
        return F.coalesce(F.get(emails(text), F.lit(0)), text)
    if mode == "entity":
        return F.coalesce(F.get(entities(text), F.lit(0))["value"], text)
    raise ConfigurationError(f"grouping is one of {', '.join(MODES)}")


def group_matches(matches: DataFrame, mode: str, ordinal: str = "ordinal") -> DataFrame:
    """mode, key, n and all occurrences in order, groups by their first occurrence.

    matches has the result's order in `ordinal`; a search's result is limited,
    so its groups are, too.
    """
    keyed = matches.withColumn("key", group_key(F.col("text"), mode))
    row = F.struct(F.col(ordinal), *(c for c in matches.columns if c != ordinal))
    grouped = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"), F.array_sort(F.collect_list(row), lambda a, b: (a[ordinal] - b[ordinal]).cast("int")).alias("occurrences"))
    return grouped.select(F.lit(mode).alias("mode"), "key", "n", "first", "occurrences").orderBy("first")


def group_counts(rows: DataFrame, mode: str) -> DataFrame:
    """key and n of all rows of any number: counts alone, combined before the shuffle."""
    return rows.groupBy(group_key(F.col("text"), mode).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def tree(matches: DataFrame) -> DataFrame:
    """Members of a result, the best score first, with their rows by score and line."""
    row = F.struct((-F.col("score")).alias("rank"), "line", "text")
    by = matches.groupBy("archive", "member", "nested_path").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("lines"), F.array_sort(F.collect_list(row)).alias("rows"))
    return by.orderBy(F.desc("best"), "archive", "nested_path", "member")


def counts(rows: DataFrame, by: str = "archive") -> DataFrame:
    """Matches, distinct members and distinct records of each archive."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("member").alias("members"))


def summary(stats: DataFrame, n_matches: int, n_issues: int, path: str = "scan") -> DataFrame:
    """One row with the counts of a whole search. stats: archive, members_seen, members_scanned, completed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stats.agg(
        F.count(F.lit(1)).alias("archives_seen"), F.coalesce(F.sum(F.col("completed").cast("long")), F.lit(0)).alias("archives_completed"), total("members_seen"), total("members_scanned")
    ).withColumns({"matches": F.lit(n_matches), "issues": F.lit(n_issues), "execution_path": F.lit(path)})
