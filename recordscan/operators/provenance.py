"""What a record is in its member: format, fields, keys, table, row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import OFFICE_SUFFIXES, SHEET_SUFFIXES, SQLITE_SUFFIXES, suffix


def fields(text: Column, header: Column, line: Column, delimiter: str, patterns: Column) -> Column:
    """Columns, of those the header names, whose value holds a pattern (any column without patterns), joined; null if none."""
    cells = F.arrays_zip(F.split(header, delimiter, -1).alias("name"), F.split(text, delimiter, -1).alias("value"))
    some = F.coalesce(patterns, F.array().cast("array<string>"))
    kept = F.filter(
        cells,
        lambda c: c["name"].isNotNull() & c["value"].isNotNull() & ((F.size(some) == 0) | F.exists(some, lambda p: F.contains(F.lower(c["value"]), F.lower(p)))),
    )
    joined = F.array_join(F.transform(kept, lambda c: c["name"]), ", ")
    return F.when((line > 1) & header.isNotNull() & (header != "") & (F.size(kept) > 0), joined)


def keys(text: Column) -> Column:
    """Keys of a record that is one JSON object, joined; null if it is not."""
    return F.array_join(F.json_object_keys(text), ", ")


def table_name(text: Column) -> Column:
    name = F.regexp_extract(text, r"^\[([^\]]+)\]", 1)
    return F.when(name != "", name)


def provenance(member: Column, line: Column, text: Column, header: Column, patterns: Column) -> Column:
    """Ordered (key, value) pairs of a record."""
    s = suffix(member)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    record = pair("record", line)
    some = lambda k, v: F.when(v.isNotNull(), pair(k, v))
    whole = lambda *p: F.filter(F.array(*p), lambda x: x.isNotNull())
    return (
        F.when(s == ".csv", whole(pair("format", F.lit("CSV")), record, some("fields", fields(text, header, line, ",", patterns))))
        .when(s == ".tsv", whole(pair("format", F.lit("TSV")), record, some("fields", fields(text, header, line, "\t", patterns))))
        .when(s.isin(".json", ".jsonl"), whole(pair("format", F.when(s == ".json", "JSON").otherwise("JSONL")), record, some("keys", keys(text))))
        .when(s.isin(*SQLITE_SUFFIXES), whole(pair("format", F.lit("SQLite")), record, some("table", table_name(text))))
        .when(s.isin(*SHEET_SUFFIXES), whole(pair("format", F.lit("XLSX")), record, pair("row", line)))
        .when(s.isin(*OFFICE_SUFFIXES), whole(pair("format", F.upper(F.substring(s, 2, 10))), record, pair("record", line)))
        .otherwise(F.array(record))
    )


def as_map(pairs: Column) -> Column:
    """Provenance as a map; of a key that comes twice, the last value holds."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)
