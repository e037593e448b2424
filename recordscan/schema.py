"""The shapes of the tables that operators hand on."""

from __future__ import annotations

from pyspark.sql import types as T

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
_NAMES = T.ArrayType(T.StringType())

#: A record's place: the route (central-directory places, outermost first), not the name, tells members apart.
PLACE = [T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("nested_path", _NAMES), T.StructField("route", T.ArrayType(T.IntegerType())), T.StructField("line", T.LongType())]

RECORD = T.StructType([*PLACE, T.StructField("text", T.StringType()), T.StructField("header", T.StringType())])

#: What the archive source emits: records, issues and counts of one pass over the archives.
TAGGED = T.StructType(
    [
        T.StructField("kind", T.StringType()), *RECORD.fields, T.StructField("message", T.StringType()), T.StructField("issue", T.StringType()),
        T.StructField("members_seen", T.LongType()), T.StructField("members_scanned", T.LongType()), T.StructField("bytes_declared", T.LongType()), T.StructField("records", T.LongType()),
    ]
)

MATCH = T.StructType(
    [
        *PLACE, T.StructField("text", T.StringType()), T.StructField("patterns", _NAMES), T.StructField("context_before", _NAMES), T.StructField("context_after", _NAMES), T.StructField("score", T.IntegerType()),
        T.StructField("match_type", T.StringType()), T.StructField("text_spans", _SPAN), T.StructField("query_spans", _SPAN), T.StructField("execution_path", T.StringType()), T.StructField("provenance", _PAIRS),
    ]
)

MEMBER = T.StructType(
    [
        T.StructField("archive", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("member", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("compress_size", T.LongType()),
        T.StructField("encrypted", T.BooleanType()), T.StructField("is_dir", T.BooleanType()), T.StructField("crc", T.LongType()), T.StructField("header_offset", T.LongType()),
    ]
)

SPANS, PAIRS, NAMES = _SPAN, _PAIRS, _NAMES
