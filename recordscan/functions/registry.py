"""The library's functions under SQL names, and its data source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entities import entities_udf
from .text import normalize_text


def register(spark: SparkSession) -> None:
    """normalize_text(s), phone_digits(s), extract_entities(s), smart_score(s, pattern), and format recordscan_archives."""
    from ..operators.smart import score_text
    from ..sources.archives import ArchiveSource

    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(normalize_text, na_action="ignore")

    @F.pandas_udf(T.IntegerType())
    def score(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([score_text(a, b) if a is not None and b is not None else None for a, b in zip(s, p)], dtype="Int32")

    spark.udf.register("normalize_text", normal)
    # digits alone need no Python
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION phone_digits(s STRING) RETURNS STRING
        RETURN (SELECT CASE WHEN length(d) = 11 AND startswith(d, '8') THEN concat('7', substring(d, 2, 10)) ELSE d END FROM (SELECT regexp_replace(s, '\\P{Nd}', '') AS d))"""
    )
    spark.udf.register("extract_entities", entities_udf)
    spark.udf.register("smart_score", score)
    spark.dataSource.register(ArchiveSource)
