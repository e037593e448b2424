"""Literal and regular-expression predicates over records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import java_regex


def _quoted(pattern: str) -> str:
    """A literal for Java's regular expressions."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def literal(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Whether a text holds the pattern as it is written.

    Case-sensitive matches and ASCII patterns without letters are plain
    containment, which Parquet scans can be filtered by; others fold case.
    """
    if case_sensitive or not any(c.isalpha() for c in pattern):
        return text.contains(pattern)
    return text.rlike("(?iu)" + _quoted(pattern))


def regex(text: Column, pattern: str, case_sensitive: bool = False, engine: str = "java") -> Column:
    """Whether a regular expression, in Python's syntax, is found in a text.

    Java's engine searches in the JVM, its classes and case folding set to
    Unicode; engine 'python' is an Arrow UDF for what only Python's has.
    """
    if engine == "python":
        found = re.compile(pattern, 0 if case_sensitive else re.I).search

        @F.pandas_udf("boolean")
        def search(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t is not None and found(t) is not None)

        return search(text)
    return text.rlike(("(?U)" if case_sensitive else "(?iuU)") + java_regex(pattern))


#: What Python's regular expressions have and Java's lack or read otherwise.
_PYTHON_ONLY = re.compile(r"\(\?\(|\(\?P>|\{,\d|\(\?[a-zA-Z]*L|&&|\[[^\]]*\[|\\[ABzbGpPXRQEhHKkNcaefxuU0](?<!\\[AbkuxUN])|\(\?<[=!][^)]*[*+{]")


def engine_for(pattern: str) -> str:
    """java where both dialects mean the same, else python."""
    if _PYTHON_ONLY.search(pattern):
        return "python"
    return "java"


def matched_patterns(text: Column, patterns: tuple[str, ...], regular: bool = False, case_sensitive: bool = False) -> Column:
    """The patterns that a text matches, in their order; empty if none does."""
    one = lambda p: regex(text, p, case_sensitive, engine_for(p)) if regular else literal(text, p, case_sensitive)
    return F.filter(F.array(*(F.when(one(p), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())


def any_pattern(text: Column, patterns: tuple[str, ...], regular: bool = False, case_sensitive: bool = False) -> Column:
    hit = None
    for p in patterns:
        this = regex(text, p, case_sensitive, engine_for(p)) if regular else literal(text, p, case_sensitive)
        hit = this if hit is None else hit | this
    return hit
