"""Normalisation, tokens and telephone digits, as Columns and for single values on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a run that may be a telephone number.
PHONE = r"\+?\d(?:[\d(). -]*\d)?"
#: Fixed value: digits that make such a run a number.
PHONE_DIGITS = 7
#: Runs of what str.isalnum says yes to.
_RUNS = re.compile(r"[^\W_]+")


def normalize_text(value: str, case_sensitive: bool = False) -> str:
    """NFKC, case folding with ё as е, then letters and digits with one space between their runs."""
    value = unicodedata.normalize("NFKC", value)
    if not case_sensitive:
        value = value.casefold().replace("ё", "е")
    return " ".join(_RUNS.findall(value))


def token_list(value: str, case_sensitive: bool = False) -> list[str]:
    n = normalize_text(value, case_sensitive)
    return n.split(" ") if n else []


def digits_of(value: str) -> str:
    """The digits of a value; of eleven that start with 8, the first becomes 7."""
    d = "".join(c for c in value if c.isdecimal())
    return "7" + d[1:] if len(d) == 11 and d[0] == "8" else d


@F.pandas_udf(T.StringType())
def _exact_folded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(normalize_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _exact_cased(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(lambda x: normalize_text(x, True), na_action="ignore")


def normalized(text: Column, case_sensitive: bool = False, exact: bool = False) -> Column:
    """Normalised text.

    The fast form stays in the JVM; it equals the exact one for text that NFKC
    leaves unchanged and whose case folding is its lower case with ß as ss.
    The exact form is that for texts of ASCII alone, which both treat alike, and
    an Arrow UDF for the others.
    """
    if exact:
        # not deterministic for the optimizer: a filter on the result must stay above the UDF, wherever the records come from
        folded = (_exact_cased if case_sensitive else _exact_folded).asNondeterministic()
        ascii_ = F.octet_length(text) == F.length(text)
        return F.coalesce(folded(F.when(~ascii_, text)), normalized(text, case_sensitive))
    low = text if case_sensitive else F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ё"), F.lit("е"))
    # a run at once, and the commonest letters first: the class is looked at for each character of each text
    return F.trim(F.regexp_replace(low, r"[^a-z0-9\p{L}\p{N}]+", " "))


def tokens(normal: Column) -> Column:
    """Tokens of a normalised text, in order, repeats included."""
    return F.array_remove(F.split(normal, " "), "")


def phone_digits(text: Column) -> Column:
    d = F.regexp_replace(text, r"\P{Nd}+", "")
    return F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)


def phone_components(text: Column) -> Column:
    """Digits of the telephone-like runs of a text, in order."""
    runs = F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0))
    return F.filter(F.transform(runs, phone_digits), lambda x: F.length(x) >= PHONE_DIGITS)


def has_prefix(normal: Column, prefix: str) -> Column:
    """Whether some token starts with the prefix, which may go on over spaces in no case."""
    return F.concat(F.lit(" "), normal).contains(f" {prefix}")


def java_regex(pattern: str) -> str:
    """A Python regular expression in Java's dialect, for what differs in the syntax both have."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
