"""Where a match is in its record and in its pattern.

Spans are code-point offsets. They are taken on the few rows that are left
after ranking, in an Arrow UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PHONE, digits_of, normalize_text, token_list
from ..options import SearchOptions
from .smart import PHONE_DIGITS, compile_patterns

_WORD = re.compile(r"[^\W_]+")
_PHONE = re.compile(PHONE)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pattern_spans(text: str, compiled: list[re.Pattern]) -> list[tuple[int, int]]:
    """All places of all patterns, pattern by pattern, as they are found."""
    return [m.span() for c in compiled for m in c.finditer(text)]


def smart_spans(text: str, source: str, match_type: str, case_sensitive: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans in the text and in the pattern for a smart match of known type."""
    fold = lambda s: normalize_text(s, case_sensitive)
    held = token_list(text, case_sensitive)
    known = set(held)
    phones = [m for m in _PHONE.finditer(source) if len(digits_of(m[0])) >= PHONE_DIGITS]
    words = [(fold(m[0]), m.span()) for m in _WORD.finditer(source) if not any(p.start() <= m.start() < p.end() for p in phones)]
    found = lambda w: w in known or len(w) >= 2 and any(h.startswith(w) for h in known)
    seen = {w for w, _ in words if match_type == "phrase" or found(w)}
    query = [s for w, s in words if w in seen]
    where = [m.span() for m in _WORD.finditer(text) if any(fold(m[0]).startswith(w) for w in seen)]
    if match_type == "phone":
        query += [p.span() for p in phones]
        digits = [i for i, c in enumerate(text) if c.isdecimal()]
        wanted = digits_of(source)
        at = digits_of(text).find(wanted)
        if at >= 0 and at + len(wanted) <= len(digits):
            where.append((digits[at], digits[at + len(wanted) - 1] + 1))
    return merged(where), merged(query)


_BOTH = "struct<text_spans:array<struct<start:int,end:int>>,query_spans:array<struct<start:int,end:int>>>"


def evidence(options: SearchOptions, text: Column, patterns: Column, match_type: Column) -> Column:
    """struct(text_spans, query_spans) of matched rows."""
    pairs = lambda spans: [{"start": int(a), "end": int(b)} for a, b in spans]
    mode, case = options.mode, options.case_sensitive
    compiled = [re.compile(p if options.regex else re.escape(p), 0 if case else re.I) for p in options.patterns] if mode in ("literal", "regex") else []
    if mode == "smart":
        compile_patterns(options.patterns, case)

    @F.pandas_udf(_BOTH)
    def spans(texts: pd.Series, matched: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, k in zip(texts, matched, kinds):
            if mode == "smart":
                a, b = smart_spans(t, p[0], k, case)
            elif mode == "advanced":
                a, b = [], [(0, len(x)) for x in p]
            else:
                a, b = pattern_spans(t, compiled), [(0, len(x)) for x in p]
            rows.append((pairs(a), pairs(b)))
        return pd.DataFrame(rows, columns=["text_spans", "query_spans"])

    return spans(text, patterns, match_type)
