"""Cells that a text takes on a terminal: none for combining marks, two for wide characters of East Asia, one for others."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def cells_of(text: str) -> int:
    return sum(map(_cells, text))


def _cells(c: str) -> int:
    if unicodedata.combining(c):
        return 0
    return 1 + (unicodedata.east_asian_width(c) in ("W", "F"))


@cache
def _runs(cells: int) -> list[tuple[int, int]]:
    """Runs of characters that take so many cells, first and last."""
    found = []
    for ok, run in groupby((i for i in range(0x110000) if not 0xD800 <= i < 0xE000), key=lambda i: _cells(chr(i)) == cells):
        if ok:
            members = list(run)
            found.append((members[0], members[-1]))
    return found


def _class(runs: list[tuple[int, int]]) -> str:
    """A Java character class of runs of characters."""
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


#: Runs of so many characters are looked for first: a class of all runs is hundreds of comparisons for each character.
LONG = 1000


def cells(text: Column | str) -> Column:
    """The cells of each text; null of null.

    What most texts are made of goes first, by classes of few runs: letters of
    one cell, then the large blocks of wide ones. The whole classes meet the rest.
    """
    text = F.col(text) if isinstance(text, str) else text
    gone = lambda t, runs: F.regexp_replace(t, _class(runs) + "+", "")
    one, two, none = _runs(1), _runs(2), _runs(0)
    usual = [r for r in one if r[0] == 0 or r[0] < 0x3000 and r[1] - r[0] >= 100]
    blocks = [r for r in two if r[1] - r[0] >= LONG]
    odd = gone(text, usual)
    narrower = gone(odd, blocks)
    wide = F.length(odd) - F.length(gone(narrower, two))
    marks = F.length(narrower) - F.length(gone(narrower, none))
    return F.length(text) + wide - marks


def clipped(text: str, width: int) -> str:
    """As many whole characters of a text as fit."""
    used = 0
    for i, c in enumerate(text):
        used += _cells(c)
        if used > max(0, width):
            return text[:i]
    return text
