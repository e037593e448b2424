"""Member names: suffixes, globs, and what is safe to open."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that are read line by line, as databases, as workbooks, and as documents.
TEXT_SUFFIXES = (".txt", ".csv", ".tsv", ".log", ".json", ".jsonl", ".xml", ".html", ".htm", ".md", ".rst", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".dat", ".tad", ".cpy")
SQLITE_SUFFIXES = (".db", ".sqlite", ".sqlite3")
SHEET_SUFFIXES = (".xlsx",)
OFFICE_SUFFIXES = (".docx", ".pptx", ".odt")
READABLE = (*TEXT_SUFFIXES, *SQLITE_SUFFIXES, *SHEET_SUFFIXES, *OFFICE_SUFFIXES, ".zip")


def slashed(name: str) -> str:
    return name.replace("\\", "/")


def base_of(name: str) -> str:
    return slashed(name).rstrip("/").rpartition("/")[2]


def suffix_of(name: str) -> str:
    """The last suffix with its dot, lower-cased; empty if there is none."""
    stem, dot, last = base_of(name).rpartition(".")
    return f".{last}".lower() if dot and stem and last else ""


def is_unsafe(name: str) -> bool:
    """Whether a member's path is absolute or climbs out of its archive."""
    n = slashed(name)
    return n.startswith("/") or ".." in n.split("/")


def dotted(extensions: tuple[str, ...]) -> frozenset[str]:
    return frozenset((e if e.startswith(".") else f".{e}").lower() for e in extensions)


def _any_glob(name: str, globs: tuple[str, ...]) -> bool:
    return any(fnmatch.fnmatchcase(x, g) for g in globs for x in (slashed(name), base_of(name)))


def is_excluded(name: str, exclude: tuple[str, ...]) -> bool:
    return _any_glob(name, exclude)


def is_wanted(name: str, extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> bool:
    """Whether a member is to be read: by suffix, then include globs, then exclude globs."""
    if suffix_of(name) not in (dotted(extensions) if extensions else READABLE):
        return False
    return (not include or _any_glob(name, include)) and not is_excluded(name, exclude)


# the same as Columns, for tables of names


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(basename(name), r"^.+(\.[^.]+)$", 1))


def basename(name: Column) -> Column:
    return F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)


def unsafe(name: Column) -> Column:
    return F.translate(name, "\\", "/").rlike(r"^/|(^|/)\.\.(/|$)")


def glob(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether some glob matches the whole path or its last part; * crosses slashes, case counts."""
    full, hit = F.translate(name, "\\", "/"), F.lit(False)
    for p in patterns:
        r = "^" + re.sub(r"\\[zZ]$", "", fnmatch.translate(p)) + r"\z"
        hit = hit | full.rlike(r) | basename(name).rlike(r)
    return hit


def wanted(name: Column, extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    ok = suffix(name).isin(sorted(dotted(extensions) if extensions else READABLE))
    if include:
        ok = ok & glob(name, include)
    return ok & ~glob(name, exclude) if exclude else ok
