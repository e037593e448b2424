"""Postings of archives, made where the archives are read. Plain Python and Arrow: this runs inside tasks.

A task reads its archives, numbers their terms, sorts the postings by term and
writes them, with the terms that it met, as Parquet of its own. Nothing goes
through the JVM and nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ..functions.text import normalize_text
from ..sources.archives import Issue, ReadOptions, read_archive

#: Digits that a record needs for its digits to be looked up.
DIGITS = 7
#: Postings that a task holds before it writes them.
HELD = 4_000_000
#: Rows of a row group: terms are sorted, so that a lookup reads few of them.
ROW_GROUP = 1 << 17
#: What digits start with while they are told apart by that: no term has such a character.
_MARK = b"\x01"
_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = bytes(c if c in _ALNUM else 32 for c in range(256)).lower()
_NO_DIGIT = bytes(c for c in range(256) if c not in b"0123456789")
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def decimals(spark) -> str:
    """Digits beyond ASCII that the JVM, which looks at records again, takes for digits too."""
    own = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())
    return spark.sparkContext._jvm.java.util.regex.Pattern.compile("\\P{Nd}+").matcher(own).replaceAll("")


def _rotated(h: np.ndarray, n: int) -> np.ndarray:
    return (h << np.uint64(n)) | (h >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hash_int(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int, after what the seed is the hash of."""
    return _mixed(_rotated((seed + _P5 + np.uint64(4)) ^ (values.astype(np.uint32).astype(np.uint64) * _P1), 23) * _P2 + _P3)


def hash_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The same of a long."""
    return _mixed(_rotated((seed + _P5 + np.uint64(8)) ^ (_rotated(values.astype(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)


class _Ids(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@dataclass
class Mark:
    """What is told of an archive, or of one task's share of it."""

    relative: str
    members: int = 0
    records: int = 0
    postings: int = 0
    checksum: int = 0
    issues: list[Issue] = field(default_factory=list)


class Postings:
    """Postings as they are found, written as one Parquet file of postings and one of terms whenever many are held."""

    def __init__(self, folder: str, terms_folder: str, name: str, digits: str):
        self.folder, self.terms_folder, self.name, self.files = folder, terms_folder, name, 0
        self.no_digit = re.compile(f"[^0-9{re.escape(digits)}]+")
        self._empty()

    def _empty(self) -> None:
        self.ids, self.found, self.counts = _Ids(), array("i"), array("i")
        self.lines, self.route_of, self.mark_of = array("q"), array("i"), array("i")
        self.routes: list[tuple[int, ...]] = []
        self.marks: list[Mark] = []

    def entries(self, text: str) -> set[bytes]:
        """Tokens of a record, each once, and its digits if they are enough."""
        if text.isascii():
            b = text.encode()
            found = set(b.translate(_WORDS).split())
            d = b.translate(None, _NO_DIGIT)
        else:
            text = text.encode("utf-8", "replace").decode()
            found = set(normalize_text(text).encode().split())
            d = self.no_digit.sub("", text)
            d = d.encode() if len(d) != 11 or d[0] != "8" else b"7" + d[1:].encode()
            if len(d.decode()) >= DIGITS:
                found.add(_MARK + d)
            return found
        if len(d) >= DIGITS:
            found.add(_MARK + (b"7" + d[1:] if len(d) == 11 and d[:1] == b"8" else d))
        return found

    def read(self, mark: Mark, path: str, share: tuple[int, int], options: ReadOptions) -> None:
        last, counted = None, None
        for row in read_archive(path, options, share):
            if row[0] == "record":
                _, _, _, route, line, text, _ = row
                entries = self.entries(text)
                if not entries:
                    continue
                if route != last or not self.routes:
                    self.routes.append(route)
                    last = route
                if route != counted:
                    mark.members += 1
                    counted = route
                if not self.marks or self.marks[-1] is not mark:
                    self.marks.append(mark)
                self.found.extend(map(self.ids.__getitem__, entries))
                self.counts.append(len(entries))
                self.lines.append(line)
                self.route_of.append(len(self.routes) - 1)
                self.mark_of.append(len(self.marks) - 1)
                if len(self.found) >= HELD:
                    self.write()
            elif row[0] == "issue":
                mark.issues.append(row[1])
            else:
                mark.records += row[1].records

    def write(self) -> None:
        """Write what is held, in order of terms, then as it was read; and add it to the archives' marks."""
        if not self.found:
            return
        terms = [(k[1:], "digits") if k[:1] == _MARK else (k, "term") for k in self.ids]  # by id; order of bytes is order of code points
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int32)
        rank[order] = np.arange(len(terms), dtype=np.int32)
        posted = rank[np.frombuffer(self.found, np.int32)]
        at = np.argsort(posted, kind="stable")
        posted = posted[at]
        record = np.repeat(np.arange(len(self.counts), dtype=np.int32), np.frombuffer(self.counts, np.int32))[at]
        line, route, mark = (np.frombuffer(a, t)[record] for a, t in ((self.lines, np.int64), (self.route_of, np.int32), (self.mark_of, np.int32)))

        crc = np.array([zlib.crc32(terms[i][1].encode() + b":" + terms[i][0]) for i in order], np.uint64)
        depth = np.array([len(r) for r in self.routes], np.int32)
        steps = np.zeros((len(self.routes), int(depth.max())), np.int32)
        for i, r in enumerate(self.routes):
            steps[i, : len(r)] = r
        h = hash_long(crc, np.full(len(crc), 42, np.uint64))[posted]
        for k in range(steps.shape[1]):
            h = np.where(depth[route] > k, hash_int(steps[route, k], h), h)
        h = hash_long(line, h)
        by = np.argsort(mark, kind="stable")
        starts = np.searchsorted(mark[by], np.arange(len(self.marks)))
        n = np.diff(np.append(starts, len(by)))
        for m, x, c in zip(self.marks, np.bitwise_xor.reduceat(h[by], starts).view(np.int64).tolist(), n.tolist()):
            m.checksum ^= x
            m.postings += c

        words = pa.array([terms[i][0].decode() for i in order], pa.string())
        kinds = pa.array([int(terms[i][1] == "term") for i in order], pa.int32())
        two = pa.array(["digits", "term"])
        name = f"part-{self.name}-{self.files:03d}.parquet"
        steps_of = pa.array(self.routes, pa.list_(pa.int32()))

        def batches() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(posted), ROW_GROUP):
                p, q = posted[i : i + ROW_GROUP], slice(i, i + ROW_GROUP)
                first, end = int(p[0]), int(p[-1]) + 1
                relative = pa.DictionaryArray.from_arrays(pa.array(mark[q]), pa.array([m.relative for m in self.marks]))
                term = pa.DictionaryArray.from_arrays(pa.array(p - first), words.slice(first, end - first))
                kind = pa.DictionaryArray.from_arrays(kinds.take(pa.array(p)), two)
                yield pa.RecordBatch.from_arrays([kind.cast(pa.string()), term.cast(pa.string()), relative.cast(pa.string()), steps_of.take(pa.array(route[q])), pa.array(line[q])], names=["kind", "term", "relative", "route", "line"])

        _write(os.path.join(self.folder, name), batches())
        _write(os.path.join(self.terms_folder, name), iter([pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(kinds, two).cast(pa.string()), words], names=["kind", "term"])]))
        self.files += 1
        self._empty()


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> None:
    """A Parquet file that is there whole or not at all, whichever attempt of a task wrote it."""
    folder, name = os.path.split(path)
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    first = next(batches)
    with pq.ParquetWriter(part, first.schema) as out:
        out.write_batch(first, row_group_size=ROW_GROUP)
        for b in batches:
            out.write_batch(b, row_group_size=ROW_GROUP)
    os.replace(part, path)


def write_part(number: int, shares: list[tuple[str, str, int, int]], folder: str, terms_folder: str, options: ReadOptions, digits: str) -> list[tuple]:
    """Write the postings of shares (relative, path, k, n) of archives; relative, members, records, postings, checksum and issues of each."""
    made, marks = Postings(folder, terms_folder, f"{number:05d}", digits), []
    for relative, path, k, n in shares:
        marks.append(Mark(relative))
        made.read(marks[-1], path, (k, n), options)
    made.write()
    return [(m.relative, m.members, m.records, m.postings, m.checksum, m.issues) for m in marks]
