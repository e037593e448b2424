"""Joins of rows that lie in the same or in neighbouring cells of a grid.

A row is dealt home to its own cell, and as a visitor to those neighbouring
cells that may hold its partners and come after its own in some order, so two
rows meet at most once. The home rows and the visitors of a crowded cell are
cut into tiles, and each two tiles that must meet are a task's piece of work
of their own: none holds more than two tiles, whatever a cell holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, where nothing else is said.
TILE = 1024
#: What a row of a crowded cell is given beside its cell; `other` is -1 in cells that are not crowded, and `tile` for a tile among itself.
PLACE = ["tile", "other"]


def tiled(dealt: DataFrame, cell: list[str], rows: int = TILE) -> DataFrame:
    """dealt (cell columns, home, id, ...) with PLACE, and home as it is there; sorted by all of it, home rows first.

    rows: those of a tile. Which cells are crowded is a table of far fewer rows; whether it is
    broadcast is left to its size.
    """
    homes, guests = F.count_if(F.col("home")), F.count_if(~F.col("home"))
    crowd = dealt.groupBy(*cell).agg(homes.alias("homes"), guests.alias("guests")).filter((F.col("homes") > rows) | (F.col("homes") > 0) & (F.col("guests") > rows))
    crowd = crowd.select(*cell, F.ceil(F.col("homes") / rows).cast("int").alias("n"), F.ceil(F.col("guests") / rows).cast("int").alias("m"))
    at = """CASE WHEN n IS NULL THEN array(named_struct('tile', 0, 'other', -1, 'home', home))
        WHEN home THEN concat(transform(sequence(own, n + m - 1), j -> named_struct('tile', own, 'other', j, 'home', true)),
            transform(filter(sequence(0, own), j -> j < own), j -> named_struct('tile', j, 'other', own, 'home', false)))
        ELSE transform(sequence(0, n - 1), i -> named_struct('tile', i, 'other', n + own, 'home', false)) END"""
    own = F.expr("CAST(pmod(xxhash64(id), CASE WHEN home THEN n ELSE m END) AS INT)")
    placed = dealt.join(crowd, cell, "left").withColumn("own", own).withColumn("at", F.explode(F.expr(at)))
    placed = placed.select(*cell, "at.*", *(c for c in dealt.columns if c not in (*cell, "home")))
    return placed.repartition(*cell, *PLACE).sortWithinPartitions(*cell, *PLACE, F.desc("home"), "id")


def meetings(batches: Iterator[pa.RecordBatch], cell: list[str], columns: list[str]) -> Iterator[tuple[tuple, tuple, tuple | None]]:
    """(cell, home rows, guests or None for the home rows among themselves) of sorted rows; rows are tuples of Arrow arrays."""
    at, homes, held = None, None, []

    def closed():
        nonlocal homes
        if homes is None and held:
            homes = tuple(pa.concat_arrays(c) for c in zip(*held))
            held.clear()
            if len(homes[0]) > 1 and at[-1] in (-1, at[-2]):
                yield at[:-2], homes, None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in (*cell, *PLACE, "home")]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in keys:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            here = tuple(c[s].as_py() for c in keys[:-1])
            if here != at:
                yield from closed()
                at, homes, held = here, None, []
            part = tuple(batch.column(c).slice(s, e - s) for c in columns)
            if keys[-1][s].as_py():
                held.append(part)
                continue
            yield from closed()
            if homes is not None:
                yield at[:-2], homes, part
    yield from closed()


class Merger:
    """Joins numbers 0 ... n - 1 by links, and keeps the links that did so."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.tree: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take links in; those within what is joined already cost nothing but a look."""
        while True:
            ra, rb = self.root[a], self.root[b]
            new = ra != rb
            if not new.any():
                return
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            # one link for each larger root: it goes under the smaller one
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.tree += zip(a[first].tolist(), b[first].tolist())
            self.root[high[first]] = low[first]
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def gathered(parts: Iterator[dict[str, np.ndarray]], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small results as batches of a fair size."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(next(iter(part.values())))
        if n > rows:
            yield pa.RecordBatch.from_pydict({c: np.concatenate([p[c] for p in held]) for c in part})
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_pydict({c: np.concatenate([p[c] for p in held]) for c in held[0]})


