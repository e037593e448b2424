"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, rotated, and written in whole numbers of
1 / SCALE. Cosine >= c means a squared distance of at most 2 - 2c; cut into
blocks of a few coordinates, that budget is kept in proportion by at least one
block. Each block is range-joined on its own under its share: coordinates make
a grid, a vector visits the cells that its block's ball reaches, and in a cell
the distance in all of the block's coordinates decides. A pair is looked at by
the first block that lets it through. Its distance in whole numbers says with
certainty that it is linked or not, but for a narrow band around the limit;
pairs in that band are verified by the exact cosine.

Whole numbers make every block, cell and task come to the same decision, and
only they are shuffled, not the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import Merger, gathered, meetings, tiled
from .common import frugal, lean, settle, table
from .components import connected_components

#: Coordinates of a block, at most.
WIDTH = 6
#: Whole numbers in a length of one; coordinates keep within 16 bits.
SCALE = 8192
#: Coordinates of a block that make its grid: each one more deals half as many rows again and nearly halves the pairs that meet.
GRID = 2
#: Rows of a tile of a crowded cell.
TILE = 2048


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation of `dims` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims)


class Shape:
    """Blocks of vectors of some dimension, and what a cosine allows, in whole numbers."""

    def __init__(self, dims: int, cosine: float, width: int = WIDTH):
        n = max(1, -(-dims // width))
        edges = np.linspace(0, dims, n + 1).round().astype(int)
        self.dims = dims
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        self.turn = rotation(dims)
        total = math.sqrt(max(0.0, 2 - 2 * cosine)) * SCALE
        # each coordinate is off by half at most, those of a difference by one, and arithmetic by far less than the rest of it
        off = lambda d: math.sqrt(d) * 1.01 + 0.01
        self.reach = [math.ceil(total * math.sqrt((p.stop - p.start) / dims) + off(p.stop - p.start)) for p in self.parts]
        self.surely, self.hardly = (total - off(dims)) ** 2 if total > off(dims) else -1, (total + off(dims)) ** 2

    def code(self, v: np.ndarray) -> np.ndarray:
        """Vectors in whole numbers."""
        largest = np.abs(v).max(1, keepdims=True)
        v = v / largest  # so that squares neither vanish nor overflow
        return np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) @ self.turn * SCALE).astype(np.int16)

    def visits(self, code: np.ndarray, block: int, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their cells, whether home) of a block: each row's own cell, then later ones that its ball reaches."""
        p, reach = self.parts[block], self.reach[block]
        wide = 2 * reach
        places = 2 * (SCALE // wide) + 9
        x = code[:, p].astype(np.int64)[:, : min(grid, int(62 / math.log2(places)))]
        grid = x.shape[1]
        ring = x // wide
        low = x - ring * wide
        near = np.where(low < reach, -1, 1)
        apart = np.where(low < reach, low + 1, wide - low)  # to the nearest row of the next cell
        weight = places ** np.arange(grid, dtype=np.int64)
        own = ring @ weight
        yield np.arange(len(code)), own, True
        for k in range(1, 1 << grid):
            of = [j for j in range(grid) if k >> j & 1]
            away = near[:, of] @ weight[of]
            rows = np.flatnonzero((away > 0) & ((apart[:, of] ** 2).sum(1) <= reach**2))
            yield rows, own[rows] + away[rows], False


def _plain(rows: DataFrame) -> Column:
    """embedding with -0.0 as 0.0, its components float if they are so already, else double."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    return F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Vectors that can link at all, equal ones with equal labels once: rep (the smallest vec_id), dims, label, embedding, copies."""
    sound = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))") & F.expr("exists(embedding, x -> x <> 0)")
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    e = _plain(rows)
    return usable.groupBy("label", e.alias("embedding")).agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("embedding"))


def _deal(cosine: float, grid: int):
    """Codes of vectors to the cells of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims_of = batch.column("dims").to_numpy()
            for dims in np.unique(dims_of).tolist():
                own = batch.filter(pa.array(dims_of == dims))
                shape = Shape(dims, cosine)
                code = shape.code(_vectors(own.column("embedding"), dims))
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                for block in range(len(shape.parts)):
                    for rows, cell, home in shape.visits(code, block, grid):
                        take = pa.array(rows)
                        fixed = [pa.array(np.full(len(rows), block, np.int32)), pa.array(cell), pa.array(np.full(len(rows), home))]
                        yield pa.RecordBatch.from_arrays([own.column("label").take(take), own.column("dims").take(take), *fixed, own.column("rep").take(take), own.column("copies").take(take), packed.take(take)], ["label", "dims", "block", "cell", "home", "id", "copies", "code"])

    return run


_CELL = ["label", "dims", "block", "cell"]


def close_pairs(shape: Shape, block: int, x: np.ndarray, y: np.ndarray, among: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, distance) of codes that this block is the first to let through and that may be linked."""
    p = shape.parts[block]
    a, b = x[:, p].astype(np.float64), y[:, p].astype(np.float64)  # whole numbers below 2 ** 53 stay exact
    apart = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(apart <= shape.reach[block] ** 2)
    if among:
        i, j = i[i < j], j[i < j]
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))]
    for s in range(0, len(i), 50_000):
        ii, jj = i[s : s + 50_000], j[s : s + 50_000]
        square = (x[ii].astype(np.int64) - y[jj]) ** 2
        of = np.stack([square[:, q].sum(1) for q in shape.parts], 1)
        whole = of.sum(1)
        first = (of <= np.array(shape.reach) ** 2).argmax(1) == block
        ok = first & (whole <= shape.hardly)
        out.append((ii[ok], jj[ok], whole[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet(cosine: float):
    """What a cell's rows say: (0, rep, copies linked to it), (1, rep, rep) links that connect, (2, rep, rep) pairs to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[int, Shape] = {}

        def found():
            for (_, dims, block, _), homes, guests in meetings(batches, _CELL, ["id", "copies", "code"]):
                shape = shapes[dims] = shapes.get(dims) or Shape(dims, cosine)
                sides = [homes] if guests is None else [homes, guests]
                rep, copies = (np.concatenate([s[k].to_numpy() for s in sides]) for k in (0, 1))
                x, y = (np.frombuffer(b"".join(s[2].to_pylist()), np.int16).reshape(-1, dims) for s in (sides[0], sides[-1]))
                n = len(x)
                linked, merged = np.zeros(len(rep), np.int64), Merger(len(rep))
                for s in range(0, n, 512):  # blocks of about half a million pairs
                    i, j, apart = close_pairs(shape, block, x[s : s + 512], y[s:] if guests is None else y, guests is None)
                    i, j = i + s, j + (s if guests is None else n)
                    sure = apart <= shape.surely
                    if not sure.all():
                        yield {"kind": np.full((~sure).sum(), 2, np.int32), "a": rep[i[~sure]], "b": rep[j[~sure]]}
                    i, j = i[sure], j[sure]
                    np.add.at(linked, i, copies[j])
                    np.add.at(linked, j, copies[i])
                    merged.add(i, j)
                some = np.flatnonzero(linked)
                if len(some):
                    yield {"kind": np.zeros(len(some), np.int32), "a": rep[some], "b": linked[some]}
                if merged.tree:
                    u, v = np.array(merged.tree).T
                    yield {"kind": np.ones(len(u), np.int32), "a": rep[u], "b": rep[v]}

        yield from gathered(found())

    return run


def _verified(cosine: float):
    """Of pairs with both vectors, those whose cosine in double precision is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("one"), batch.column("other")):
                u, v = (np.asarray(w.values.to_numpy(zero_copy_only=False), np.float64) for w in (x, y))
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                keep.append(bool(u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine))
            yield batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def embedding_links(reps: DataFrame, cosine: float, grid: int = GRID) -> DataFrame:
    """(kind, a, b) of settled distinct vectors: kind 0, copies b linked to rep a; kind 1, links a-b that connect all linked vectors."""
    label = reps.schema["label"].dataType.simpleString()
    schema = f"label {label}, dims int, block int, cell long, home boolean, id long, copies long, code binary"
    dealt = reps.select("label", "dims", "rep", "copies", "embedding").mapInArrow(frugal(_deal(cosine, grid)), schema)
    found = settle(tiled(settle(dealt, "cells"), _CELL, TILE).mapInArrow(frugal(_meet(cosine)), "kind int, a long, b long"), "embedding-found", few=True)
    side = lambda rep, vector, copies: reps.select(F.col("rep").alias(rep), F.col("embedding").alias(vector), F.col("copies").alias(copies))
    both = found.filter("kind = 2").select("a", "b").join(side("a", "one", "copies_a"), "a").join(side("b", "other", "copies_b"), "b")
    sure = settle(both.select("a", "b", "copies_a", "copies_b", "one", "other").mapInArrow(frugal(_verified(cosine)), "a long, b long, copies_a long, copies_b long"), "embedding-verified", few=True)
    counts = [sure.select(F.lit(0).alias("kind"), F.col(x).alias("a"), F.col(f"copies_{y}").alias("b")) for x, y in ("ab", "ba")]
    return found.filter("kind < 2").unionByName(sure.select(F.lit(1).alias("kind"), "a", "b")).unionByName(counts[0]).unionByName(counts[1])


def embedding_components(rows: DataFrame, cosine: float = 0.93, grid: int = GRID) -> DataFrame:
    """Links and components of every row of rows (vec_id, embedding, label; other columns are ignored).

    Vectors are compared when their labels are equal and not null, and linked
    at a cosine of at least `cosine` in double precision. Vectors that are
    null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows without label or vec_id, nor vectors of different
    lengths. Equal vectors link like any others. Returns vec_id, n_links,
    component_id (the smallest vec_id reachable), kept. Rows that repeat a
    vec_id are rows of their own in counts. An empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    lean(rows.sparkSession)
    reps = settle(distinct_vectors(rows), "vectors", few=True)
    found = settle(embedding_links(reps, cosine, grid), "embedding-links", few=True)
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    comp = connected_components(found.filter("kind = 1").select("a", "b"))
    by_rep = reps.select("label", "embedding", "rep", "copies").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_rep = by_rep.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", _plain(rows).alias("embedding"))
    keyed = keyed.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    out = keyed.join(by_rep, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_components(table(spark, sf_dir, "embeddings"))


#: Every pair of a label, by the definition of the cosine; components by following links to the smallest vec_id.
ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), n AS (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
    SELECT vec_id, vec_id AS seen FROM embeddings
    UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), component AS (
    SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c
"""
