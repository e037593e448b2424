"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets its Hamming distances to reference fingerprints
(pivots). By the triangle inequality, distances of fingerprints within some
bits of each other differ by no more than that in every coordinate. The first
coordinates deal the fingerprints: rings of a few distances around each pivot
make cells, and a fingerprint meets those of its own and of the neighbouring
rings. Pairs of a cell whose largest coordinate difference to further pivots
is beyond the limit are discarded, and survivors are verified by the exact
distance. Crowded and sparse cells are treated alike, and of the links of a
cell those are handed on that join what was not joined before.

The pipeline's stage has limits of its own (near_links), where a pivot tells
little: two unrelated fingerprints differ by more than 11 in one of twenty
coordinates. Its candidates are fingerprints that differ by two bits or fewer
in some of their four groups of 16, and similarity of word shingles is checked
on each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cells import TILE, Merger, gathered, meetings, tiled
from .common import frugal, lean, release, settle, slices, table
from .components import connected_components

SEED = 42
WORDS = 3
#: Bits in which linked fingerprints may differ.
LIMIT = 2
#: Reference fingerprints: the first RINGS deal, the next OUTER filter whole blocks of a cell, the others what is left.
PIVOTS = np.random.default_rng(20240607).integers(0, 2**64, 64, dtype=np.uint64)
#: One pivot more that deals doubles the rows dealt and halves the pairs that meet: for each fourfold of fingerprints one more is well spent.
RINGS, OUTER = 5, 4
#: More than the numbers of rings around a pivot.
_PLACES = 40
GROUPS = 4


def fingerprint(text: bytes | None, words: int = WORDS, block: int = 65_536) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number (see the contract of linked_components)."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes: list = [xxhash.xxh64_intdigest(joined, SEED)]
        votes, n = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").astype(np.int64), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
        ends = ends[words - 1 :].tolist()
        digest, n = xxhash.xxh64_intdigest, len(starts)
        votes = np.zeros(64, np.int64)
        for i in range(0, n, block):
            h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + block], ends[i : i + block])], "<u8")
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2_000_000):
        values = batch.column("text").cast(pa.binary())
        fp = np.fromiter((fingerprint(x.as_py()) for x in values), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def distances(fp: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """The pivot distance table of fingerprints: a row each, a column for each pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def _deal(rings: int, limit: int):
    """(cell, home, id, fp): a fingerprint home in its cell, and a visitor in the later ones of those that its neighbourhood touches."""
    wide = 2 * limit  # then a neighbourhood touches two rings of each pivot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            d = distances(fp, PIVOTS[:rings]).astype(np.int64)
            ring = d // wide
            step = np.where(d % wide < limit, -1, 1)
            weight = _PLACES ** np.arange(rings, dtype=np.int64)
            own, moves = (ring + 1) @ weight, step * weight
            for k in range(1 << rings):
                away = moves[:, [j for j in range(rings) if k >> j & 1]].sum(1)
                to = np.flatnonzero(away >= 0) if k else np.arange(len(fp))
                rows = batch if not k else batch.take(pa.array(to))
                yield pa.RecordBatch.from_arrays([pa.array(own[to] + away[to]), pa.array(np.full(len(to), not k)), rows.column("doc"), rows.column("fp")], ["cell", "home", "id", "fp"])

    return run


def _meet(rings: int, limit: int):
    """Links within cells: pairs within the limit by every further pivot's coordinate, then by the exact distance."""

    def pairs(x: np.ndarray, y: np.ndarray, among: bool) -> tuple[np.ndarray, np.ndarray]:
        cx, cy = (distances(v, PIVOTS[rings:]).astype(np.int8) for v in (x, y))
        ok = np.abs(cx[:, None, 0] - cy[None, :, 0]) <= limit
        for j in range(1, OUTER):
            ok &= np.abs(cx[:, None, j] - cy[None, :, j]) <= limit
        i, j = np.nonzero(ok)
        if among:
            i, j = i[i < j], j[i < j]
        keep = np.abs(cx[i, OUTER:] - cy[j, OUTER:]).max(1, initial=0) <= limit
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(x[i] ^ y[j]) <= limit
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for _, homes, others in meetings(batches, ["cell"], ["id", "fp"]):
                sides = [homes] if others is None else [homes, others]
                doc, fp = (np.concatenate([s[k].to_numpy() for s in sides]) for k in (0, 1))
                fp, n = fp.view(np.uint64), len(homes[0])
                merged = Merger(len(fp))
                for s in range(0, n, 512):  # blocks of about a million pairs
                    i, j = pairs(fp[s : min(n, s + 512)], fp[s:n] if others is None else fp[n:], others is None)
                    merged.add(i + s, j + (s if others is None else n))
                if merged.tree:
                    a, b = np.array(merged.tree).T
                    yield {"a": doc[a], "b": doc[b]}

        yield from gathered(links())

    return run


def simhash_links(fps: DataFrame, limit: int = LIMIT, rings: int = RINGS) -> DataFrame:
    """Links (a, b) between documents that suffice to connect all fingerprints within the limit.

    fps: (fp long, doc long), each fp once, doc the document that stands for
    it. rings, at most 11: how many pivots deal.
    """
    dealt = fps.mapInArrow(frugal(_deal(rings, limit)), "cell long, home boolean, id long, fp long")
    return settle(tiled(dealt, ["cell"], TILE).mapInArrow(frugal(_meet(rings, limit)), "a long, b long"), "simhash-links", few=True)


def linked_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of docs (doc_id, text; other columns are ignored).

    Texts are lower-cased (A-Z), split at ASCII white space into words, and
    hashed by three-word shingles with repeats; fewer words make one shingle,
    none (null, empty or blank texts) fingerprint zero, which links like any
    other. Fingerprints within LIMIT bits are linked. component_id is the
    smallest doc_id reachable. Rows that repeat a doc_id count as one document
    with several fingerprints; rows without doc_id link with nothing and get
    no component. An empty table gives no rows.
    """
    lean(docs.sparkSession)
    fps = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(_fingerprints), "doc_id long, fp long"), "fingerprints")
    nodes = settle(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes", few=True)
    links = simhash_links(nodes)
    same = fps.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    repeats = fps.join(same, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    comp = connected_components(links.unionByName(repeats))
    by_fp = nodes.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    out = fps.join(by_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return linked_components(table(spark, sf_dir, "documents"))


#: The stage's contract: word shingles that similarity is measured on, and the similarity of near-duplicates.
NEAR_WORDS, NEAR = 5, 0.8
#: The stage's candidates: words of their fingerprints' shingles, and bits in which they may differ: 3 * GROUPS - 1, what shared points of a group reach.
NEAR_FP_WORDS, NEAR_LIMIT = 3, 3 * GROUPS - 1
#: Close pairs for each member of a bucket beyond which it is connected in rounds.
CROWDED = 2
_ROW = "tbl int, key int, fp long, node long, doc long"
_PAIR = "a long, b long, doc_a long, doc_b long"
_AROUND = np.concatenate([[0], 1 << np.arange(16)])


def shingles(text: bytes | None, words: int = NEAR_WORDS) -> np.ndarray:
    """The set of a text's word shingles, as sorted 64-bit digests; fewer words make one shingle, none an empty set."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts)))


#: Buckets of a text's sketch, and the count from which one is no longer known.
SKETCH, FULL = 128, 255


def sketch(text: bytes | None) -> np.ndarray:
    """How many of a text's shingles fall into each of SKETCH buckets."""
    return np.minimum(np.bincount(shingles(text) % SKETCH, minlength=SKETCH), FULL).astype(np.uint8)


def _nodes(words: int):
    """(doc_id, fp, node, sketch) of documents; node is the digest of a text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
            fp = np.fromiter((fingerprint(x, words) for x in texts), np.uint64, len(texts))
            node = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(x.lower().split())) for x in texts), np.uint64, len(texts))
            held = pa.array([sketch(x).tobytes() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), held], ["doc_id", "fp", "node", "sketch"])

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2_000_000):
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
        node = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(x.lower().split())) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([shingles(x).tobytes() for x in texts], pa.binary())], ["node", "set"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those with a Jaccard similarity of NEAR."""
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (one, other))
            shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= NEAR * max(len(x), len(y)) else 0
            keep.append(shared > 0 and shared >= NEAR * (len(x) + len(y) - shared))
        yield batch.select(["doc_a", "doc_b"]).filter(pa.array(keep, pa.bool_()))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table, point, ...) of each fingerprint: for each group of 16 bits, the points within one bit.

    Two fingerprints within NEAR_LIMIT bits differ in two bits or fewer in some
    group, and there share such a point.
    """
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        coords = _coordinates(fp)
        for g in range(GROUPS):
            for around in _AROUND:
                n = len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array((coords[:, g] ^ around).astype(np.int32)), *(batch.column(c) for c in ("fp", "node", "doc"))], ["tbl", "key", "fp", "node", "doc"])


def _coordinates(fp: np.ndarray) -> np.ndarray:
    """A row for each fingerprint: its GROUPS numbers of 16 bits."""
    return (fp[:, None] >> (np.arange(GROUPS, dtype=np.uint64) * np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


def _owned(x: np.ndarray, y: np.ndarray, tbl: int, key: int) -> np.ndarray:
    """Whether (tbl, key) is the first point that the fingerprints x and y of close pairs share."""
    a, b = _coordinates(x), _coordinates(y)
    first = (np.bitwise_count(a ^ b) <= 2).argmax(1)
    a, b = (v[np.arange(len(v)), first] for v in (a, b))
    low = (a ^ b) & -(a ^ b)
    point = np.where(np.bitwise_count(a ^ b) == 2, np.minimum(a ^ low, b ^ low), np.minimum(a, b))
    return (first == tbl) & (point == key)


def _close(fp: np.ndarray, tbl: int, key: int, rows: np.ndarray, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that a bucket owns, of one of the given rows with a later one or one that is not given, between components if there are any."""
    given = np.full(len(fp), False)
    given[rows] = True
    step = max(1, 150_000 // len(fp))  # as many pairs at once
    for s in range(0, len(rows), step):
        r = rows[s : s + step]
        i, j = np.nonzero(np.bitwise_count(fp[r][:, None] ^ fp[None, :]) <= NEAR_LIMIT)
        i = r[i]
        ok = (j > i) | ~given[j]
        if comp is not None:
            ok &= comp[i] != comp[j]
        i, j = i[ok], j[ok]
        ok = _owned(fp[i], fp[j], tbl, key)
        yield i[ok], j[ok]


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The buckets of sorted rows that hold two rows or more."""
    held: list[list[np.ndarray]] = []
    at = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not batch.num_rows:
            continue
        at_each = rows[0].astype(np.int64) << 32 | rows[1]
        edges = [0, *(np.flatnonzero(at_each[1:] != at_each[:-1]) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if at != at_each[lo]:
                if sum(len(h[0]) for h in held) > 1:
                    yield [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else held[0]
                held, at = [], at_each[lo]
            held.append([c[lo:hi] for c in rows])
    if sum(len(h[0]) for h in held) > 1:
        yield [np.concatenate(c) for c in zip(*held)]


def _found(kind: int, tbl, key, fp, node, doc, i: np.ndarray, j: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Rows i of a bucket themselves (kind 1), or pairs of its rows i and j (kind 0: all there are, kind 2: some)."""
    other = i if j is None else j
    return {"kind": np.full(len(i), kind, np.int32), "tbl": tbl[i], "key": key[i], "fp": fp[i], "a": node[i], "b": node[other], "doc_a": doc[i], "doc_b": doc[other]}


_FOUND = "kind int, tbl int, key int, fp long, a long, b long, doc_a long, doc_b long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close pairs of each bucket; of a crowded one its rows, and some close pairs."""

    def each():
        for tbl, key, fp, node, doc in _buckets(batches, ["tbl", "key", "fp", "node", "doc"]):
            u = fp.view(np.uint64)
            pairs, n = [], 0
            for i, j in _close(u, tbl[0], key[0], np.arange(len(u))):
                pairs.append((i, j))
                n += len(i)
                if n > CROWDED * len(u):
                    break
            if n > CROWDED * len(u):
                yield _found(1, tbl, key, fp, node, doc, np.arange(len(u)))
                mates = np.zeros(len(u), np.int64)
                for d in range(1, min(16, len(u))):
                    i = np.flatnonzero((np.bitwise_count(u[:-d] ^ u[d:]) <= NEAR_LIMIT) & (mates[:-d] < 1))
                    mates[i] += 1
                    yield _found(2, tbl, key, fp, node, doc, i, i + d)
            elif n:
                yield _found(0, tbl, key, fp, node, doc, *(np.concatenate(x) for x in zip(*pairs)))

    yield from gathered(each())


def _may_be_similar(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether texts can have a similarity of NEAR: in a bucket they share no more shingles than the one with fewer has."""
    out = [np.zeros(0, bool)]
    full = (sketches == FULL).any(1)  # counts that are no longer known say nothing
    size = sketches.sum(1, dtype=np.int64)
    for s in range(0, len(i), 20_000):
        ii, jj = i[s : s + 20_000], j[s : s + 20_000]
        shared = np.minimum(sketches[ii], sketches[jj]).sum(1, dtype=np.int64)
        out.append(full[ii] | full[jj] | (shared >= NEAR * (size[ii] + size[jj] - shared)))
    return np.concatenate(out)


def _between(whole: bool):
    """Close pairs of crowded buckets between components that may be similar: all, or for each row outside the bucket's largest component some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for tbl, key, fp, node, doc, comp, held in _buckets(batches, ["tbl", "key", "fp", "node", "doc", "comp", "sketch"]):
                u = fp.view(np.uint64)
                of = np.frombuffer(b"".join(held), np.uint8).reshape(-1, SKETCH)
                kinds, place, n = np.unique(comp, return_inverse=True, return_counts=True)
                out = np.flatnonzero(place != n.argmax())
                if whole:
                    for i, j in _close(u, tbl[0], key[0], out, comp):
                        ok = _may_be_similar(of, i, j)
                        yield _found(0, tbl, key, fp, node, doc, i[ok], j[ok])
                    continue
                mates = np.zeros(len(u), np.int64)
                for d in range(1, min(64, len(u))):
                    to = (out + d) % len(u)
                    ok = (np.bitwise_count(u[out] ^ u[to]) <= NEAR_LIMIT) & (comp[out] != comp[to]) & (mates[out] < 2)
                    i, j = out[ok], to[ok]
                    ok = _may_be_similar(of, i, j)
                    mates[i[ok]] += 1
                    yield _found(2, tbl, key, fp, node, doc, i[ok], j[ok])

        yield from gathered(each())

    return run


def near_links(docs: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) between documents that connect all near-duplicates among the candidates.

    docs: (doc_id long, text); nodes: (node long, fp long, doc long), a row for
    each text; sketches: (node long, sketch binary). Candidates are texts whose fingerprints are within NEAR_LIMIT
    bits; near-duplicates are those with a Jaccard similarity of NEAR or more
    in shingles of NEAR_WORDS words. Buckets in which very many are close are
    not paired at once: some pairs are tried first, then all those between
    components that have not met. There, a bound on the similarity from counts
    of shingles discards pairs before their shingles are fetched.
    """

    def tried(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.select("a", "b", "doc_a", "doc_b"), "near-pairs", few=True)
        needed = pairs.select(F.col("doc_a").alias("doc_id")).unionByName(pairs.select(F.col("doc_b").alias("doc_id"))).distinct()
        sets = settle(docs.join(needed, "doc_id", "left_semi").select("text").mapInArrow(frugal(_shingle_sets), "node long, set binary").dropDuplicates(["node"]), "near-sets", few=True)
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        links = settle(both.mapInArrow(frugal(_similar), "doc_a long, doc_b long"), "near-links", few=True, drop=sets)
        release(pairs)
        return links

    def some(found: DataFrame) -> DataFrame:
        """Of the pairs of kind 2, at most two for each text: others are tried in later rounds, if they are still needed."""
        pairs = found.filter("kind = 2").select("a", "b", "doc_a", "doc_b").distinct()
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))
        return pairs.withColumn("rank", rank).filter("rank <= 2").drop("rank")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp", "node")

    found = settle(dealt(nodes.select("fp", "node", "doc").mapInArrow(frugal(_points), _ROW)).mapInArrow(frugal(_candidates), _FOUND), "near-found", few=True)
    links = tried(found.filter("kind = 0").unionByName(some(found), allowMissingColumns=True))
    crowded = found.filter("kind = 1").select("tbl", "key", "fp", F.col("a").alias("node"), F.col("doc_a").alias("doc"))
    if crowded.isEmpty():
        return links
    crowded = crowded.join(sketches.join(crowded.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node")
    for whole in (False, False, True):
        comp = connected_components(links).select(F.col("node").alias("doc"), "component")
        rows = crowded.join(comp, "doc", "left").select("tbl", "key", "fp", "node", "doc", F.coalesce("component", "doc").alias("comp"), "sketch")
        more = settle(dealt(rows).mapInArrow(frugal(_between(whole)), _FOUND), "near-found", few=True)
        links = links.unionByName(tried(more if whole else some(more)))
    return links


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of docs (doc_id, text) by near-duplicates as in near_links.

    Texts with the same words are near-duplicates of each other, also those
    without any. component_id is the smallest doc_id reachable. Rows that
    repeat a doc_id count as one document; rows without doc_id link with
    nothing and get no component. An empty table gives no rows. op5's query
    has the narrower contract of linked_components.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fps = settle(docs.mapInArrow(frugal(_nodes(NEAR_FP_WORDS)), "doc_id long, fp long, node long, sketch binary"), "near-fingerprints")
    nodes = settle(fps.filter("doc_id IS NOT NULL").groupBy("node", "fp").agg(F.min("doc_id").alias("doc")), "near-nodes", few=True)
    same = fps.join(nodes, ["node", "fp"]).filter("doc_id <> doc").select(F.col("doc_id").alias("doc_a"), F.col("doc").alias("doc_b"))
    comp = connected_components(near_links(docs, nodes, fps.select("node", "sketch")).unionByName(same)).withColumnRenamed("node", "doc_id")
    out = fps.join(comp, "doc_id", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; rows without doc_id stay."""
    gone = simhash_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
