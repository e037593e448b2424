"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `size` tokens. Packing looks at nothing but
how many pieces there are of each length, which is at most `size` counts
however many documents there are: gaps are filled exactly by single lengths,
pairs and triples that sum to them, as far as the counts allow; what is left
goes best-fit. The plan says which ranks of each length go where; each piece
finds its own place by its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, settle, slices, table

SIZE = 2048
#: The id that ends a document.
END = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _encoder(path: str):
    """The tokenizer's vocabulary, merges, splits and special tokens, read from its file by a library that encodes three times as fast.

    Its ids are those of the tokenizers library for every text (tests hold both
    against each other); it takes no time that grows with the square of a run.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str) -> np.ndarray:
    """Token ids of a text, as unsigned 32-bit numbers."""
    return _encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def tokenize(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids, and (part, nth), a piece's place among those of its length.

    A document is its token ids and the id that ends it (null text: empty).
    Only documents of more than `size` ids are cut: into pieces of `size`, the
    first of which is shorter where that does not come out even. ids are
    little-endian unsigned 32-bit numbers. nth counts the pieces of equal
    length within the task `part`: write the result as it is before it is read.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text", 1_000_000):
            doc, piece, start, length, blobs, nth = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(token_ids(text or "", path), np.uint32(END)).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    blobs.append(ids[a:b].tobytes())
                    nth.append(int(seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blobs, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")


@dataclass
class Plan:
    """Runs of pieces: of each length, ranks [first, first + n) go `per` to a sequence, from `sequence` on, the first at `offset`."""

    size: int
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rank, per, sequence, offset

    def put(self, pattern: list[tuple[int, int]], n: int) -> None:
        """n sequences, each of these (length, pieces of it)."""
        offset = 0
        for length, per in pattern:
            first = self.used.get(length, 0)
            self.runs.append((length, first, per, self.sequences, offset))
            self.used[length] = first + n * per
            offset += length * per
        self.sequences += n


class Sums:
    """An index of what the lengths at hand sum to, under how many there are of each.

    Single lengths are looked up by their count. pairs[s] says how many ordered
    pairs of lengths make s, and follows as lengths run out. A triple is a
    length whose complement is a pair's sum.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        self.live = (have > 0).astype(np.int64)
        self.pairs = np.convolve(self.live, self.live)[: len(have)]

    def take(self, need: dict[int, int], n: int) -> None:
        for x, k in need.items():
            self.have[x] -= n * k
            if not self.have[x]:
                self.live[x] = 0
                self.pairs[x:] -= 2 * self.live[: len(self.pairs) - x]
                if 2 * x < len(self.pairs):
                    self.pairs[2 * x] -= 1

    def fill(self, gap: int, parts: int, most: int) -> tuple[int, ...] | None:
        """Lengths at hand of at most `most`, `parts` of them, that sum to gap; the largest first."""
        have = self.have
        if parts == 1:
            return (gap,) if gap <= most and have[gap] else None
        if parts == 2:
            if not self.pairs[gap]:
                return None
            low = np.arange(max(1, gap - most), gap // 2 + 1)
            ok = (have[low] > 0) & (have[gap - low] > np.where(low == gap - low, 1, 0))
            i = np.flatnonzero(ok)
            return (int(gap - low[i[0]]), int(low[i[0]])) if len(i) else None
        first = np.arange(-(-gap // 3), min(gap - 2, most) + 1)
        for a in first[(have[first] > 0) & (self.pairs[gap - first] > 0)][::-1].tolist():
            have[a] -= 1
            rest = self.fill(gap - a, 2, a)
            have[a] += 1
            if rest:
                return (a, *rest)
        return None


def plan_packing(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Where pieces of these lengths go: exact complements of one, two and three lengths first, then best fit.

    Each step uses up one length at least or closes a gap, so its work depends
    on `size`, not on how many pieces there are.
    """
    plan = Plan(size)
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit {size}")
        have[length] = n
    if have[size]:
        plan.put([(size, 1)], int(have[size]))
        have[size] = 0
    sums = Sums(have)
    for large in range(size - 1, 0, -1):
        gap = size - large
        for parts in (1, 2, 3):
            while have[large] and gap >= parts:
                have[large] -= 1
                fill = sums.fill(gap, parts, large)
                have[large] += 1
                if not fill:
                    break
                need: dict[int, int] = {}
                for x in (large, *fill):
                    need[x] = need.get(x, 0) + 1
                n = min(int(have[x]) // k for x, k in need.items())
                plan.put(sorted(need.items(), reverse=True), n)
                sums.take(need, n)
    # best fit, the longest first: bins of equal gaps and contents are kept as one
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []

    def hold(gap: int, pattern: list[tuple[int, int]], n: int) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, n))

    for length in range(size, 0, -1):
        left = int(have[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = min(size // length, left)
                n = left // per
                hold(size - per * length, [(length, per)], n)
                left -= n * per
                continue
            gap = gaps[at]
            pattern, n = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            per = min(gap // length, left)
            used = min(n, left // per)
            if used < n:
                hold(gap, pattern, n - used)
            hold(gap - per * length, [*pattern, (length, per)], used)
            left -= used * per
    for held in bins.values():
        for pattern, n in held:
            plan.put(pattern, n)
    return plan


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to settled pieces (length, part, nth, further columns); part and nth go.

    The driver gets one count for each length. A piece's rank among those of
    its length is its place in its task after the pieces of earlier tasks.
    """
    per_part = settle(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, size)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shift = np.int64(1) << 48
    run_keys = runs[:, 0] * shift + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(run_keys, length * shift + rank, "right") - 1] if batch.num_rows else runs[:0]
            k = rank - run[:, 1]
            added = [pa.array(run[:, 3] + k // np.maximum(run[:, 2], 1)), pa.array(run[:, 4] + k % np.maximum(run[:, 2], 1) * length)]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # no broadcast: the counts grow with the tasks, and their file is far smaller than they are
    ranked = pieces.join(per_part.select("length", "part", before.alias("before")).hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    columns = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = T.StructType([*(pieces.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Packs docs (doc_id, text; other columns are ignored) into sequences of at most `size` tokens.

    Returns for each piece doc_id, piece, start, length, ids (unless with_ids
    is false), ids_crc32, sequence_id, offset. Null or empty texts are one
    piece of the end id alone; repeated rows are packed each; doc_id may be
    null; an empty table gives no rows.
    """
    pieces = tokenize(docs, size, tokenizer).withColumn("ids_crc32", F.crc32("ids"))
    return pack_pieces(settle(pieces if with_ids else pieces.drop("ids"), "pieces", few=False), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
