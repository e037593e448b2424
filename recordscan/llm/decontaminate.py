"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items make one suffix automaton (items are
kept apart by restarting at its root). Document words are streamed through it,
the longest match that ends at each word is tracked, and what reaches a
window's length is a hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, lean, slices, table

WINDOW = 8
#: Item words of one automaton (about 150 MB); larger benchmarks are cut into blocks of items, which many texts meet one after the other.
BLOCK_WORDS, MANY_BYTES = 200_000, 32 << 20
#: Bytes to spaces where they part words, A-Z to a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of some word sequences, and which windows of `window` words each item has."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: state of a window's last word -> the items that have this window
        self.full: dict[int, set] = {}
        #: state of a whole item shorter than a window -> its length and items
        self.short: dict[int, tuple[int, set]] = {}
        self.shortest = min((min(window, len(seq)) for _, seq in coded), default=0)
        pairs = set()
        for item, seq in coded:
            pairs.update(zip(seq, seq[1:]))
            state, n = 0, 0
            for i, w in enumerate(seq):
                state, n = self.step(state, n, w)
                if i + 1 >= window:
                    self.full.setdefault(self.at_length(state, window), set()).add(item)
            if len(seq) < window:
                s = self.at_length(state, len(seq))
                self.short.setdefault(s, (len(seq), set()))[1].add(item)
        size = len(self.vocabulary) + 1
        self.pairs = np.sort(np.fromiter((a * size + b for a, b in pairs), np.int64, len(pairs)))
        # the nearest state at or above each one, by suffix links, that ends a short item
        self.marked = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.short else self.marked[self.link[s]] if s else -1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # another item has got here
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and the length of the longest match that ends at the next word."""
        after = self.next[state].get(w)
        while after is None:
            state = self.link[state]
            if state == -1:
                return 0, 0
            n = self.length[state]
            after = self.next[state].get(w)
        return after, n + 1

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n words of what has led to `state`."""
        while self.length[self.link[state]] >= n and self.link[state] > 0:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words inside an occurring window, and the items of these windows."""
        if not self.shortest:
            return [], set()
        size = len(self.vocabulary) + 1
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # A match of `shortest` words needs as many known words, each pair of neighbours known too: only such runs are streamed
        if self.shortest > 1:
            known = np.zeros(len(ids) + 1, bool)
            i = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 else np.zeros(0, np.int64)
            if len(i):
                code = ids[i] * size + ids[i + 1]
                at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                known[i[self.pairs[at] == code] + 1] = True  # word i+1 goes on from word i
            edges = np.flatnonzero(np.diff(np.concatenate([[False], known[1:]]).astype(np.int8), append=0)) if known.any() else np.zeros(0, np.int64)
            runs = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= self.shortest]
        else:
            runs = [(0, len(ids))]
        spans: list[tuple[int, int]] = []
        items: set = set()

        def add(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                s, e = spans.pop()
                start, end = min(s, start), max(e, end)
            spans.append((start, end))

        for start, end in runs:
            state, n = 0, 0
            for i in range(start, end):
                w = int(ids[i])
                if w < 0:
                    state, n = 0, 0
                    continue
                state, n = self.step(state, n, w)
                if n >= self.window:
                    items |= self.full[self.at_length(state, self.window)]
                    add(i + 1 - self.window, i + 1)
                m = self.marked[state]
                while m > 0:
                    if self.short[m][0] <= n:
                        items |= self.short[m][1]
                        add(i + 1 - self.short[m][0], i + 1)
                    m = self.marked[self.link[m]]
        return spans, items


def _blocks(benchmark: DataFrame, block_words: int) -> list:
    """The items in blocks of bounded size, each a broadcast variable."""
    sc = benchmark.sparkSession.sparkContext
    blocks, held, n = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        if held and n + len(words) > block_words:
            blocks.append(sc.broadcast(held))
            held, n = [], 0
        held.append((row["item_id"], words))
        n += len(words)
    return [*blocks, sc.broadcast(held)] if held else blocks


#: The automaton that a worker has made last, for the tasks that follow: of which search, of which block.
_made: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(search: str, k: int, items, window: int) -> SuffixAutomaton:
    if (search, k) not in _made:
        _made.clear()  # one at a time
        _made[search, k] = SuffixAutomaton(items.value, window)
    return _made[search, k]


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _searcher(benchmark: DataFrame, window: int, block_words: int):
    """A function that gives of Arrow batches slices with each text's words, merged spans of hit words, and items."""
    blocks, search = _blocks(benchmark, block_words), uuid.uuid4().hex

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
        # several blocks: an automaton is made once for many texts
        for batch in slices(batches, "text", 1_000_000) if len(blocks) < 2 else _together(batches, MANY_BYTES):
            split = [words_of(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            spans: list[list] = [[] for _ in split]
            items: list[set] = [set() for _ in split]
            for k in range(len(blocks)):
                a = _automaton(search, k, blocks[k], window)
                for i, words in enumerate(split):
                    s, t = a.matches(words)
                    spans[i] += s
                    items[i] |= t
            yield batch, split, [_merged(s) for s in spans], items

    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of docs (text, other columns) with what it shares with the benchmark.

    Adds to the columns of docs n_words, n_hit (words inside an occurring
    window), hit_spans (word spans from, to), hit_items (as sorted strings);
    docs must have no columns of these names. Windows are `window` consecutive
    words of an item, or all words of an item that has fewer, but some. Null
    or empty texts have no words; an empty benchmark hits nothing; a repeated
    item counts once for each item_id, items without item_id as one item named
    "null". The benchmark is streamed through the driver and broadcast in
    blocks of at most block_words words (or one item); a worker holds the
    automaton of one block.
    """
    if own := {"n_words", "n_hit", "hit_spans", "hit_items"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(own)} of its own")
    lean(docs.sparkSession)
    found = _searcher(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch, split, spans, items in found(batches):
            added = {
                "n_words": pa.array([len(w) for w in split], pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                "hit_spans": pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], pair),
                "hit_items": pa.array([sorted("null" if x is None else str(x) for x in t) for t in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    spans_type = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", spans_type), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(frugal(run), schema)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = (text or "").encode()
    folded = raw.translate(_FOLD)
    out, at, pos, nth = [], 0, 0, 0
    # the byte place of each span's ends, by walking the words once
    wanted = iter(spans)
    span = next(wanted, None)
    start = 0
    for w in folded.split():
        if span is None:
            break
        pos = folded.index(w, pos)
        if nth == span[0]:
            start = pos
        pos += len(w)
        nth += 1
        if nth == span[1]:
            out.append(raw[at:start])
            at = pos
            span = next(wanted, None)
    out.append(raw[at:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_items: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what they share with the benchmark, in the columns of docs, in one pass over them.

    Documents that hold windows of more than max_items items, or of which more
    than max_coverage of the words are hit, go; from the others, the hit spans
    are cut, and n_chars, if there, follows. Documents without a hit stay as
    they are. Items and windows are as in find_contamination.
    """
    lean(docs.sparkSession)
    found = _searcher(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, split, spans, items in found(batches):
            keep = [len(t) <= max_items and sum(b - a for a, b in s) <= max_coverage * len(w) for w, s, t in zip(split, spans, items)]
            texts = batch.column("text")
            if any(s and k for s, k in zip(spans, keep)):
                cut = [cut_spans(t.as_py(), s) if s and k else t.as_py() for t, s, k in zip(texts, spans, keep)]
                columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(cut, texts.type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(c) if s and k else n for c, s, k, n in zip(cut, spans, keep, columns["n_chars"].to_pylist())], columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.size("hit_items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


#: Windows and words by their definition: an equality join of all document windows of the lengths that items have.
ORACLE = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[k:k + least(len(w), 8) - 1], ' ') AS said
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM bw WHERE len(w) > 0)
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), hits AS (
    SELECT p.doc_id, p.i, x.n, x.item_id FROM (SELECT DISTINCT n FROM windows) s
    JOIN places p ON p.i + s.n - 1 <= len(p.w)
    JOIN windows x ON x.n = s.n AND x.said = array_to_string(p.w[p.i:p.i + s.n - 1], ' ')
), words AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
