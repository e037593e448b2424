"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, lean, slices, table

#: N-grams of a profile and of a document that are ranked, and the longest n-gram.
RANKS = 400
LONGEST = 3
#: A code point takes this many bits of an n-gram's number; 1 stands for a word's edge, 0 for none.
_BITS = 21
#: Distinct words that a task counts before it hands n-gram counts on.
HELD_WORDS = 40_000
UNKNOWN = "und"
_CODES = 0x110000


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(_CODES)), bool, _CODES)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 1 for what is between words (and at both ends), and the text of each."""
    arrays = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays)) + 2
    code = np.ones(int(sizes.sum()), np.int64)
    at = 1
    for a in arrays:
        code[at : at + len(a)] = a
        at += len(a) + 2
    code[~_letters()[code]] = 1
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(code), bool)  # one edge between words, and one at each end
    keep[1:] = (code[1:] != 1) | (code[:-1] != 1) | (doc[1:] != doc[:-1])
    return code[keep], doc[keep]


def _grams(code: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all n-grams of up to three characters within words padded by their edges, and the text of each."""
    edge = 1
    one = code != edge
    two = (doc[1:] == doc[:-1]) & ((code[1:] != edge) | (code[:-1] != edge))
    three = (doc[2:] == doc[:-2]) & (code[1:-1] != edge)
    grams = [(code << 2 * bits)[one], ((code[:-1] << 2 * bits) | (code[1:] << bits))[two], ((code[:-2] << 2 * bits) | (code[1:-1] << bits) | code[2:])[three]]
    return np.concatenate(grams), np.concatenate([doc[one], doc[:-1][two], doc[:-2][three]])


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): texts are counted by word first, then the n-grams of each distinct word."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            code, word = _codes(list(words))
            gram, word = _grams(code, word, _BITS)
            weight = np.fromiter(words.values(), np.int64, len(words))[word]
            gram, where = np.unique(gram, return_inverse=True)
            n = np.bincount(where, weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    import re

    split = re.compile(r"[^\W\d_]+").findall
    for batch in slices(batches, "text", 1_000_000):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(split((text or "").lower()))
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from out()
    yield from out()


def learn_profiles(labelled: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """The `ranks` most frequent n-grams of each language of labelled (lang, text), the most frequent first.

    Counts cover all rows; rows without lang or text teach nothing. What
    reaches the driver is `ranks` numbers for each language.
    """
    counted = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(frugal(_count_by_language), "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", rank).filter(F.col("rank") <= ranks)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _distances(texts: list[str], known: np.ndarray, ranks_of: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text to each profile, and how many of its n-grams were ranked."""
    code, doc = _codes(texts)
    distance = np.zeros((len(texts), ranks_of.shape[1]), np.int64)
    ranked = np.zeros(len(texts), np.int64)
    # a dense alphabet, in order of the code points, keeps a text's number and an n-gram in 63 bits
    seen = np.zeros(_CODES, bool)
    seen[code] = True
    alphabet = np.flatnonzero(np.concatenate([[True], seen[1:]]))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    dense = np.zeros(_CODES, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    per = 1 << max(0, min(24, 63 - 3 * bits))
    for first in range(0, len(texts), per):
        a, b = np.searchsorted(doc, [first, first + per])
        if 3 * bits > 62 and b > a:  # an alphabet too large even for one text beside it
            gram, of = _grams(dense[code[a:b]], np.zeros(b - a, np.int64), bits)
        else:
            gram, of = _grams(dense[code[a:b]], doc[a:b] - first, bits)
        if not len(gram):
            continue
        both = np.sort((of << 3 * bits) | gram) if per > 1 else np.sort(gram)
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n = np.diff(np.append(new, len(both)))
        both = both[new]
        of = both >> 3 * bits if per > 1 else np.zeros(len(both), np.int64)
        gram = both & ((1 << 3 * bits) - 1)
        # by text, then the most frequent first, then by n-gram: the order of `both` breaks ties
        order = np.argsort(of * (1 << 40) - n, kind="stable")
        of, gram = of[order], gram[order]
        begin = np.searchsorted(of, np.arange(of[-1] + 1))
        rank = np.arange(len(of)) - begin[of]
        top = rank < ranks
        of, gram, rank = of[top], gram[top], rank[top]
        mask = (1 << bits) - 1
        full = (alphabet[gram >> 2 * bits] << 2 * _BITS) | (alphabet[(gram >> bits) & mask] << _BITS) | alphabet[gram & mask]
        at = np.minimum(np.searchsorted(known, full), max(len(known) - 1, 0))
        there = known[at] == full if len(known) else np.zeros(len(full), bool)
        for k in range(ranks_of.shape[1]):
            place = np.where(there, ranks_of[at, k] if len(known) else ranks, ranks)
            apart = np.where(place < ranks, np.abs(place - rank), ranks)
            distance[first : first + int(of.max()) + 1, k] += np.bincount(of, apart).astype(np.int64)
        ranked[first : first + int(of.max()) + 1] += np.bincount(of)
    return distance, ranked


def identify(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS, margin: bool = False) -> DataFrame:
    """Adds lang_pred and score to docs (text, other columns), from nothing but each whole text.

    lang_pred is the language whose profile is nearest by out-of-place
    distance, ties going to the name that sorts first; 'und' if the text is
    null or has no letter, or if no profile was learned. score is 1 less the
    share of the largest possible distance (0 for 'und'). margin, if asked
    for, is by how much of it the next language is further away (that of the
    only language: 1). docs must have no columns of these names.
    """
    for c in ("lang_pred", "score", *(["margin"] if margin else [])):
        if c in docs.columns:
            raise ValueError(f"docs has a column {c} of its own")
    names = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    ranks_of = np.full((len(known), len(names)), ranks, np.int64)
    for k, name in enumerate(names):
        ranks_of[np.searchsorted(known, np.array(profiles[name], np.int64)), k] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 400_000):
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            if names:
                distance, ranked = _distances(texts, known, ranks_of, ranks)
                best = distance.argmin(1)
                score = np.where(ranked > 0, 1 - distance[np.arange(len(texts)), best] / np.maximum(ranked * ranks, 1), 0.0)
                lang = [names[b] if r else UNKNOWN for b, r in zip(best.tolist(), ranked.tolist())]
                full = np.maximum(ranked * ranks, 1)
                apart = np.diff(np.sort(distance, 1)[:, :2], axis=1)[:, 0] / full if len(names) > 1 else (ranked > 0).astype(float)
            else:
                lang, score, apart = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            added = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())} | ({"margin": pa.array(apart, pa.float64())} if margin else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("margin", T.DoubleType())] if margin else [])]
    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *more]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text leaves 1 by 3; false without doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


#: Steps of a margin in which right and wrong predictions are counted.
STEPS = 1000


def learn_margin(counts: list[tuple[int, int, int]]) -> float:
    """The margin up to which predictions are no better than a coin, from (step, right, wrong) of labelled texts that were held out.

    The share that is right is fitted as one that does not fall with the
    margin (neighbouring steps are pooled where it does).
    """
    pools: list[list[int]] = []  # last step, right, wrong
    for step, right, wrong in sorted(counts):
        pools.append([step, right, wrong])
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            step, right, wrong = pools.pop()
            pools[-1] = [step, pools[-1][1] + right, pools[-1][2] + wrong]
    return max((step + 1 for step, right, wrong in pools if wrong >= right), default=0) / STEPS


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs whose language is identified, in their own columns.

    Profiles are learned from labelled rows that are not held out (held_out,
    by doc_id). Those that are tell how far one language must be nearer than
    the next: the rejected texts are those without a letter and those whose
    margin is so small that held-out predictions are wrong at least as often
    as right (learn_margin). Where no row has a lang, nothing can be learned and
    only texts without a letter go.
    """
    lean(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*own, *(F.col(f"`{c}`").alias(c) for c in ("doc_id", "text", "lang")))
    rest = [f"own_{i}" for i in range(len(own)) if docs.columns[i] != "text"]
    profiles = learn_profiles(plain.filter(~held_out()).select("lang", "text"))
    if not profiles:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    tried = identify(plain.filter(held_out() & F.col("lang").isNotNull()).select("lang", "text"), profiles, margin=True).filter(F.col("lang_pred") != UNKNOWN)
    right = (F.col("lang") == F.col("lang_pred")).cast("long")
    counts = tried.groupBy(F.floor(F.col("margin") * STEPS).alias("step")).agg(F.sum(right).alias("good"), F.sum(1 - right).alias("bad")).collect()
    bound = learn_margin([tuple(r) for r in counts])
    found = identify(plain.select("text", *rest), profiles, margin=True)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= bound))
    return kept.select(*((F.col("text") if c == "text" else F.col(f"own_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


#: The same by the definition of profiles and distance; chr(1) stands for a word's edge, and the digest is taken bit by bit.
ORACLE = r"""
WITH docs AS (
    SELECT doc_id, lang, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) % 3 = 1 AS held_out
    FROM documents
), words AS (
    SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w FROM docs) GROUP BY doc_id, w
), grams AS (
    SELECT doc_id, g, sum(k) AS n FROM (
        SELECT doc_id, k, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_concat(
            list_transform(range(1, length(w) + 2), lambda i: substr(chr(1) || w || chr(1), i, 2)), list_transform(range(1, length(w) + 1), lambda i: substr(chr(1) || w || chr(1), i, 3))))) AS g FROM words
    ) GROUP BY doc_id, g
), profile AS (
    SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS r FROM (
        SELECT lang, g, sum(n) AS n FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g)) WHERE r < 400
), ranked AS (
    SELECT doc_id, g, r FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM grams) WHERE r < 400
), apart AS (
    SELECT x.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 400 ELSE abs(p.r - x.r) END) AS distance, count(*) AS n
    FROM ranked x CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = x.g GROUP BY x.doc_id, l.lang
), best AS (
    SELECT doc_id, lang, 1 - distance / CAST(n * 400 AS DOUBLE) AS score FROM apart QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1
)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0.0) AS score FROM docs d LEFT JOIN best b USING (doc_id)
"""
