"""Line deduplication with DataFrame functions only.

Lines are hashed (two independent 64-bit hashes of their key). Documents of a
key are first counted in salted groups, so that a line that a third of all
documents hold is combined before it is shuffled and never meets in one task.
The combined groups are range-partitioned by hash with a secondary sort that
puts the document to keep first; one pass over each hash's few groups then
gives its total and its first occurrence. Decisions travel back as a sparse
bitmap for each document (64 lines a word, words without a drop left out), not
as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: ASCII white space that keys are stripped of.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def split_lines(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _identity(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows with the same doc_id apart."""
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of the lines long enough to count."""
    rows = _identity(docs).select("doc_id", "version", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return rows.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_keys(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keep_doc): keys of at least min_chars code points found in at least min_docs documents, and the largest doc_id holding each."""
    first = _identity(docs).select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(split_lines(F.col("text")), lambda x: F.length(x) >= min_chars), line_key))).alias("key"))
    first = first.filter(F.length("key") >= min_chars).select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    salted = first.groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc"))
    ranged = salted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc"))
    by_hash = Window.partitionBy("h1", "h2")
    streamed = ranged.select("h1", "h2", "doc", F.row_number().over(by_hash.orderBy(F.desc_nulls_last("doc"))).alias("nth"), F.sum("n").over(by_hash).alias("docs"))
    return streamed.filter((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", F.col("doc").alias("keep_doc"))


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, version, dropped): for each document that loses lines, a sparse bitmap of them.

    dropped maps a word's index to its 64 bits: bit b of word w is set if line
    64 * w + b goes; lines of words that are left out stay.
    """
    repeated = repeated_keys(docs, min_chars, min_docs)
    gone = _lines(docs, min_chars).join(repeated, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    words = gone.groupBy("doc_id", "version", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *extra: str) -> DataFrame:
    """doc_id, kept text, n_lines, n_dropped and the extra columns of every row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).withColumn("version", F.xxhash64("text"))
    joined = rows.alias("d").join(bitmaps.alias("b"), F.expr("d.doc_id <=> b.doc_id AND d.version = b.version"), "left").select("d.doc_id", "d.text", "b.dropped", *(F.col(f"d.`{c}`") for c in extra))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT coalesce(getbit(element_at(dropped, shiftright(i, 6)), i & 63) = 1, false)), '\\n')")
    n_dropped = F.coalesce(F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x)), F.lit(0).cast("long"))
    extra_columns = [F.col(f"`{c}`") for c in extra]
    return joined.select("doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"), n_lines.cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), *extra_columns)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines kept of every row of docs (doc_id, text; other columns are ignored).

    Texts are split at \\n (null or empty: one empty line). A line's key is the
    line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least min_chars code points found in at least min_docs documents loses all
    its lines but those in the largest doc_id that holds it. Each row counts
    as a document; rows with the same doc_id all keep what that doc_id keeps,
    rows without doc_id come last. Returns doc_id, kept (the text), n_lines,
    n_dropped; a text that loses all its lines is empty. An empty table gives
    no rows.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs))


def replace_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, in their own columns, with the texts that dedup_lines keeps; n_chars, if there, follows.

    A document that loses lines and has nothing but white space left goes;
    one without text from the start stays as it is.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    keep = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)), *(["n_chars"] if "n_chars" in docs.columns else []))
    extra = [c for c in keep.columns if c not in ("doc_id", "text")]
    # a null text stays null: it is told from an empty one by a flag of its own
    out = apply_bitmaps(keep.withColumn("had_text", F.col("text").isNotNull()), drop_bitmaps(docs, min_chars, min_docs), *extra, "had_text")
    out = out.filter((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(SPACE)) != ""))
    text = F.when(F.col("had_text"), F.col("kept")).alias("text")
    made = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"own_{i}").alias(c) for i, c in enumerate(own)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(made[c] for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keep_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
