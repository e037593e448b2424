"""The inverted index: Parquet postings in generations, and a manifest that is written last.

Each update writes the postings of new and changed archives as one generation
per batch of archives. The table of archives says which generation holds an
archive; older postings of it are dead and go at the next compaction. A reader
takes what the manifest names, so an update that stops half-way leaves a
readable index and is taken up where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digits_of, normalize_text, normalized, token_list, tokens
from ..options import SafetyLimits, SearchOptions
from ..sources.archives import Issue, ReadOptions, discover, pack
from .postings import DIGITS, decimals, write_part

VERSION = 2
#: Archives, and bytes of them, whose postings are written, and counted as done, together.
BATCH, BATCH_BYTES = 8192, 4 << 30
#: Terms that a lookup names one by one; more are joined.
LOOKUP_TERMS = 5000
#: Bytes of text that a task of a build reads, at most.
TASK_BYTES = 16 << 20


@dataclass(frozen=True)
class IndexStatus:
    path: str
    state: str
    usable: bool
    archives: int = 0
    members: int = 0
    records: int = 0
    terms: int = 0
    postings: int = 0
    new: int = 0
    changed: int = 0
    removed: int = 0
    generations: int = 0
    bytes: int = 0


@dataclass
class Manifest:
    version: int = VERSION
    state: str = "BUILDING"
    config: str = ""
    generation: int = 0
    made: float = field(default_factory=time.time)


class IndexCorrupt(ValueError):
    pass


def default_path(root: str) -> str:
    folder = root if os.path.isdir(root) else os.path.dirname(os.path.abspath(root))
    return os.path.join(folder, "_recordscan_index")


def relative(root: str, archive: str) -> str:
    return os.path.relpath(os.path.realpath(archive), os.path.realpath(root)) if os.path.isdir(root) else os.path.basename(archive)


def fingerprint(path: str) -> tuple[str, int, int]:
    """A digest of an archive's size, time and central directory; its size; its declared bytes."""
    s = os.stat(path)
    d = hashlib.blake2b(f"{s.st_size}:{s.st_mtime_ns}".encode(), digest_size=16)
    declared = 0
    try:
        with zipfile.ZipFile(path) as z:
            for m in z.infolist():
                declared += m.file_size
                d.update(json.dumps([m.filename, m.CRC, m.compress_size, m.file_size, m.header_offset]).encode())
    except Exception:
        d.update(b"unreadable")
    return d.hexdigest(), s.st_size, declared


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """relative, archive, fingerprint, size, declared of all archives, taken by the executors."""
    listed = spark.createDataFrame([(relative(root, p), p) for p in discover(root)], "relative string, archive string").repartition(spark.sparkContext.defaultParallelism)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            marks = [fingerprint(p) for p in b.column("archive").to_pylist()]
            if marks:
                f, size, declared = zip(*marks)
                yield pa.RecordBatch.from_arrays([b.column("relative"), b.column("archive"), pa.array(f), pa.array(size, pa.int64()), pa.array(declared, pa.int64())], ["relative", "archive", "fingerprint", "size", "declared"])

    return listed.mapInArrow(run, "relative string, archive string, fingerprint string, size long, declared long")


def _config(limits: SafetyLimits) -> str:
    return replace(ReadOptions(), limits=limits).to_json()


def read_manifest(index: str) -> Manifest | None:
    try:
        with open(os.path.join(index, "manifest.json"), encoding="utf-8") as f:
            return Manifest(**json.load(f))
    except FileNotFoundError:
        return None
    except (ValueError, TypeError) as e:
        raise IndexCorrupt(f"the manifest cannot be read: {e}") from e


def _write_manifest(index: str, manifest: Manifest) -> None:
    os.makedirs(index, exist_ok=True)
    path = os.path.join(index, "manifest.json")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(asdict(manifest), f)
    os.replace(path + ".new", path)


_ROW = "relative string, fingerprint string, size long, declared long, members long, records long, postings long, checksum long"


def archives_table(spark: SparkSession, index: str, manifest: Manifest) -> DataFrame:
    """The archives that the index holds: of each one's rows up to the manifest's generation the latest, unless that says it is gone."""
    folder = os.path.join(index, "archives")
    if not os.path.isdir(folder):
        return spark.createDataFrame([], _ROW + ", generation int")
    rows = spark.read.schema(_ROW + ", generation int").parquet(folder).filter(F.col("generation") <= manifest.generation)
    latest = rows.groupBy("relative").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "relative")), "generation").alias("last"))
    return latest.select("relative", "last.*").filter("fingerprint IS NOT NULL")


_POSTINGS = "kind string, term string, relative string, route array<int>, line long"
#: Rows of a term lie together, and its members and lines in order: Parquet stores their repeats once.
_SORTED = ["term", "kind", "relative", "route", "line"]


def postings_from(records: DataFrame, exact: bool = True) -> DataFrame:
    """(term, archive, member, lines): each term's records in each member, as lists."""
    base = records.select("archive", "member", "line", normalized(F.col("text"), False, exact).alias("n"))
    return base.select("archive", "member", "line", F.explode(F.array_distinct(tokens(F.col("n")))).alias("term")).groupBy("term", "archive", "member").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def _mark(df: DataFrame) -> DataFrame:
    """Number and checksum of each archive's postings, whatever their order; a build takes the same in its tasks."""
    one = F.xxhash64(F.crc32(F.concat("kind", F.lit(":"), "term").cast("binary")), "route", "line")
    return df.groupBy("relative").agg(F.count(F.lit(1)).alias("postings"), F.bit_xor(one).alias("checksum"))


def postings(spark: SparkSession, index: str, live: DataFrame | None = None) -> DataFrame:
    """Postings that the table of archives still names."""
    manifest = read_manifest(index)
    live = live if live is not None else archives_table(spark, index, manifest)
    folder = os.path.join(index, "postings")
    if not os.path.isdir(folder):
        return spark.createDataFrame([], _POSTINGS)
    found = spark.read.schema(_POSTINGS + ", generation int").parquet(folder)
    return found.join(live.select("relative", "generation"), ["relative", "generation"], "left_semi").drop("generation")


def build_or_update(
    spark: SparkSession, root: str, index: str | None = None, limits: SafetyLimits | None = None, rebuild: bool = False, cancelled: Callable[[], bool] | None = None, progress: Callable[[int, int], None] | None = None, batch: int = BATCH, terms: bool = True
) -> tuple[IndexStatus, list[Issue]]:
    """Bring the index up to date: archives that are new or changed are read, removed ones forgotten, others left alone. terms: count the distinct ones for the status."""
    index, limits = index or default_path(root), limits or SafetyLimits()
    config = _config(limits)
    try:
        manifest = read_manifest(index)
    except IndexCorrupt:
        manifest = None
    if manifest is None or rebuild or manifest.version != VERSION or manifest.config != config:
        clean(index)
        manifest = Manifest(config=config)
    on_disk = fingerprints(spark, root).persist()
    known = archives_table(spark, index, manifest)
    gone = known.join(on_disk.select("relative"), "relative", "left_anti").select("relative")
    todo = [tuple(r) for r in on_disk.join(known, ["relative", "fingerprint"], "left_anti").select("relative", "archive", "size", "fingerprint", "declared").orderBy("relative").collect()]  # a row for each archive
    manifest = _commit(index, replace(manifest, state="BUILDING"))
    if not gone.isEmpty():
        rows = gone.select("relative", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _ROW.split(", ")[1:])))
        manifest = _add(index, manifest, rows)
    issues, done = [], 0
    for part in _batches(todo, batch):
        if cancelled and cancelled():
            break
        told = _write_postings(spark, index, manifest.generation + 1, part, ReadOptions(limits=limits))
        manifest = _add(index, manifest, spark.createDataFrame([(r, f, size, declared, *told[r][:4]) for r, _, size, f, declared in part], _ROW))
        issues += [replace(i, message=f"{a}: {i.message}") for r, a, *_ in part for i in told[r][4]]
        done += len(part)
        if progress:
            progress(done, len(todo))
    if done == len(todo):
        _commit(index, replace(manifest, state="READY"))
    on_disk.unpersist()
    return status(spark, root, index, terms), issues


def _write_postings(spark: SparkSession, index: str, generation: int, part: list[tuple], options: ReadOptions) -> dict[str, list]:
    """Write a batch's postings and terms, each archive read once; members, records, postings, checksum and issues by archive."""
    folders = [os.path.join(index, what, f"generation={generation}") for what in ("postings", "terms")]
    for folder in folders:  # what an update that stopped left there
        clean(folder)
        os.makedirs(folder)
    relative_of, digits = {a: r for r, a, *_ in part}, decimals(spark)
    parts = pack([a for _, a, *_ in part], TASK_BYTES, spark.sparkContext.defaultParallelism, {a: max(size, declared) for _, a, size, _, declared in part})
    shares = [(i, [(relative_of[p], p, k, n) for p, k, n in x.shares]) for i, x in enumerate(parts)]
    told: dict[str, list] = {r: [0, 0, 0, 0, []] for r, *_ in part}
    for marks in spark.sparkContext.parallelize(shares, len(shares)).map(lambda x: write_part(*x, *folders, options, digits)).collect():  # a row for each archive
        for r, members, records, n, checksum, issues in marks:
            t = told[r]
            told[r] = [t[0] + members, t[1] + records, t[2] + n, t[3] ^ checksum, t[4] + issues]
    return told


def _batches(todo: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Archives (relative, archive, size, ...) by `most` at once, fewer where they are large."""
    held: list[tuple] = []
    size = 0
    for a in todo:
        if held and (len(held) >= most or size + a[2] > BATCH_BYTES):
            yield held
            held, size = [], 0
        held.append(a)
        size += a[2]
    if held:
        yield held


def _write_terms(index: str, generation: int, written: DataFrame) -> None:
    """The dictionary of a generation: its distinct terms, far fewer than its postings. A build's files have those of a task each."""
    written.select("kind", "term").distinct().write.mode("overwrite").parquet(os.path.join(index, "terms", f"generation={generation}"))


def _commit(index: str, manifest: Manifest) -> Manifest:
    _write_manifest(index, manifest)
    return manifest


def _add(index: str, manifest: Manifest, rows: DataFrame) -> Manifest:
    """Write a batch's rows of the table of archives as the next generation, then name it: an update costs what has changed."""
    generation = manifest.generation + 1
    rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(index, "archives", f"generation={generation}"))
    return _commit(index, replace(manifest, generation=generation))


def coverage(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """relative, archive, state (fresh, new, changed, removed) of archives on disk and in the index."""
    disk = fingerprints(spark, root).select("relative", "archive", "fingerprint")
    both = disk.join(known.select("relative", F.col("fingerprint").alias("known")), "relative", "full_outer")
    state = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("known").isNull(), "new").when(F.col("fingerprint") == F.col("known"), "fresh").otherwise("changed")
    return both.select("relative", "archive", state.alias("state"))


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def status(spark: SparkSession, root: str, index: str | None = None, terms: bool = True, cover: DataFrame | None = None) -> IndexStatus:
    """NONE, READY, STALE, BUILDING, SCHEMA_MISMATCH or CORRUPT, and counts; usable only if READY.

    terms: count the distinct ones. cover: coverage(), where it is known.
    """
    index = index or default_path(root)
    try:
        manifest = read_manifest(index)
        if manifest is None:
            return IndexStatus(index, "NONE", False)
        if manifest.version != VERSION:
            return IndexStatus(index, "SCHEMA_MISMATCH", False)
        known = archives_table(spark, index, manifest).persist()
        counts = {r["state"]: r["n"] for r in (coverage(spark, root, known) if cover is None else cover).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = known.agg(F.count(F.lit(1)).alias("archives"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("members", "records", "postings"))).first().asDict()
        n_terms = _all_terms(spark, index).count() if terms else 0
        known.unpersist()
    except Exception as e:
        if type(e).__name__ in ("IndexCorrupt", "AnalysisException", "ParseException", "PySparkException", "SparkRuntimeException") or "parquet" in str(e).lower():
            return IndexStatus(index, "CORRUPT", False)
        raise
    stale = sum(counts.get(s, 0) for s in ("new", "changed", "removed"))
    state = "BUILDING" if manifest.state != "READY" else "STALE" if stale else "READY"
    return IndexStatus(index, state, state == "READY", **total, terms=n_terms, new=counts.get("new", 0), changed=counts.get("changed", 0), removed=counts.get("removed", 0), generations=manifest.generation, bytes=_bytes(index))


def verify(spark: SparkSession, root: str, index: str | None = None) -> IndexStatus:
    """status, after every posting was read again and its archive's checksum taken; CORRUPT if one differs."""
    found = status(spark, root, index)
    if found.state in ("NONE", "CORRUPT", "SCHEMA_MISMATCH"):
        return found
    try:
        known = archives_table(spark, found.path, read_manifest(found.path)).select("relative", "postings", "checksum")
        now = _mark(postings(spark, found.path)).select("relative", F.col("postings").alias("n"), F.col("checksum").alias("c"))
        wrong = known.join(now, "relative", "full_outer").filter((F.coalesce("postings", F.lit(0)) != F.coalesce("n", F.lit(0))) | (F.coalesce("checksum", F.lit(0)) != F.coalesce("c", F.lit(0))))
        if wrong.isEmpty():
            return found
    except Exception as e:
        if "py4j" not in type(e).__module__ and "pyspark" not in type(e).__module__:
            raise
    return replace(found, state="CORRUPT", usable=False)


def breakdown(index: str) -> list[tuple[str, int]]:
    """Bytes of each part of an index, the largest first."""
    parts = [(n, os.path.join(index, n)) for n in os.listdir(index)] if os.path.isdir(index) else []
    return sorted(((n, _bytes(p) if os.path.isdir(p) else os.path.getsize(p)) for n, p in parts), key=lambda x: (-x[1], x[0]))


def clean(index: str) -> None:
    if os.path.isdir(index):
        shutil.rmtree(index)


def compact(spark: SparkSession, index: str) -> None:
    """Write the live postings as one generation and drop the others."""
    manifest = read_manifest(index)
    if manifest is None:
        return
    known = archives_table(spark, index, manifest).persist()
    generation = manifest.generation + 1
    live = postings(spark, index, known)
    live.select(*_SORTED).repartitionByRange(*_SORTED[:4]).sortWithinPartitions(*_SORTED).write.mode("overwrite").parquet(os.path.join(index, "postings", f"generation={generation}"))
    _write_terms(index, generation, spark.read.schema(_POSTINGS).parquet(os.path.join(index, "postings", f"generation={generation}")))
    _add(index, manifest, known.drop("generation"))
    known.unpersist()
    for part in ("postings", "archives", "terms"):
        for g in os.listdir(os.path.join(index, part)):
            if g.startswith("generation=") and g != f"generation={generation}":
                shutil.rmtree(os.path.join(index, part, g), ignore_errors=True)


def lookups(options: SearchOptions) -> list[list[tuple[str, str]]] | None:
    """What each pattern must have: alternatives of conjunctions of (kind, part of a term); None if an index cannot tell.

    A record that matches a pattern has all parts of one alternative: every
    token of a literal pattern inside some term; some token of a smart pattern
    inside some term; or its digits inside a record's digits.
    """
    found: list[list[tuple[str, str]]] = []
    for p in options.patterns:
        words = token_list(p)
        if not words:
            return None
        if options.smart:
            found += [[("term", w)] for w in words]
            d = digits_of(p)
            if len(d) >= DIGITS:
                found.append([("digits", d)])
        else:
            if normalize_text(p) != " ".join(words) or any(not w.isascii() for w in words) and p != p.casefold() and not p.isascii() and len(p.casefold()) != len(p):
                return None
            found.append([("term", w) for w in dict.fromkeys(words)])
    return found


def _all_terms(spark: SparkSession, index: str) -> DataFrame:
    folder = os.path.join(index, "terms")
    return spark.read.schema("kind string, term string, generation int").parquet(folder).select("kind", "term").distinct() if os.path.isdir(folder) else spark.createDataFrame([], "kind string, term string")


def _matching_terms(spark: SparkSession, index: str, wanted: list[list[tuple[str, str]]]) -> DataFrame:
    hit = F.lit(False)
    for kind, part in sorted({x for alt in wanted for x in alt}):
        hit = hit | ((F.col("kind") == kind) & F.contains(F.col("term"), F.lit(part)))
    return _all_terms(spark, index).filter(hit)


def candidates(spark: SparkSession, index: str, options: SearchOptions, live: DataFrame | None = None, allowed: list[str] | None = None) -> DataFrame | None:
    """(relative, route, line) of records that may match; None if the index cannot tell.

    Conjunctions are taken by counting, for each record, which of its
    pattern's parts it has; nothing is joined with itself.
    """
    wanted = lookups(options)
    if wanted is None:
        return None
    post = postings(spark, index, live)
    # parts are looked for in the dictionary; postings, which are sorted by term, are then read by whole terms
    held = _matching_terms(spark, index, wanted)
    some = held.limit(LOOKUP_TERMS + 1).collect()
    if len(some) <= LOOKUP_TERMS:
        post = post.filter(F.col("term").isin(sorted({r["term"] for r in some})))
    else:
        post = post.join(held, ["kind", "term"], "left_semi")
    if allowed is not None:
        post = post.filter(F.col("relative").isin(allowed))
    hits = None
    any_part = F.lit(False)
    for kind, part in {x for alt in wanted for x in alt}:
        any_part = any_part | ((F.col("kind") == kind) & F.contains(F.col("term"), F.lit(part)))
    flags = [F.array(*(((F.col("kind") == k) & F.contains(F.col("term"), F.lit(part))) for k, part in alt)) for alt in wanted]
    rows = post.filter(any_part).select("relative", "route", "line", *(f.alias(f"alt{i}") for i, f in enumerate(flags)))
    has = [F.bool_or(F.col(f"alt{i}")[k]) for i, alt in enumerate(wanted) for k in range(len(alt))]
    got = rows.groupBy("relative", "route", "line").agg(*(h.alias(f"has{i}") for i, h in enumerate(has)))
    at = 0
    for alt in wanted:
        every = F.lit(True)
        for _ in alt:
            every = every & F.col(f"has{at}")
            at += 1
        hits = every if hits is None else hits | every
    return got.filter(hits).select("relative", "route", "line")
