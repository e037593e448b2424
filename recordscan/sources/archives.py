"""ZIP archives as a Spark data source.

Archives are listed on the driver; partitions are packed by size, and a large
archive is dealt to several by the places of its members. Tasks read members
in place and emit Arrow batches of records, issues and counts.
"""

from __future__ import annotations

import atexit
import json
import os
import stat
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import is_excluded, is_unsafe, is_wanted, suffix_of
from ..options import ConfigurationError, SafetyLimits
from ..schema import MEMBER, TAGGED
from .decoders import decoder, seekable

#: Bytes of archives that make a partition, at most and at least; an archive of more than twice that is dealt by its members.
PARTITION_BYTES, LEAST_BYTES = 32 << 20, 256 << 10
BATCH = 4096
BATCH_CHARS = 4 << 20


@dataclass(frozen=True)
class Issue:
    message: str
    member: str | None = None
    kind: str = "warning"


@dataclass(frozen=True)
class ReadOptions:
    """Which members of which archives are read, and how."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    encoding: str = "auto"
    limits: SafetyLimits = SafetyLimits()

    @staticmethod
    def of(search) -> ReadOptions:
        return ReadOptions(search.include, search.exclude, search.extensions, search.encoding, search.limits)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> ReadOptions:
        d = json.loads(text)
        return ReadOptions(tuple(d["include"]), tuple(d["exclude"]), tuple(d["extensions"]), d["encoding"], SafetyLimits(**d["limits"]))


def discover(path: str, recursive: bool = True) -> list[str]:
    """Archives at a path, in order of their folders' and then their own names; folders that are links are not entered."""
    if os.path.isfile(path):
        if not path.lower().endswith(".zip"):
            raise ConfigurationError(f"{path} is not a ZIP archive")
        return [path]
    if not os.path.isdir(path):
        raise ConfigurationError(f"path does not exist: {path}")
    found: list[str] = []
    for folder, inner, files in os.walk(path, followlinks=False):
        inner[:] = sorted(inner) if recursive else []
        found += [p for f in sorted(files) if f.lower().endswith(".zip") and os.path.isfile(p := os.path.join(folder, f))]
    return found


def check_members(infos: list[zipfile.ZipInfo], limits: SafetyLimits) -> tuple[list[int], list[Issue]]:
    """Places of the members that may be opened, and what speaks against the others; nothing is decompressed."""
    if len(infos) > limits.max_members:
        return [], [Issue(f"archive left out: it has {len(infos)} members, {limits.max_members} are allowed", kind="safety")]
    allowed, issues = [], []
    files = [(i, m) for i, m in enumerate(infos) if not m.is_dir()]
    for i, m in files:
        ratio = m.file_size / max(m.compress_size, 1)
        if is_unsafe(m.filename):
            issues.append(Issue("left out: its path leads outside", m.filename, "safety"))
        elif m.flag_bits & 1:
            issues.append(Issue("left out: it is encrypted", m.filename, "unsupported"))
        elif m.file_size > limits.max_member_bytes:
            issues.append(Issue("left out: it is too large", m.filename, "safety"))
        elif ratio > limits.max_compression_ratio:
            issues.append(Issue(f"left out: a byte of it makes {ratio:.1f}", m.filename, "safety"))
        else:
            allowed.append(i)
    if sum(m.file_size for _, m in files) > limits.max_total_bytes:
        return [], [*issues, Issue("archive left out: its members are too large together", kind="safety")]
    return allowed, issues


@dataclass
class _Counts:
    seen: int = 0
    scanned: int = 0
    declared: int = 0
    records: int = 0


def read_archive(source, options: ReadOptions, share: tuple[int, int] = (0, 1), routes: frozenset[tuple[int, ...]] | None = None) -> Iterator[tuple]:
    """Rows of one archive: ('record', member, nested_path, route, line, text, header), ('issue', Issue) and one ('stat', counts).

    share (k, n): only every n-th member from the k-th on, the archive's own
    issues and counts with k = 0. routes: only these members.
    """
    counts = _Counts()
    leads = None if routes is None else {r[:n] for r in routes for n in range(1, len(r) + 1)}

    def walk(opened, depth: int, path: tuple[str, ...], route: tuple[int, ...]) -> Iterator[tuple]:
        with zipfile.ZipFile(opened) as archive:
            infos = archive.infolist()
            first = depth > 0 or share[0] == 0
            allowed, issues = check_members(infos, options.limits)
            if first:
                files = [m for m in infos if not m.is_dir()]
                counts.seen += len(files)
                counts.declared += sum(m.file_size for m in files)
                yield from (("issue", i) for i in issues)
            for place in allowed:
                here = (*route, place)
                if depth == 0 and place % share[1] != share[0]:
                    continue
                if leads is not None and here not in leads:
                    continue
                info = infos[place]
                suffix = suffix_of(info.filename)
                nested = suffix == ".zip"
                if is_excluded(info.filename, options.exclude) if nested else not is_wanted(info.filename, options.extensions, options.include, options.exclude):
                    continue
                try:
                    if nested:
                        if depth >= options.limits.max_nested_depth:
                            yield "issue", Issue("left out: archives are nested too deep", info.filename, "safety")
                            continue
                        with archive.open(info) as member, seekable(member, options.limits.max_member_bytes) as spool:
                            yield from walk(spool, depth + 1, (*path, info.filename), here)
                        continue
                    header = None
                    with archive.open(info) as member:
                        for line, text in decoder(suffix)(member, options.encoding, options.limits.max_member_bytes):
                            if line == 1 and suffix in (".csv", ".tsv"):
                                header = text
                            counts.records += 1
                            yield "record", info.filename, path, here, line, text, header
                    counts.scanned += 1
                except Exception as e:  # a member that cannot be read is an issue, whatever is wrong with it
                    yield "issue", Issue(str(e) or type(e).__name__, info.filename, "member")

    try:
        yield from walk(source, 0, (), ())
    except Exception as e:
        yield "issue", Issue(f"unreadable archive: {e}", None, "archive")
    yield "stat", counts


_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("archive", pa.string()), ("member", pa.string()), ("nested_path", pa.list_(pa.string())), ("route", pa.list_(pa.int32())), ("line", pa.int64()), ("text", pa.string()), ("header", pa.string()),
        ("message", pa.string()), ("issue", pa.string()), ("members_seen", pa.int64()), ("members_scanned", pa.int64()), ("bytes_declared", pa.int64()), ("records", pa.int64()),
    ]
)


def batches(archive: str, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of what read_archive yields."""
    held: list[tuple] = []
    chars = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    for row in rows:
        if row[0] == "record":
            _, member, path, route, line, text, header = row
            text = text.encode("utf-8", "replace").decode() if not text.isascii() else text
            held.append(("record", archive, member, path, route, line, text, header, None, None, None, None, None, None))
            chars += len(text)
        elif row[0] == "issue":
            held.append(("issue", archive, row[1].member, None, None, None, None, None, row[1].message, row[1].kind, None, None, None, None))
        else:
            held.append(("stat", archive, None, None, None, None, None, None, None, None, row[1].seen, row[1].scanned, row[1].declared, row[1].records))
        if len(held) >= BATCH or chars >= BATCH_CHARS:
            yield out()
            held, chars = [], 0
    if held:
        yield out()


@dataclass
class ArchivePart(InputPartition):
    """Shares of archives: (path, k, n); routes: the members of these archives that are read, None for all."""

    shares: list[tuple[str, int, int]]
    routes: dict[str, frozenset[tuple[int, ...]]] | None = None

    def __init__(self, shares: list[tuple[str, int, int]], routes: dict[str, frozenset[tuple[int, ...]]] | None = None):
        super().__init__(None)
        self.shares, self.routes = shares, routes


def pack(paths: list[str], target: int = PARTITION_BYTES, cores: int = 1, sizes: dict[str, int] | None = None) -> list[ArchivePart]:
    """Partitions of about `target` bytes, fewer where that leaves cores idle: small archives together, large ones in shares.

    sizes: what counts as an archive's bytes, if not those of its file.
    """
    parts: list[ArchivePart] = []
    sizes = sizes or {p: os.path.getsize(p) if os.path.exists(p) else 0 for p in paths}
    total = sum(sizes[p] for p in paths)
    target = min(target, max(LEAST_BYTES, -(-total // (4 * cores))))
    held: list[tuple[str, int, int]] = []
    size = 0
    for p in paths:
        n = sizes[p]
        if n > 2 * target:
            k = -(-n // target)
            parts += [ArchivePart([(p, i, k)]) for i in range(k)]
            continue
        if held and size + n > target:
            parts.append(ArchivePart(held))
            held, size = [], 0
        held.append((p, 0, 1))
        size += n
    return [*parts, ArchivePart(held)] if held else parts


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.read_options = ReadOptions.from_json(options["read"]) if "read" in options else ReadOptions()
        self.recursive = options.get("recursive", "true").lower() != "false"
        self.listing = options.get("listing")
        self.target, self.cores = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("cores", 1))

    def partitions(self) -> list[ArchivePart]:
        only, routes = None, None
        if self.listing:  # read here, on the driver: with the options it would go to every task
            with open(self.listing, encoding="utf-8") as f:
                only, routes = json.load(f)
        paths = discover(self.path, self.recursive) if only is None else only
        if routes is not None:
            paths = [p for p in paths if p in routes]
        parts = pack(paths, self.target, self.cores) or [ArchivePart([])]
        if routes is not None:
            for part in parts:
                part.routes = {p: frozenset(map(tuple, routes[p])) for p, _, _ in part.shares}
        return parts

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        for path, k, n in partition.shares:
            yield from batches(path, read_archive(path, self.read_options, (k, n), partition.routes[path] if partition.routes is not None else None))


class ArchiveSource(DataSource):
    """format("recordscan_archives"): options path, read (ReadOptions as JSON), recursive, listing (a file of the driver: archives and routes), partitionBytes, cores."""

    @classmethod
    def name(cls) -> str:
        return "recordscan_archives"

    def schema(self):
        return TAGGED

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def _listing(archives: list[str] | None, routes: dict[str, list[tuple[int, ...]]] | None) -> str:
    """A file that names archives and routes for the planning of a scan; it stays as long as this process, as a frame may be planned again."""
    at, path = tempfile.mkstemp(prefix="recordscan-", suffix=".json")
    with open(at, "w", encoding="utf-8") as f:
        json.dump([archives, routes], f)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    return path


def is_local(path: str) -> bool:
    return "://" not in path and not path.startswith("file:")


def read_tagged(spark: SparkSession, path: str, options: ReadOptions | None = None, recursive: bool = True, archives: list[str] | None = None, routes: dict[str, list[tuple[int, ...]]] | None = None) -> DataFrame:
    """Records, issues and counts of archives, told apart by kind.

    A path without a scheme is a folder or file that driver and executors
    both see. Others are read by Spark, an archive at once in a task.
    """
    options = options or ReadOptions()
    if is_local(path):
        spark.dataSource.register(ArchiveSource)
        reader = spark.read.format("recordscan_archives").option("path", path).option("read", options.to_json()).option("recursive", str(recursive).lower()).option("cores", spark.sparkContext.defaultParallelism)
        if archives is not None or routes is not None:
            reader = reader.option("listing", _listing(archives, routes))
        return reader.load()
    import io

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content")
    if archives is not None:
        files = files.filter(files["path"].isin(archives))
    kept = {a: frozenset(tuple(r) for r in rs) for a, rs in routes.items()} if routes is not None else None

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for p, content in zip(b.column("path").to_pylist(), b.column("content")):
                if kept is None or p in kept:
                    yield from batches(p, read_archive(io.BytesIO(content.as_py()), options, routes=kept and kept[p]))

    return files.mapInArrow(run, TAGGED)


def read_found(spark: SparkSession, found: DataFrame, options: ReadOptions) -> DataFrame:
    """Records, issues and counts of the members (archive, route) that rows name, which only executors hold; other members are not opened."""
    from pyspark.sql import functions as F

    # the number is said: rows are small, what is read for them is not
    wanted = found.groupBy("archive").agg(F.collect_set("route").alias("routes")).repartition(4 * spark.sparkContext.defaultParallelism, "archive")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for p, routes in zip(b.column("archive").to_pylist(), b.column("routes").to_pylist()):
                yield from batches(p, read_archive(p, options, routes=frozenset(map(tuple, routes))))

    return wanted.select("archive", "routes").mapInArrow(run, TAGGED)


def records_of(tagged: DataFrame) -> DataFrame:
    return tagged.filter("kind = 'record'").select("archive", "member", "nested_path", "route", "line", "text", "header")


def issues_of(tagged: DataFrame) -> DataFrame:
    return tagged.filter("kind = 'issue'").select("archive", "member", "message", "issue")


def stats_of(tagged: DataFrame) -> DataFrame:
    """Counts of each archive; completed: it could be opened."""
    from pyspark.sql import functions as F

    bad = F.max(((F.col("kind") == "issue") & (F.col("issue") == "archive")).cast("int"))
    return tagged.filter("kind <> 'record'").groupBy("archive").agg(F.sum("members_seen").alias("members_seen"), F.sum("members_scanned").alias("members_scanned"), F.sum("bytes_declared").alias("bytes_declared"), (bad == 0).alias("completed"))


def _central(paths: Iterable[str]) -> Iterator[tuple]:
    for path in paths:
        try:
            with zipfile.ZipFile(path) as z:
                infos = z.infolist()
        except Exception:
            continue
        for i, m in enumerate(infos):
            yield path, i, m.filename, m.file_size, m.compress_size, bool(m.flag_bits & 1), m.is_dir(), m.CRC, m.header_offset


def members(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Central directories of archives, a row for each member; nothing is decompressed."""
    listed = spark.createDataFrame([(p,) for p in discover(path, recursive)], "path string").repartition(spark.sparkContext.defaultParallelism)
    arrow = pa.schema([("archive", pa.string()), ("ordinal", pa.int32()), ("member", pa.string()), ("file_size", pa.int64()), ("compress_size", pa.int64()), ("encrypted", pa.bool_()), ("is_dir", pa.bool_()), ("crc", pa.int64()), ("header_offset", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows = list(_central(b.column("path").to_pylist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return listed.mapInArrow(run, MEMBER)


def validated(found: DataFrame, limits: SafetyLimits | None = None) -> DataFrame:
    """members with reject_reason (null: allowed) and issue kind, by the same rules as check_members, as Columns."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.paths import unsafe

    limits = limits or SafetyLimits()
    w = Window.partitionBy("archive")
    ratio = F.col("file_size") / F.greatest(F.col("compress_size"), F.lit(1))
    own = (
        F.when(F.col("is_dir"), F.lit("directory"))
        .when(unsafe(F.col("member")), F.lit("unsafe path"))
        .when(F.col("encrypted"), F.lit("encrypted"))
        .when(F.col("file_size") > limits.max_member_bytes, F.lit("oversized"))
        .when(ratio > limits.max_compression_ratio, F.lit("compression ratio"))
    )
    total = F.sum(F.when(~F.col("is_dir"), F.col("file_size")).otherwise(0)).over(w)
    whole = F.when(F.count(F.lit(1)).over(w) > limits.max_members, F.lit("too many members")).when(total > limits.max_total_bytes, F.lit("expanded size"))
    kind = F.when(F.col("reject_reason") == "encrypted", "unsupported").when(F.col("reject_reason").isNotNull() & (F.col("reject_reason") != "directory"), "safety")
    return found.withColumn("reject_reason", F.coalesce(whole, own)).withColumn("issue", kind)


def inspect(path: str, limits: SafetyLimits | None = None) -> tuple[dict, list[Issue]]:
    """Counts and issues of one archive from its central directory alone."""
    try:
        if not stat.S_ISREG(os.stat(path).st_mode):
            raise OSError("not a file")
        with zipfile.ZipFile(path) as z:
            infos = z.infolist()
    except Exception as e:
        return {"archive": path, "members_seen": 0, "members_allowed": 0, "bytes_declared": 0}, [Issue(f"unreadable archive: {e}", None, "archive")]
    allowed, issues = check_members(infos, limits or SafetyLimits())
    files = [m for m in infos if not m.is_dir()]
    return {"archive": path, "members_seen": len(files), "members_allowed": len(allowed), "bytes_declared": sum(m.file_size for m in files)}, issues
