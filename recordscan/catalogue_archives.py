"""Queries over archives that are made of the driver's tables: formats, the search engine by scan and by index, the index's life."""

from __future__ import annotations

import io
import json
import os
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .catalogue import DIGITS, NORMAL, PHONE, query
from .engine import annotate, search
from .operators import provenance
from .options import SafetyLimits, SearchOptions
from .plans import index as ix
from .sources.archives import ReadOptions, inspect, members, read_found, read_tagged, records_of, stats_of, validated
from .sources.tables import lean, read_table
from .streaming.ingest import match_stream

#: Documents of an archive, customers of an archive; a folder has as many archives as the table asks for.
DOCS, CUSTOMERS = 100, 250
#: Documents that a task holds twice, as texts and as archives.
NESTED = 100
#: Some documents are one word over and over and shrink more, or are longer, than archives of strangers may.
LAX = SafetyLimits(max_compression_ratio=1e6, max_member_bytes=2 << 30)

_made: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that executors see: below spark.checkpoint.dir, or, where that is unset on a single machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root.removeprefix("file://").removeprefix("file:") if root else tempfile.mkdtemp(prefix="recordscan-")
    path = os.path.join(root, f"archives-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[SparkSession, str], str]) -> str:
    """A folder that is made of some tables, the same one for the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made or not os.path.isdir(_made[key]):
        _made[key] = make(spark, sf_dir)
    return _made[key]


def _write(groups: DataFrame, folder: str) -> None:
    """Write rows (archive, place, member, content) as archives, each archive's members in order of place."""

    def write(frames):
        import pandas as pd

        at, z, n = None, None, 0

        def close():
            if z is not None:
                z.close()
                os.replace(os.path.join(folder, at + ".part"), os.path.join(folder, at))

        for frame in frames:
            for archive, member, content in zip(frame["archive"], frame["member"], frame["content"]):
                if archive != at:
                    close()
                    at, z = archive, zipfile.ZipFile(os.path.join(folder, archive + ".part"), "w", zipfile.ZIP_DEFLATED)
                    n += 1
                z.writestr(member, bytes(content))
        close()
        yield pd.DataFrame({"n": [n]})

    groups.select("archive", "place", "member", "content").repartition("archive").sortWithinPartitions("archive", "place").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    number = F.floor(F.col("doc_id") / DOCS)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(number.alias("number"), F.format_string("docs-%06d.zip", number).alias("archive"), F.col("doc_id").alias("place"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def document_archives(spark: SparkSession, sf_dir: str) -> str:
    """The documents as archives of DOCS each."""

    def make(spark, sf_dir):
        folder = shared_folder(spark)
        _write(_documents(spark, sf_dir), folder)
        return folder

    return _once(spark, sf_dir, "documents", make)


def indexed_archives(spark: SparkSession, sf_dir: str) -> str:
    """The same folder with an index of all of it."""
    folder = document_archives(spark, sf_dir)
    if ix.read_manifest(ix.default_path(folder)) is None:
        ix.build_or_update(spark, folder, limits=LAX, terms=False)
    return folder


def half_indexed_archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder whose archives of even numbers were indexed before the others came."""

    def make(spark, sf_dir):
        folder = shared_folder(spark)
        docs = _documents(spark, sf_dir)
        _write(docs.filter("number % 2 = 0"), folder)
        ix.build_or_update(spark, folder, limits=LAX, terms=False)
        _write(docs.filter("number % 2 = 1"), folder)
        return folder

    return _once(spark, sf_dir, "half", make)


# archives of documents

#: Records of the archived documents.
DOC = f"""doc AS (
    SELECT 'docs-' || lpad(CAST(CAST(floor(doc_id / {DOCS}) AS BIGINT) AS VARCHAR), 6, '0') || '.zip' AS archive, doc_id, 'docs/' || doc_id || '.txt' AS member, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (
        SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)))"""
_READ = ReadOptions(limits=LAX)
_ROUND_TRIP = f"WITH {DOC} SELECT member, line, text FROM doc"


@query(_ROUND_TRIP)
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(read_tagged(spark, document_archives(spark, sf_dir), _READ)).select("member", "line", "text")


def _nested(member: str, content: bytes) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, bytes(content))
    return b.getvalue()


@query(_ROUND_TRIP)
def nested_zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives inside archives, a file at a time."""

    def make(spark, sf_dir):
        folder = shared_folder(spark)

        def nest(frames):
            for f in frames:
                for i in range(0, len(f), NESTED):
                    part = f.iloc[i : i + NESTED]
                    yield part.assign(content=[_nested(m, c) for m, c in zip(part["member"], part["content"])], member=part["member"].str.replace(".txt", ".zip"))

        docs = _documents(spark, sf_dir)
        _write(docs.mapInPandas(nest, docs.schema), folder)
        return folder

    return records_of(read_tagged(spark, _once(spark, sf_dir, "nested", make), _READ)).select("member", "line", "text")


@query(f"WITH {DOC} SELECT archive, count(DISTINCT doc_id) AS members_seen, CAST(sum(bytes) AS BIGINT) AS bytes_declared FROM (SELECT 'docs-' || lpad(CAST(CAST(floor(doc_id / {DOCS}) AS BIGINT) AS VARCHAR), 6, '0') || '.zip' AS archive, doc_id, strlen(coalesce(text, '')) AS bytes FROM documents) GROUP BY archive")
def zip_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `inspect` says of each archive."""
    folder = document_archives(spark, sf_dir)
    listed = spark.createDataFrame([(os.path.join(folder, f),) for f in os.listdir(folder) if f.endswith(".zip")], "path string").repartition(spark.sparkContext.defaultParallelism)

    def run(frames):
        import pandas as pd

        for f in frames:
            found = [inspect(p, LAX)[0] for p in f["path"]]
            yield pd.DataFrame([(os.path.basename(x["archive"]), x["members_seen"], x["bytes_declared"]) for x in found], columns=["archive", "members_seen", "bytes_declared"])

    return listed.mapInPandas(run, "archive string, members_seen long, bytes_declared long")


@query("SELECT count(*) AS members_seen, CAST(sum(strlen(text)) AS BIGINT) AS bytes_declared FROM documents")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validated(members(spark, document_archives(spark, sf_dir)), LAX)
    return found.filter("NOT is_dir AND reject_reason IS NULL").agg(F.count(F.lit(1)).alias("members_seen"), F.sum("file_size").alias("bytes_declared"))


@query("SELECT count(*) AS members_seen, count(*) AS members_scanned FROM documents")
def zip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(read_tagged(spark, document_archives(spark, sf_dir), _READ)).agg(F.sum("members_seen").alias("members_seen"), F.sum("members_scanned").alias("members_scanned"))


@query(f"WITH {DOC} SELECT member, line, text FROM doc WHERE contains(lower(text), 'mit license') AND member LIKE 'docs/1%'")
def zip_search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = read_tagged(spark, document_archives(spark, sf_dir), ReadOptions(include=("1*.txt",), limits=LAX))
    return annotate(records_of(tagged), SearchOptions(("MIT license",))).select("member", "line", "text")


@query(f"WITH {DOC} SELECT archive, member, line, text FROM doc WHERE doc_id % {DOCS} IN (0, 3)")
def zip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first and the fourth member of each archive are opened."""
    folder = document_archives(spark, sf_dir)
    wanted = {os.path.join(folder, f): [(0,), (3,)] for f in os.listdir(folder) if f.endswith(".zip")}
    tagged = read_tagged(spark, folder, _READ, archives=sorted(wanted), routes=wanted)
    return _named(records_of(tagged)).select("archive", "member", "line", "text")


# the engine


def _named(rows: DataFrame) -> DataFrame:
    """Archives by their names, without the folder."""
    return rows.withColumn("archive", F.element_at(F.split("archive", "/"), -1))


def _found(spark: SparkSession, folder: str, options: SearchOptions, force_scan: bool = False) -> DataFrame:
    r = search(spark, folder, options, force_scan=force_scan)
    return _named(r.matches).select("archive", "member", "line", "text", "score", "execution_path")


def _first(where: str, path: str = "'scan'", score: str = "0", order: str = "archive, doc_id, line", n: int = 1000) -> str:
    """The first n matches in order, of which an archive gives n at most."""
    return f"""WITH {DOC}, norm AS (SELECT *, {NORMAL.format('text')} AS n, {PHONE.format('text')} AS pd FROM doc), hit AS (SELECT *, CAST({score} AS INT) AS score FROM norm WHERE {where})
    SELECT archive, member, line, text, score, {path} AS execution_path FROM (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY archive ORDER BY {order}) <= {n}) ORDER BY {order} LIMIT {n}"""


@query(_first("contains(lower(text), 'licensed under') OR contains(lower(text), 'released')"))
def engine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, document_archives(spark, sf_dir), SearchOptions(("licensed under", "Released"), limits=LAX), force_scan=True)


@query(_first("contains(lower(text), 'licensed under') OR contains(lower(text), 'released')", "'index'"))
def engine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, indexed_archives(spark, sf_dir), SearchOptions(("licensed under", "Released"), limits=LAX))


@query(_first("contains(lower(text), 'licensed under')", f"CASE WHEN CAST(floor(doc_id / {DOCS}) AS BIGINT) % 2 = 0 THEN 'index' ELSE 'scan' END"))
def engine_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, half_indexed_archives(spark, sf_dir), SearchOptions(("licensed under",), limits=LAX))


#: The ranking rules for 'released thereof', written out.
_FULL = "(CAST(contains(' ' || n || ' ', ' released ') AS INT) + CAST(contains(' ' || n || ' ', ' thereof ') AS INT))"
_STARTS = "(CAST(NOT contains(' ' || n || ' ', ' released ') AND contains(' ' || n, ' released') AS INT) + CAST(NOT contains(' ' || n || ' ', ' thereof ') AND contains(' ' || n, ' thereof') AS INT))"
_SCORE = f"CASE WHEN contains(n, 'released thereof') THEN 502 WHEN {_FULL} = 2 THEN 402 WHEN {_FULL} = 1 AND {_STARTS} = 1 THEN 311 WHEN {_FULL} = 1 THEN 110 WHEN {_STARTS} > 0 THEN 70 + {_STARTS} ELSE 0 END"


@query(_first(f"{_SCORE} > 0", "'index'", _SCORE, "score DESC, archive, member, line", 200))
def engine_smart_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, indexed_archives(spark, sf_dir), SearchOptions(("released thereof",), smart=True, limits=LAX, max_matches=200))


@query(_first("regexp_matches(text, '(?i)token = .[0-9a-f]{40}')"))
def engine_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, indexed_archives(spark, sf_dir), SearchOptions((r"token = .[0-9a-f]{40}",), regex=True, limits=LAX))


@query(_first("(contains(n, 'licensed') OR contains(' ' || n, ' releas')) AND NOT contains(n, 'mit') AND contains(archive, '0')", order="archive, member, line"))
def engine_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, indexed_archives(spark, sf_dir), SearchOptions(advanced="(licensed OR releas*) NOT mit archive:0 format:txt", limits=LAX))


@query(
    f"""WITH {DOC}, hit AS (SELECT * FROM doc WHERE contains(lower(text), 'licensed under') ORDER BY archive, doc_id, line LIMIT 1000)
    SELECT h.member, h.line, coalesce((SELECT string_agg(r.text, '|' ORDER BY r.line) FROM doc r WHERE r.doc_id = h.doc_id AND r.line BETWEEN h.line - 2 AND h.line - 1), '') AS before,
    coalesce((SELECT string_agg(r.text, '|' ORDER BY r.line) FROM doc r WHERE r.doc_id = h.doc_id AND r.line BETWEEN h.line + 1 AND h.line + 2), '') AS after FROM hit h"""
)
def engine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search(spark, indexed_archives(spark, sf_dir), SearchOptions(("licensed under",), context=2, limits=LAX))
    return r.matches.select("member", "line", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


# the index


def _members_of(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Candidates (relative, route, line) with the names of their members, which are not nested."""
    named = members(spark, folder).select(F.element_at(F.split("archive", "/"), -1).alias("relative"), F.col("ordinal").alias("place"), "member")
    return found.withColumn("place", F.col("route")[0]).join(named, ["relative", "place"]).select(F.col("relative").alias("archive"), "member", "line")


_TERMS = f"WITH {DOC}, norm AS (SELECT *, {NORMAL.format('text')} AS n, {DIGITS.format('text')} AS d, {PHONE.format('text')} AS pd FROM doc), t AS (SELECT DISTINCT archive, member, line, unnest(list_filter(string_split(n, ' '), lambda x: x <> '')) AS term FROM norm)"


def _candidates(spark: SparkSession, sf_dir: str, options: SearchOptions) -> DataFrame:
    folder = indexed_archives(spark, sf_dir)
    return _members_of(spark, folder, ix.candidates(spark, ix.default_path(folder), options))


@query(f"{_TERMS} SELECT archive, member, line FROM t GROUP BY archive, member, line HAVING bool_or(contains(term, 'licensed')) AND bool_or(contains(term, 'under')) AND bool_or(contains(term, 'cc'))")
def index_candidates_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, SearchOptions(("licensed under CC",), limits=LAX))


@query(f"{_TERMS} SELECT DISTINCT archive, member, line FROM t WHERE contains(term, 'released') OR contains(term, 'thereof')")
def index_candidates_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, SearchOptions(("released thereof",), smart=True, limits=LAX))


@query(f"{_TERMS} SELECT archive, member, line FROM norm WHERE length(pd) >= 7 AND contains(pd, '5550100') UNION SELECT archive, member, line FROM t WHERE contains(term, '555') OR contains(term, '0100')")
def index_candidates_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, SearchOptions(("555-0100",), smart=True, limits=LAX))


@query(f"WITH {DOC} SELECT archive, member, line, text FROM doc WHERE contains(lower(text), 'licensed under cc')")
def verify_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate is looked at again: what the index found, not what it says, is the result."""
    o = SearchOptions(("licensed under CC",), limits=LAX)
    folder = indexed_archives(spark, sf_dir)
    found = ix.candidates(spark, ix.default_path(folder), o)
    # kept, as it says both which members are read and which of their records count
    found = found.select(F.concat(F.lit(folder + os.sep), "relative").alias("archive"), "route", "line").persist(StorageLevel.DISK_ONLY)
    records = records_of(read_found(spark, found, _READ))
    return _named(annotate(records.join(found, ["archive", "route", "line"], "left_semi"), o)).select("archive", "member", "line", "text")


@query(f"{_TERMS} SELECT (SELECT count(DISTINCT archive) FROM doc) AS archives, (SELECT count(DISTINCT member) FROM t) AS members, (SELECT count(*) FROM doc) AS records, (SELECT count(*) FROM t) + (SELECT count(*) FROM norm WHERE length(pd) >= 7) AS postings, (SELECT count(DISTINCT term) FROM t) + (SELECT count(DISTINCT pd) FROM norm WHERE length(pd) >= 7) AS terms, 'READY' AS state")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ix.status(spark, indexed_archives(spark, sf_dir))
    return spark.createDataFrame([(s.archives, s.members, s.records, s.postings, s.terms, s.state)], "archives long, members long, records long, postings long, terms long, state string")


@query(f"{_TERMS} SELECT term, archive, member, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM t GROUP BY term, archive, member")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that the index holds, by member."""
    folder = indexed_archives(spark, sf_dir)
    held = ix.postings(spark, ix.default_path(folder)).filter("kind = 'term'").groupBy("term", "relative", "route").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    named = members(spark, folder).select(F.element_at(F.split("archive", "/"), -1).alias("relative"), F.col("ordinal").alias("place"), "member")
    return held.withColumn("place", F.col("route")[0]).join(named, ["relative", "place"]).select("term", F.col("relative").alias("archive"), "member", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def _nations(spark: SparkSession, sf_dir: str, folder: str, regions: str, said: str = "") -> None:
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").filter(regions)
    text = F.concat_ws("\n", F.lit("key,name"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name"), F.lit(said))
    _write(n.select(F.format_string("nation-%04d.zip", "n_nationkey").alias("archive"), F.lit(0).alias("place"), F.lit("nation.csv").alias("member"), text.cast("binary").alias("content")), folder)


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 3 THEN 'new' ELSE 'fresh' END AS state FROM nation")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each nation; after they were indexed some go, some change, some come."""
    folder = shared_folder(spark)
    _nations(spark, sf_dir, folder, "n_regionkey <> 3")
    ix.build_or_update(spark, folder)
    gone = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").filter("n_regionkey = 0")
    for r in gone.collect():  # a handful of nations
        os.remove(os.path.join(folder, f"nation-{r['n_nationkey']:04d}.zip"))
    _nations(spark, sf_dir, folder, "n_regionkey = 1", "now with a further line")
    _nations(spark, sf_dir, folder, "n_regionkey = 3")
    at = ix.default_path(folder)
    cover = ix.coverage(spark, folder, ix.archives_table(spark, at, ix.read_manifest(at)))
    return cover.select(F.regexp_extract("relative", r"(\d+)", 1).cast("long").alias("n_nationkey"), "state")


@query(
    """WITH n AS (SELECT count(*) AS n_all, count(*) FILTER (n_regionkey <> 3) AS n_part FROM nation)
    SELECT 'interrupted' AS step, 'BUILDING' AS state, CAST(1 AS BIGINT) AS archives UNION ALL SELECT 'resumed', 'READY', n_part FROM n UNION ALL SELECT 'archives came', 'STALE', n_part FROM n UNION ALL SELECT 'updated', 'READY', n_all FROM n
    UNION ALL SELECT 'compacted', 'READY', n_all FROM n UNION ALL SELECT 'verified', 'READY', n_all FROM n UNION ALL SELECT 'damaged', 'CORRUPT', n_all FROM n UNION ALL SELECT 'rebuilt', 'READY', n_all FROM n UNION ALL SELECT 'cleaned', 'NONE', 0"""
)
def index_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the nations' archives through all that can happen to it."""
    folder, told = shared_folder(spark), []
    at = ix.default_path(folder)

    def tell(step: str, status: ix.IndexStatus) -> None:
        told.append((step, status.state, status.archives))

    _nations(spark, sf_dir, folder, "n_regionkey <> 3")
    asked = iter((False, True))
    tell("interrupted", ix.build_or_update(spark, folder, cancelled=lambda: next(asked), batch=1)[0])
    tell("resumed", ix.build_or_update(spark, folder)[0])
    _nations(spark, sf_dir, folder, "n_regionkey = 3")
    tell("archives came", ix.status(spark, folder))
    tell("updated", ix.build_or_update(spark, folder)[0])
    ix.compact(spark, at)
    tell("compacted", ix.status(spark, folder))
    tell("verified", ix.verify(spark, folder))
    part = next(os.path.join(d, f) for d, _, fs in os.walk(os.path.join(at, "postings")) for f in fs if f.endswith(".parquet"))
    spark.read.schema("kind string, term string, relative string, route array<int>, line long").parquet(part).limit(0).coalesce(1).write.parquet(at + "-empty")
    shutil.copy(next(os.path.join(at + "-empty", f) for f in os.listdir(at + "-empty") if f.endswith(".parquet")), part)
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    tell("damaged", ix.verify(spark, folder))
    tell("rebuilt", ix.build_or_update(spark, folder, rebuild=True)[0])
    ix.clean(at)
    tell("cleaned", ix.status(spark, folder))
    shutil.rmtree(folder)
    return spark.createDataFrame(told, "step string, state string, archives long")


# formats


def _sqlite(rows: list[tuple]) -> bytes:
    with tempfile.TemporaryDirectory(prefix="recordscan-") as folder:
        path = os.path.join(folder, "t.db")
        db = sqlite3.connect(path)
        db.execute('CREATE TABLE "customer" (k INTEGER, name TEXT, segment TEXT, nation INTEGER)')
        db.executemany('INSERT INTO "customer" VALUES (?, ?, ?, ?)', rows)
        db.execute('CREATE TABLE "notes ""x""" (said TEXT, blank TEXT)')
        db.execute('INSERT INTO "notes ""x""" VALUES (?, NULL)', (f"{len(rows)} rows",))
        db.commit()
        db.close()
        with open(path, "rb") as f:
            return f.read()


def _zip(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, said in parts.items():
            z.writestr(name, said)
    return b.getvalue()


def _xlsx(rows: list[tuple]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({r[2] for r in rows})
    cells = "".join(f'<row><c><v>{k}</v></c><c t="inlineStr"><is><t>{escape(name)}</t></is></c><c/><c t="s"><v>{shared.index(segment)}</v></c><c><v>{nation}</v></c></row><row/>' for k, name, segment, nation in rows)
    strings = "".join(f"<si><t>{escape(s[:2])}</t><r><t>{escape(s[2:])}</t></r></si>" for s in shared)
    return _zip({"xl/sharedStrings.xml": f"<sst {ns}>{strings}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"})


def _office(suffix: str, rows: list[tuple]) -> bytes:
    said = [escape(f"{name} of {segment}") for _, name, segment, _ in rows]
    if suffix == ".docx":
        return _zip({"word/document.xml": '<w:document xmlns:w="urn:w"><w:body>' + "".join(f"<w:p><w:r><w:t>{x[:3]}</w:t></w:r><w:r><w:t>{x[3:]}</w:t></w:r></w:p><w:p/>" for x in said) + "</w:body></w:document>", "word/styles.xml": '<w:p xmlns:w="urn:w">no</w:p>'})
    if suffix == ".pptx":
        return _zip({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:t> {x} </a:t></p:sld>' for i, x in enumerate(said)})
    return _zip({"content.xml": '<o:body xmlns:o="urn:o">' + "".join(f"<o:p>{x[:4]}<o:span>{x[4:]}</o:span></o:p>" if i % 2 else f"<o:h>{x}</o:h>" for i, x in enumerate(said)) + "</o:body>"})


def customer_archives(spark: SparkSession, sf_dir: str) -> str:
    """Customers in all formats that are read, CUSTOMERS of them in an archive."""

    def content(frame):
        import pandas as pd

        frame = frame.sort_values("c_custkey")
        rows = list(zip(frame["c_custkey"].tolist(), frame["c_name"], frame["c_mktsegment"], frame["c_nationkey"].tolist()))
        table = lambda d: "".join(d.join(map(str, r)) + "\n" for r in [("key", "name", "segment", "nation"), *rows])
        made = {
            "c.csv": table(",").encode(), "c.tsv": table("\t").encode(), "c.jsonl": "".join(json.dumps({"key": r[0], "name": r[1]}) + "\n" for r in rows).encode(), "c.sqlite": _sqlite(rows), "c.xlsx": _xlsx(rows),
            "c.docx": _office(".docx", rows), "c.pptx": _office(".pptx", rows), "c.odt": _office(".odt", rows), "c.log": "".join(f"Клиент {r[1]}\r\n" for r in rows).encode("cp1251"), "c.md": "".join(f"Ключ {r[0]}\r" for r in rows).encode("utf-8-sig"),
        }
        archive = f"customers-{frame['block'].iloc[0]:06d}.zip"
        return pd.DataFrame([(archive, i, name, data) for i, (name, data) in enumerate(made.items())], columns=["archive", "place", "member", "content"])

    def make(spark, sf_dir):
        folder = shared_folder(spark)
        c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").withColumn("block", F.floor(F.col("c_custkey") / CUSTOMERS))
        _write(c.groupBy("block").applyInPandas(content, "archive string, place long, member string, content binary"), folder)
        return folder

    return _once(spark, sf_dir, "customers", make)


def _customer_records(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    return records_of(read_tagged(spark, customer_archives(spark, sf_dir), ReadOptions(extensions=(suffix,), limits=LAX)))


_SUFFIXES = {
    "csv": ("SELECT c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || c_nationkey AS text, 'key,name,segment,nation' AS header FROM customer", "line > 1", ["text", "header"]),
    "tsv": ("SELECT c_custkey || chr(9) || c_name || chr(9) || c_mktsegment || chr(9) || c_nationkey AS text FROM customer", "line > 1", ["text"]),
    "jsonl": ("""SELECT '{"key": ' || c_custkey || ', "name": "' || c_name || '"}' AS text FROM customer""", "true", ["text"]),
    "sqlite": ("SELECT '[customer] ' || c_custkey || ' ' || c_name || ' ' || c_mktsegment || ' ' || c_nationkey AS text FROM customer UNION ALL SELECT '[notes \"x\"] ' || count(*) || ' rows ' FROM customer GROUP BY CAST(floor(c_custkey / 250) AS BIGINT)", "true", ["text"]),
    "xlsx": ("SELECT c_custkey || ' ' || c_name || ' ' || c_mktsegment || ' ' || c_nationkey AS text, 2 * row_number() OVER (PARTITION BY CAST(floor(c_custkey / 250) AS BIGINT) ORDER BY c_custkey) - 1 AS line FROM customer", "true", ["text", "line"]),
    "docx": ("SELECT c_name || ' of ' || c_mktsegment AS text FROM customer", "true", ["text"]),
    "pptx": ("SELECT c_name || ' of ' || c_mktsegment AS text FROM customer", "true", ["text"]),
    "odt": ("SELECT c_name || ' of ' || c_mktsegment AS text FROM customer", "true", ["text"]),
    "log": ("SELECT 'Клиент ' || c_name AS text FROM customer", "true", ["text"]),
    "md": ("SELECT 'Ключ ' || c_custkey AS text FROM customer", "true", ["text"]),
}


def _format(suffix: str, keep: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _customer_records(spark, sf_dir, suffix).filter(keep).select(*columns)

    run.__name__ = f"zip_{suffix}"
    return run


for _suffix, (_sql, _keep, _columns) in _SUFFIXES.items():
    query(_sql)(_format(_suffix, _keep, _columns))


@query(
    """SELECT * FROM (VALUES ('c.csv', 'format=CSV;record'), ('c.tsv', 'format=TSV;record'), ('c.jsonl', 'format=JSONL;record;keys=key, name'), ('c.sqlite', 'format=SQLite;record;table=customer'), ('c.xlsx', 'format=XLSX;record;row'),
    ('c.docx', 'format=DOCX;record;record'), ('c.pptx', 'format=PPTX;record;record'), ('c.odt', 'format=ODT;record;record'), ('c.log', 'record')) AS f(member, said), (SELECT count(*) AS n FROM customer)"""
)
def provenance_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What provenance says of a customer's record in each format, numbers left out."""
    records = records_of(read_tagged(spark, customer_archives(spark, sf_dir), ReadOptions(limits=LAX)))
    pairs = provenance.provenance(F.col("member"), F.col("line"), F.col("text"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    said = F.array_join(F.transform(pairs, lambda p: F.when(p["key"].isin("record", "row"), p["key"]).otherwise(F.concat(p["key"], F.lit("="), p["value"]))), ";")
    own = ~(F.col("text").startswith("[notes") | (F.col("member").isin("c.csv", "c.tsv") & (F.col("line") == 1)) | (F.col("member") == "c.md"))
    return records.filter(own).groupBy("member", said.alias("said")).agg(F.count(F.lit(1)).alias("n"))


def _customers(where: str, text: str, member: str) -> str:
    return f"SELECT 'customers-' || lpad(CAST(CAST(floor(c_custkey / {CUSTOMERS}) AS BIGINT) AS VARCHAR), 6, '0') || '.zip' AS archive, '{member}' AS member, {text} AS text FROM customer WHERE {where} ORDER BY archive, c_custkey LIMIT 1000"


@query(_customers("c_mktsegment = 'BUILDING' AND c_nationkey < 12", "'[customer] ' || c_custkey || ' ' || c_name || ' ' || c_mktsegment || ' ' || c_nationkey", "c.sqlite").replace("c_nationkey < 12", "true"))
def advanced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search(spark, customer_archives(spark, sf_dir), SearchOptions(advanced="table:customer building", limits=LAX))
    return _named(r.matches).select("archive", "member", "text")


@query(_customers("c_mktsegment = 'MACHINERY'", "c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || c_nationkey", "c.csv"))
def advanced_csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = search(spark, customer_archives(spark, sf_dir), SearchOptions(advanced="fields:segment machinery format:csv", limits=LAX))
    return _named(r.matches).select("archive", "member", "text")


# what is made of a result

_WORDS = "regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}])((?:released|thereof)[\\p{L}\\p{N}]*)', 1)"


@query(
    _first(f"{_SCORE} > 0", "'index'", _SCORE, "score DESC, archive, member, line", 200).replace(
        "SELECT archive, member, line, text, score, 'index' AS execution_path FROM",
        f"SELECT archive, member, line, array_to_string({_WORDS}, '|') AS said, array_to_string(list_filter([CASE WHEN regexp_matches(' ' || n, ' released') THEN 'released' END, CASE WHEN regexp_matches(' ' || n, ' thereof') THEN 'thereof' END], lambda x: x IS NOT NULL), '|') AS asked FROM",
    )
)
def engine_smart_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of text and pattern that a ranked search's spans cover."""
    o = SearchOptions(("released thereof",), smart=True, limits=LAX, max_matches=200)
    r = search(spark, indexed_archives(spark, sf_dir), o)
    cut = lambda text, spans: F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "|")
    return _named(r.matches).select("archive", "member", "line", cut(F.col("text"), F.col("text_spans")).alias("said"), cut(F.lit(o.patterns[0]), F.col("query_spans")).alias("asked"))


_LICENSED = _first("contains(lower(text), 'licensed under')")


@query(f"SELECT text AS key, count(*) AS n FROM ({_LICENSED}) GROUP BY text")
def engine_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, indexed_archives(spark, sf_dir), SearchOptions(("licensed under",), limits=LAX)).groups("exact").select("key", "n")


@query(f"SELECT archive, member, CAST(max(score) AS INT) AS best, count(*) AS n, string_agg(line || ':' || text, '|' ORDER BY line) AS said FROM ({_LICENSED}) GROUP BY archive, member")
def engine_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a result with their rows."""
    tree = _named(search(spark, indexed_archives(spark, sf_dir), SearchOptions(("licensed under",), limits=LAX)).tree())
    said = F.array_join(F.transform("rows", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["text"])), "|")
    return tree.select("archive", "member", "best", "n", said.alias("said"))


@query(f"SELECT archive, member, line, text FROM ({_LICENSED})")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result exported as JSON lines, read again."""
    out = os.path.join(shared_folder(spark), "jsonl")
    render.write(search(spark, indexed_archives(spark, sf_dir), SearchOptions(("licensed under",), limits=LAX)).matches, out, "jsonl")
    return _named(spark.read.schema("archive string, member string, line long, text string").json(out))


@query(f"SELECT archive, member, line, text, 'scan' AS execution_path FROM ({_LICENSED})")
def cli_search_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints for at most 1,000 matches."""
    from . import cli

    out, err = io.StringIO(), io.StringIO()
    code = cli.main(["search", document_archives(spark, sf_dir), "licensed under", "--jsonl", "--max-ratio", "1000000", "--max-member-mib", "2048", "--no-index"], out, err)
    if code != cli.OK:
        raise RuntimeError(err.getvalue())
    found = [m for m in map(json.loads, out.getvalue().splitlines()) if m["type"] == "match"]
    rows = [(m["archive"], m["member"], m["line"], m["text"], m["execution_path"]) for m in found]
    return _named(spark.createDataFrame(rows, "archive string, member string, line long, text string, execution_path string"))


@query(f"WITH {DOC} SELECT archive, member, line, text FROM doc WHERE contains(lower(text), 'licensed under')")
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standing query over the folder, as a stream that ends when it has seen all archives."""
    folder, work = document_archives(spark, sf_dir), shared_folder(spark)
    found = match_stream(spark, folder, SearchOptions(("licensed under",), limits=LAX)).select("archive", "member", "line", "text")
    found.writeStream.format("parquet").option("path", os.path.join(work, "found")).option("checkpointLocation", os.path.join(work, "at")).trigger(availableNow=True).start().awaitTermination()
    return _named(spark.read.schema(found.schema).parquet(os.path.join(work, "found")))


@query(f"SELECT c_custkey, {NORMAL.format('c_name')} AS n, {PHONE.format('c_name')} AS d, CASE WHEN contains({NORMAL.format('c_name')}, 'customer 00') THEN 502 ELSE 311 END AS score FROM customer")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions under their SQL names."""
    from .functions.registry import register

    register(spark)
    read_table(spark, sf_dir, "customer", "c_custkey", "c_name").createOrReplaceTempView("recordscan_customer")
    return spark.sql("SELECT c_custkey, normalize_text(c_name) AS n, phone_digits(c_name) AS d, smart_score(c_name, 'customer 00') AS score FROM recordscan_customer")
