"""Whether a search reads its archives, what the index points to, or both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import SearchOptions
from ..sources.archives import discover, is_local
from . import index as ix

#: Fixed value: shares of archives and of members, both reached, from which candidates are no cheaper than a scan.
BROAD = 0.8
#: Members that the driver keeps in a plan; beyond that a scan is planned.
PLAN_MEMBERS = 200_000


@dataclass
class SearchPlan:
    execution: str
    reason: str
    index: ix.IndexStatus | None = None
    candidate_records: int = 0
    candidate_archives: int = 0
    candidate_members: int = 0
    scan_archives: list[str] | None = None
    routes: dict[str, list[tuple[int, ...]]] = field(default_factory=dict)
    candidates: DataFrame | None = None

    def explain(self) -> str:
        known = self.index
        of = lambda n, total: f"{n}/{total}"
        return (
            f"execution={self.execution} reason={self.reason} index={known.state if known else 'BYPASSED'} candidate_archives={of(self.candidate_archives, known.archives if known else 0)} "
            f"candidate_members={of(self.candidate_members, known.members if known else 0)} candidate_records={self.candidate_records}"
        )


def plan_search(spark: SparkSession, path: str, options: SearchOptions, index_path: str | None = None, recursive: bool = True, force_scan: bool = False) -> SearchPlan:
    """The first reason that speaks for a scan decides; else the index, with a scan of what it does not cover."""
    why = (
        "scan was asked for" if force_scan
        else "archives are not on a local path" if not is_local(path)
        else "the folder is not searched recursively" if not recursive
        else f"{options.mode} searches read their records" if options.mode in ("regex", "advanced")
        else "case counts" if options.case_sensitive
        else None
    )
    if why:
        return SearchPlan("scan", why)
    at = index_path or ix.default_path(path)
    try:
        manifest = ix.read_manifest(at)
    except ix.IndexCorrupt:
        return SearchPlan("scan", "the index is corrupt", ix.IndexStatus(at, "CORRUPT", False))
    if manifest is None:
        discover(path, recursive)  # a path that is wrong is an error either way
        return SearchPlan("scan", "there is no index", ix.IndexStatus(at, "NONE", False))
    if manifest.version != ix.VERSION:
        return SearchPlan("scan", "the index has another format", ix.IndexStatus(at, "SCHEMA_MISMATCH", False))
    if options.extensions or options.encoding != "auto" or manifest.config != ix._config(options.limits):
        return SearchPlan("scan", "the index was built for other members, limits or encodings")
    if ix.lookups(options) is None:
        return SearchPlan("scan", "patterns have no words to look up")
    try:
        known = ix.archives_table(spark, at, manifest).persist()
        cover = ix.coverage(spark, path, known).persist()
        known_status = ix.status(spark, path, at, terms=False, cover=cover)
    except Exception as e:
        if "pyspark" not in type(e).__module__:
            raise
        known_status = ix.IndexStatus(at, "CORRUPT", False)
    if known_status.state not in ("READY", "STALE", "BUILDING"):
        return SearchPlan("scan", f"the index is {known_status.state}", known_status)
    try:
        uncovered = sorted(r["archive"] for r in cover.filter("state IN ('new', 'changed')").collect())
        names = cover.filter("state = 'fresh'").select("relative", "archive")
        found = ix.candidates(spark, at, options, known).join(names, "relative").select("archive", "route", "line").persist()
        by_member = found.groupBy("archive", "route").agg(F.count(F.lit(1)).alias("n")).limit(PLAN_MEMBERS + 1).collect()
    finally:
        cover.unpersist()
        known.unpersist()
    if len(by_member) > PLAN_MEMBERS:
        return SearchPlan("scan", "candidates are in too many members", known_status)
    routes: dict[str, list[tuple[int, ...]]] = {}
    for r in by_member:
        routes.setdefault(r["archive"], []).append(tuple(r["route"]))
    n = sum(r["n"] for r in by_member)
    counts = {"candidate_records": n, "candidate_archives": len(routes), "candidate_members": len(by_member)}
    if known_status.archives and known_status.members and len(routes) >= BROAD * known_status.archives and len(by_member) >= BROAD * known_status.members:
        return SearchPlan("scan", "candidates are nearly everywhere", known_status, **counts)
    if uncovered:
        return SearchPlan("hybrid", "the index covers some archives", known_status, **counts, scan_archives=uncovered, routes=routes, candidates=found)
    reason = "the index has candidates" if n else "the index has no candidate"
    return SearchPlan("index", reason, known_status, **counts, routes=routes, candidates=found)
