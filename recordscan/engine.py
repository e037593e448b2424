"""Searches over records, whatever provider they come from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import suffix
from .functions.text import normalized, phone_digits
from .operators import advanced, context, evidence, grouping, match, provenance, ranking, smart
from .options import SearchOptions
from .schema import MATCH
from .sources.archives import ReadOptions, issues_of, read_tagged, records_of, stats_of


def annotate(records: DataFrame, options: SearchOptions) -> DataFrame:
    """Records that match, with patterns, score and match_type."""
    text, mode = F.col("text"), options.mode
    if mode in ("literal", "regex"):
        patterns = match.matched_patterns(text, options.patterns, options.regex, options.case_sensitive)
        # the plain disjunction first: it can be pushed down and costs no array
        hit = records.filter(match.any_pattern(text, options.patterns, options.regex, options.case_sensitive))
        return hit.select("*", patterns.alias("patterns"), F.lit(0).alias("score"), F.lit(mode).alias("match_type"))
    exact = options.unicode == "exact"
    with_normal = records.withColumn("_normal", normalized(text, options.case_sensitive and mode == "smart", exact)).withColumn("_digits", phone_digits(text))
    if mode == "smart":
        compiled = smart.compile_patterns(options.patterns, options.case_sensitive)
        best = smart.best_rows(with_normal, compiled)
        return best.select(*records.columns, F.array("_best.pattern").alias("patterns"), F.col("_best.score").alias("score"), F.col("_best.match_type").alias("match_type"))
    tree = advanced.parse(options.advanced)
    terms = advanced.positive_terms(tree)
    evidence_terms = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    fielded = {f"_{k}": v for k, v in advanced_columns(tree, exact, evidence_terms).items()}
    inputs = {"normal": F.col("_normal"), "text": text, "digits": F.col("_digits"), "member_name": F.col("member")} | {k[1:]: F.col(k) for k in fielded}
    hit = (with_normal.withColumns(fielded) if fielded else with_normal).withColumn("_row", F.monotonically_increasing_id())
    # the row number keeps the filter above the normalised text, which it refers to once for each term
    hit = hit.filter(advanced.predicate(tree, inputs) & (F.col("_row") >= 0))
    return hit.select(*records.columns, evidence_terms.alias("patterns"), F.lit(0).alias("score"), F.lit("advanced").alias("match_type"))


def _fields_of(tree) -> set[str]:
    if isinstance(tree, advanced.Term):
        return {tree.field} if tree.field else set()
    parts = [tree.of] if isinstance(tree, advanced.Negation) else tree.parts
    return set().union(*(_fields_of(p) for p in parts))


def advanced_columns(tree, exact: bool, terms: Column) -> dict[str, Column]:
    """What a query's named fields hold, normalised; only those that it uses."""
    used = _fields_of(tree)
    text, member = F.col("text"), F.col("member")
    columns: dict[str, Column] = {}
    fold = lambda c: normalized(c, False, exact)
    quick = lambda c: normalized(c)  # noqa: E731  names of tables and columns are folded in the JVM
    if "archive" in used:
        columns["archive"] = fold(F.col("archive"))
    if "member" in used:
        columns["member"] = fold(member)
    if "table" in used:
        columns["table"] = quick(F.when(suffix(member).isin(".db", ".sqlite", ".sqlite3"), provenance.table_name(text)))
    if "fields" in used:
        of = lambda d: provenance.fields(text, F.col("header"), F.col("line"), d, terms)
        columns["fields"] = quick(F.when(suffix(member) == ".csv", of(",")).when(suffix(member) == ".tsv", of("\t")))
    return columns


def order_of(options: SearchOptions) -> tuple[str, ...]:
    return ranking.BY_SCORE if options.mode in ("smart", "advanced") else ranking.BY_PLACE


def limited(annotated: DataFrame, options: SearchOptions) -> DataFrame:
    """The rows a search shows, with their ordinal: the best ones of a smart search, else the first ones by place."""
    n = options.max_matches
    keys = order_of(options)
    rows = ranking.top(annotated, n, keys)
    from pyspark.sql import Window

    order = Window.orderBy(*(F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys))
    return rows.withColumn("ordinal", F.row_number().over(order))  # of max_matches rows at most


def finished(rows: DataFrame, options: SearchOptions, path: str = "scan") -> DataFrame:
    """Limited rows as matches: spans, provenance; context columns are taken over or empty."""
    spans = evidence.evidence(options, F.col("text"), F.col("patterns"), F.col("match_type"))
    out = rows.withColumn("_spans", spans)
    empty = F.array().cast("array<string>")
    for c in ("context_before", "context_after"):
        if c not in rows.columns:
            out = out.withColumn(c, empty)
    if "execution_path" not in rows.columns:
        out = ranking.tagged(out, path)
    out = out.withColumns({"text_spans": F.col("_spans.text_spans"), "query_spans": F.col("_spans.query_spans"), "provenance": provenance.provenance(F.col("member"), F.col("line"), F.col("text"), F.col("header"), F.col("patterns"))})
    return out.select("ordinal", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH)).orderBy("ordinal")


def search_records(records: DataFrame, options: SearchOptions) -> DataFrame:
    """A whole search over any records (archive, member, nested_path, route, line, text, header)."""
    options.check()
    rows = limited(annotate(records, options), options)
    if options.context:
        rows = context.context_join(rows, records, ["archive", "member", "route"], "line", "text", options.context)
    return finished(rows, options)


@dataclass
class Result:
    """Matches in order (a DataFrame of at most max_matches rows), issues, and the counts of a search."""

    matches: DataFrame
    issues: DataFrame
    summary: dict
    plan: object
    _held: list[DataFrame] = field(default_factory=list)

    def groups(self, mode: str) -> DataFrame:
        return grouping.group_matches(self.matches, mode)

    def tree(self) -> DataFrame:
        return grouping.tree(self.matches)

    def close(self) -> None:
        for df in self._held:
            df.unpersist()


def search(spark: SparkSession, path: str, options: SearchOptions, index_path: str | None = None, recursive: bool = True, force_scan: bool = False) -> Result:
    """Search archives, through the index where the planner finds that it pays."""
    from .plans import planner

    options.check()
    plan = planner.plan_search(spark, path, options, index_path, recursive, force_scan)
    read = ReadOptions.of(options)
    legs: list[tuple[str, DataFrame, DataFrame | None]] = []
    if plan.execution in ("index", "hybrid") and plan.routes:
        legs.append(("index", read_tagged(spark, path, read, recursive, archives=sorted(plan.routes), routes=plan.routes), plan.candidates))
    if plan.execution in ("scan", "hybrid"):
        archives = plan.scan_archives if plan.execution == "hybrid" else None
        if archives is None or archives:
            legs.append(("scan", read_tagged(spark, path, read, recursive, archives=archives), None))
    held, matches, rest = [plan.candidates] if plan.candidates is not None else [], None, None
    for tag, tagged, wanted in legs:
        records = records_of(tagged)
        if wanted is not None:
            records = records.join(wanted, ["archive", "route", "line"], "left_semi")
        one = tagged.filter("kind <> 'record'").unionByName(ranking.tagged(annotate(records, options), tag).withColumn("kind", F.lit("match")), allowMissingColumns=True)
        one = one.persist(StorageLevel.DISK_ONLY)
        held.append(one)
        m, r = one.filter("kind = 'match'"), one.filter("kind <> 'match'")
        matches, rest = (m, r) if matches is None else (matches.unionByName(m), rest.unionByName(r))
    if matches is None:
        empty = read_tagged(spark, path, read, recursive, archives=[])
        matches, rest = ranking.tagged(annotate(records_of(empty), options), "index").withColumn("kind", F.lit("match")), empty
    # the cap holds for each archive, then for the whole
    capped = ranking.cap_per(matches, "archive", options.max_matches, order_of(options))
    rows = limited(capped, options).persist(StorageLevel.DISK_ONLY)
    held.append(rows)
    if options.context:
        near = {}
        for r in rows.select("archive", "route").distinct().collect():  # max_matches at most
            near.setdefault(r["archive"], []).append(tuple(r["route"]))
        if near:
            around = records_of(read_tagged(spark, path, read, recursive, archives=sorted(near), routes=near))
            rows = context.context_join(rows, around, ["archive", "route"], "line", "text", options.context)
    over = matches.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > options.max_matches) if options.mode in ("literal", "regex") else None
    issues = issues_of(rest)
    if over is not None:
        issues = issues.unionByName(over.select("archive", F.lit(None).cast("string").alias("member"), F.lit("there are more matches than were asked for").alias("message"), F.lit("limit").alias("issue")))
    out = finished(rows, options)
    n_issues = issues.filter("issue <> 'limit'").count()
    summary = grouping.summary(stats_of(rest), out.count(), n_issues, plan.execution).first().asDict()
    return Result(out, issues, summary, plan, held)


def related_options(kind: str, value: str, options: SearchOptions) -> SearchOptions:
    """The search that follows from an entity: a telephone number as a smart one with its plus sign, others as they are written."""
    if kind == "phone":
        return replace(options, patterns=("+" + value.lstrip("+"),), smart=True, regex=False, advanced=None)
    return replace(options, patterns=(value,), smart=False, regex=False, advanced=None)


def split_patterns(text: str) -> tuple[str, ...]:
    """Patterns written with commas between them."""
    return tuple(p.strip() for p in text.split(",") if p.strip())
