"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .engine import annotate, finished, limited
from .functions import entities as ent
from .functions import paths
from .functions.text import normalized, phone_components, phone_digits, tokens
from .functions.width import cells
from .operators import context, evidence, grouping, provenance, ranking
from .options import SafetyLimits, SearchOptions
from .sources.archives import validated
from .sources.tables import document_records, read_table, records_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lines of documents in SQL.
REC = r"""rec AS (
    SELECT archive, member, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (
        SELECT source AS archive, doc_id || '.txt' AS member, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS l
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)))"""
NORMAL = r"trim(regexp_replace(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ё', 'е'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
PHONE = f"CASE WHEN length({DIGITS}) = 11 AND {DIGITS}[1] = '8' THEN '7' || substring({DIGITS}, 2) ELSE {DIGITS} END"
NORMED = f"WITH {REC}, norm AS (SELECT *, {NORMAL.format('text')} AS n, {PHONE.format('text')} AS pd FROM rec)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(df: DataFrame, *more) -> DataFrame:
    return df.select("archive", "member", "line", *more)


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumn("n", normalized(F.col("text"))).withColumn("pd", phone_digits(F.col("text")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# literal and regular expressions


@query(f"WITH {REC} SELECT archive, member, line, text FROM rec WHERE contains(lower(text), 'licensed under')")
def literal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(("LICENSED under",))), "text")


@query(f"WITH {REC} SELECT archive, member, line, text FROM rec WHERE contains(text, 'The and')")
def literal_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(("The and",), case_sensitive=True)), "text")


@query(
    f"""WITH {REC} SELECT archive, member, line, array_to_string(list_filter([CASE WHEN contains(lower(text), 'token') THEN 'token' END, CASE WHEN contains(lower(text), 'qué') THEN 'QUÉ' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END], lambda x: x IS NOT NULL), '|') AS patterns
    FROM rec WHERE contains(lower(text), 'token') OR contains(lower(text), 'qué') OR contains(lower(text), 'license')"""
)
def literal_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(("token", "QUÉ", "license"))), F.array_join("patterns", "|").alias("patterns"))


@query(rf"WITH {REC} SELECT archive, member, line, text FROM rec WHERE regexp_matches(text, '(?i)\btoken\s*=\s*.[0-9a-f]{{40}}')")
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions((r"\btoken\s*=\s*.[0-9a-f]{40}",), regex=True)), "text")


@query(rf"WITH {REC} SELECT archive, member, line, text FROM rec WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}') OR regexp_matches(text, '(?i)(^|\s)mit\s')")
def regex_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions((r"[0-9]{3}-[0-9]{4}", r"(?:^|\s)mit\s"), regex=True)), "text")


# text functions


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", normalized(F.col("text")).alias("normal"))


@query(f"{NORMED}, tok AS (SELECT unnest(list_filter(string_split(n, ' '), lambda x: x <> '')) AS token FROM norm) SELECT token, count(*) AS n FROM tok GROUP BY token")
def tokens_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_records(spark, sf_dir).select(F.explode(tokens(normalized(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT archive, member, line, {PHONE.format('text')} AS digits FROM rec WHERE {PHONE.format('text')} <> ''")
def phone_digits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(document_records(spark, sf_dir), phone_digits(F.col("text")).alias("digits")).filter("digits <> ''")


_COMPONENTS = rf"list_filter(list_transform(regexp_extract_all({{0}}, '\+?[0-9](?:[0-9(). -]*[0-9])?'), lambda c: {PHONE.format('c')}), lambda c: length(c) >= 7)"


@query(f"WITH {REC} SELECT archive, member, line, array_to_string({_COMPONENTS.format('text')}, ',') AS phones FROM rec WHERE len({_COMPONENTS.format('text')}) > 0")
def phone_components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _place(document_records(spark, sf_dir), phone_components(F.col("text")).alias("p")).filter(F.size("p") > 0)
    return _place(rows, F.array_join("p", ",").alias("phones"))


@query(f"SELECT c_custkey, array_to_string({_COMPONENTS.format('c_name')}, ',') AS phones FROM customer")
def phone_components_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(phone_components(F.col("c_name")), ",").alias("phones"))


@query("SELECT doc_id, length(text) + 2 * length('漢字') + length('é') AS cells FROM documents")
def cell_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of documents with wide characters and a combining mark behind them."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", cells(F.concat("text", F.lit("漢字e\u0301"))).cast("long").alias("cells"))


# ranked search


def _smart_sql(*tokens: str, digits: str = "") -> str:
    """The ranking rules for a pattern of these normalised words, by the lists of words of pattern and record."""
    words, k = f"[{', '.join(repr(t) for t in tokens)}]", len(tokens)
    held = "string_split(n, ' ')"
    full = f"len(list_filter({words}, lambda w: list_contains({held}, w)))"
    starts = f"len(list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains({held}, w) AND len(list_filter({held}, lambda h: starts_with(h, w))) > 0))"
    phone = f"WHEN contains(pd, '{digits}') THEN 520 " if len(digits) >= 7 else ""
    return f"""(CASE {phone}WHEN contains(n, '{' '.join(tokens)}') THEN {500 + min(k, 9)} WHEN {full} = {k} THEN {400 + k} WHEN {full} > 0 AND {full} + {starts} = {k} THEN 300 + 10 * {full} + {starts}
        WHEN {full} > 0 THEN 100 + 10 * {full} WHEN {starts} > 0 THEN 70 + {starts} ELSE 0 END)"""


@query(f"{NORMED}, s AS (SELECT archive, member, line, {_smart_sql('the', 'mit', 'license')} AS score FROM norm) SELECT archive, member, line, CAST(score AS INT) AS score FROM s WHERE score > 0")
def smart_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(("the MIT license",), smart=True, unicode="fast")), "score")


@query(f"{NORMED}, s AS (SELECT archive, member, line, text, {_smart_sql('thereof', 'the', 'over')} AS score FROM norm) SELECT archive, member, line, text, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, archive, member, line LIMIT 100")
def smart_score_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = SearchOptions(("thereof the over",), smart=True, unicode="fast", max_matches=100)
    return _place(limited(annotate(document_records(spark, sf_dir), o), o), "text", "score")


_MULTI = ("Straße und", "released MIT", "de la")
_MULTI_WORDS = (("strasse", "und"), ("released", "mit"), ("de", "la"))


@query(
    f"""{NORMED}, s AS (SELECT archive, member, line, {', '.join(f'{_smart_sql(*p)} AS s{i}' for i, p in enumerate(_MULTI_WORDS))} FROM norm)
    SELECT archive, member, line, CAST(greatest(s0, s1, s2) AS INT) AS score, CASE greatest(s0, s1, s2) WHEN s0 THEN '{_MULTI[0]}' WHEN s1 THEN '{_MULTI[1]}' ELSE '{_MULTI[2]}' END AS pattern FROM s WHERE greatest(s0, s1, s2) > 0"""
)
def smart_multi_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(_MULTI, smart=True, unicode="fast")), "score", F.col("patterns")[0].alias("pattern"))


@query(f"WITH c AS (SELECT *, {NORMAL.format('c_name')} AS n, {PHONE.format('c_name')} AS pd FROM customer) SELECT c_custkey, CAST({_smart_sql('customer', '0000012', digits='0000012')} AS INT) AS score FROM c WHERE {_smart_sql('customer', '0000012', digits='0000012')} > 0")
def smart_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_from(_table(spark, sf_dir, "customer"), F.col("c_name"), F.lit("customer"), F.col("c_custkey"))
    found = annotate(rows, SearchOptions(("Customer 0000012",), smart=True, unicode="fast"))
    return found.select(F.col("member").cast("long").alias("c_custkey"), "score")


@query(
    f"""{NORMED}, s AS (SELECT {_smart_sql('en', 'la', 'de')} AS score FROM norm)
    SELECT CASE WHEN score = 520 THEN 'phone' WHEN score > 500 THEN 'phrase' WHEN score > 400 THEN 'all_tokens' WHEN score > 300 THEN 'prefix_tokens' WHEN score > 100 THEN 'partial_tokens' ELSE 'prefix_partial' END AS match_type, count(*) AS n FROM s WHERE score > 0 GROUP BY 1"""
)
def smart_match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(document_records(spark, sf_dir), SearchOptions(("en la de",), smart=True, unicode="fast")).groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


# the Boolean language


def _advanced(source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _place(annotate(document_records(spark, sf_dir), SearchOptions(advanced=source, unicode="fast")))

    return run


for _name, (_source, _where) in {
    "advanced_and_or_not": ('("the and" OR licensed) AND NOT (token OR mit)', "(contains(n, 'the and') OR contains(n, 'licensed')) AND NOT contains(n, 'token') AND NOT contains(n, 'mit')"),
    "advanced_implicit_and": ("der die NOT und", "contains(n, 'der') AND contains(n, 'die') AND NOT contains(n, 'und')"),
    "advanced_prefix": ("licen* AND NOT gnu", "len(list_filter(string_split(n, ' '), lambda w: starts_with(w, 'licen'))) > 0 AND NOT contains(n, 'gnu')"),
    "advanced_fields": ('format:txt archive:src1 AND (member:"11 txt" OR "all rights")', "starts_with(archive, 'src1') AND (ends_with(member, '11.txt') OR contains(n, 'all rights'))"),
    "advanced_phone_email": ("phone:2669109448945250 OR email:@mail", "contains(pd, '2669109448945250') OR contains(lower(text), '@mail')"),
}.items():
    QUERIES[_name] = _advanced(_source)
    ORACLES[_name] = f"{NORMED} SELECT archive, member, line FROM norm WHERE {_where}"


# entities


def _entity_rows(spark: SparkSession, sf_dir: str, found) -> DataFrame:
    return document_records(spark, sf_dir).select("archive", "member", "line", F.explode(found(F.col("text"))).alias("value"))


def _entity_sql(shape: str, then: str = "lower(v)") -> str:
    return f"WITH {REC}, e AS (SELECT archive, member, line, unnest(regexp_extract_all(text, '{shape}')) AS v FROM rec) SELECT DISTINCT archive, member, line, {then} AS value FROM e"


@query(_entity_sql("(?i)" + ent.EMAIL))
def entities_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(spark, sf_dir, ent.emails)


@query(_entity_sql("(?i)" + ent.EMAIL, "lower(string_split(v, '@')[-1])"))
def entities_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(spark, sf_dir, ent.email_domains)


@query(r"""SELECT page_id, rtrim(regexp_extract(url, '(?i)https?://[^\s<>"'']+'), '.,;:!?)]') AS url, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages""")
def entities_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", ent.urls(F.col("url"))[0].alias("url"), ent.url_hosts(F.col("url"))[0].alias("host"))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(_entity_sql(rf"(?:^|[^\w:.])({_OCTET}(?:\.{_OCTET}){{3}})(?:$|[^\w:.])", "v").replace("')) AS v", "', 1)) AS v"))
def entities_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(spark, sf_dir, ent.ipv4s)


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(md5(doc_id::VARCHAR)[1:8] || '-' || md5(doc_id::VARCHAR)[9:12] || '-4' || md5(doc_id::VARCHAR)[14:16] || '-a' || md5(doc_id::VARCHAR)[18:20] || '-' || md5(doc_id::VARCHAR)[21:32]), '" + ent.UUID + "')) AS uuid FROM documents")
def entities_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5(F.col("doc_id").cast("string"))
    text = F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-4"), F.substring(m, 14, 3), F.lit("-a"), F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(ent.uuids(F.concat(F.lit("id "), text, F.lit(".")))).alias("uuid"))


@query(_entity_sql("(?i)" + ent.DIGEST, "lower(v) AS value, CASE length(v) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' END").replace("AS value FROM e", "AS kind FROM e"))
def entities_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_rows(spark, sf_dir, ent.digests).withColumn("kind", ent.digest_kind(F.col("value"))).filter("kind IS NOT NULL")


#: (kind, order, what is written, what it stands for) of the entities of a record; addresses of version 6, URLs and UUIDs have their own queries.
_ENTITIES = f"""found AS (
    SELECT *, 'email' AS kind, 0 AS nth, unnest(regexp_extract_all(text, '(?i){ent.EMAIL}')) AS v FROM rec
    UNION ALL SELECT *, 'domain', 1, unnest(regexp_extract_all(text, '(?i){ent.EMAIL}')) FROM rec
    UNION ALL SELECT *, 'ipv4', 3, unnest(regexp_extract_all(text, '(?:^|[^\\w:.])({_OCTET}(?:\\.{_OCTET}){{3}})(?:$|[^\\w:.])', 1)) FROM rec
    UNION ALL SELECT *, 'digest', 5, unnest(regexp_extract_all(text, '(?i){ent.DIGEST}')) FROM rec
), entity AS (
    SELECT archive, member, line, text, strpos(text, v) AS place, nth, CASE kind WHEN 'digest' THEN CASE length(v) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' END ELSE kind END AS kind,
        CASE kind WHEN 'domain' THEN lower(string_split(v, '@')[-1]) WHEN 'ipv4' THEN v ELSE lower(v) END AS value FROM found
)"""


@query(f"WITH {REC}, {_ENTITIES} SELECT DISTINCT archive, member, line, kind, value FROM entity WHERE kind IS NOT NULL")
def entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_records(spark, sf_dir)
    return rows.select("archive", "member", "line", F.explode(ent.entities(F.col("text"))).alias("e")).select("archive", "member", "line", "e.kind", "e.value")


# groups and counts


@query(f"WITH {REC} SELECT text AS key, count(*) AS n FROM rec GROUP BY text")
def group_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_counts(document_records(spark, sf_dir), "exact")


@query(f"WITH {REC} SELECT coalesce({_COMPONENTS.format('text')}[1], text) AS key, count(*) AS n FROM rec GROUP BY 1")
def group_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_counts(document_records(spark, sf_dir), "phone")


@query(f"WITH {REC} SELECT coalesce(lower(regexp_extract_all(text, '(?i){ent.EMAIL}')[1]), text) AS key, count(*) AS n FROM rec GROUP BY 1")
def group_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_counts(document_records(spark, sf_dir), "email")


@query(f"WITH {REC} SELECT text AS key, count(*) AS n, string_agg(archive || '/' || member || ':' || line, ' ' ORDER BY archive, member, line) AS places FROM (SELECT * FROM rec WHERE contains(lower(text), 'license') ORDER BY archive, member, line LIMIT 1000) GROUP BY text")
def group_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = SearchOptions(("license",))
    rows = ranking.top(annotate(document_records(spark, sf_dir), o), o.max_matches, ("archive", "member", "line"))
    from pyspark.sql import Window

    numbered = rows.withColumn("ordinal", F.row_number().over(Window.orderBy("archive", "member", "line"))).select("ordinal", "archive", "member", "line", "text")
    groups = grouping.group_matches(numbered, "exact")
    places = F.array_join(F.transform("occurrences", lambda m: F.concat(m["archive"], F.lit("/"), m["member"], F.lit(":"), m["line"].cast("string"))), " ")
    return groups.select("key", "n", places.alias("places"))


@query(
    f"""WITH {REC}, {_ENTITIES}, first AS (SELECT archive, member, line, arg_min(value, place * 10 + nth) AS value FROM entity WHERE kind IS NOT NULL GROUP BY archive, member, line)
    SELECT coalesce(f.value, r.text) AS key, count(*) AS n FROM rec r LEFT JOIN first f ON f.archive = r.archive AND f.member = r.member AND f.line = r.line GROUP BY 1"""
)
def group_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_counts(document_records(spark, sf_dir), "entity")


@query(f"WITH {REC} SELECT archive, count(*) AS matches, count(DISTINCT member) AS members FROM rec WHERE contains(lower(text), 'the ') GROUP BY archive")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.counts(annotate(document_records(spark, sf_dir), SearchOptions(("the ",))))


@query(f"{NORMED}, s AS (SELECT archive, member, line, {_smart_sql('licensed', 'under', 'the')} AS score FROM norm) SELECT archive, member, CAST(max(score) AS INT) AS best, count(*) AS n, count(DISTINCT line) AS lines FROM s WHERE score > 0 GROUP BY archive, member")
def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.tree(annotate(document_records(spark, sf_dir), SearchOptions(("licensed under the",), smart=True, unicode="fast"))).select("archive", "member", "best", "n", "lines")


# context, order, caps


@query(
    """SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
    coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after FROM conversations"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.context_window(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 2)
    return rows.select("conv_id", "turn", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(
    f"""WITH {REC}, hit AS (SELECT * FROM rec WHERE contains(lower(text), 'mit license') ORDER BY archive, member, line LIMIT 200)
    SELECT h.archive, h.member, h.line, coalesce((SELECT string_agg(r.text, '|' ORDER BY r.line) FROM rec r WHERE r.archive = h.archive AND r.member = h.member AND r.line BETWEEN h.line - 2 AND h.line - 1), '') AS before,
    coalesce((SELECT string_agg(r.text, '|' ORDER BY r.line) FROM rec r WHERE r.archive = h.archive AND r.member = h.member AND r.line BETWEEN h.line + 1 AND h.line + 2), '') AS after FROM hit h"""
)
def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = document_records(spark, sf_dir)
    rows = ranking.top(annotate(records, SearchOptions(("MIT license",))), 200, ("archive", "member", "line"))
    near = context.context_join(rows, records, ["archive", "member"], "line", "text", 2)
    return _place(near, F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(f"WITH {REC} SELECT archive, member, line, text FROM rec WHERE contains(lower(text), 'the ') QUALIFY row_number() OVER (PARTITION BY archive ORDER BY member, line) <= 5")
def per_archive_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(ranking.cap_per(annotate(document_records(spark, sf_dir), SearchOptions(("the ",))), "archive", 5, ("member", "line")), "text")


@query(f"WITH {REC} SELECT archive, member, line, text FROM rec WHERE contains(lower(text), 'the ') ORDER BY archive, member, line LIMIT 50")
def global_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(ranking.top(annotate(document_records(spark, sf_dir), SearchOptions(("the ",))), 50, ("archive", "member", "line")), "text")


@query(f"WITH {REC} SELECT r.archive, r.member, r.line, f.text AS header FROM rec r JOIN rec f ON f.archive = r.archive AND f.member = r.member AND f.line = 1")
def header_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(context.with_header(document_records(spark, sf_dir).drop("header"), ["archive", "member"], "line", "text"), "header")


# provenance

_CSV = "c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || c_nationkey"


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN contains(lower(CAST(c_custkey AS VARCHAR)), 'build') OR contains(CAST(c_custkey AS VARCHAR), '12') THEN 'key' END, CASE WHEN contains(lower(c_name), 'build') OR contains(c_name, '12') THEN 'name' END,
    CASE WHEN contains(lower(c_mktsegment), 'build') OR contains(c_mktsegment, '12') THEN 'segment' END, CASE WHEN contains(CAST(c_nationkey AS VARCHAR), '12') THEN 'nation' END], lambda x: x IS NOT NULL), ', ') AS fields FROM customer
    WHERE contains(lower(c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || c_nationkey), 'build') OR contains(c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || c_nationkey, '12')"""
)
def provenance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    records = c.select(F.lit("customer").alias("archive"), F.lit("customer.csv").alias("member"), F.array().cast("array<string>").alias("nested_path"), F.array().cast("array<int>").alias("route"), (F.col("c_custkey") + 2).alias("line"), row.alias("text"), F.lit("key,name,segment,nation").alias("header"), "c_custkey")
    found = annotate(records, SearchOptions(("BUILD", "12")))
    # all patterns count as evidence, as a literal search's rows hold those that matched
    pairs = provenance.provenance(F.col("member"), F.col("line"), F.col("text"), F.col("header"), F.array(F.lit("BUILD"), F.lit("12")))
    return found.select("c_custkey", F.coalesce(provenance.as_map(pairs)["fields"], F.lit("")).alias("fields"))


@query("SELECT event_id, array_to_string(json_keys(props), ', ') AS keys FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", provenance.keys(F.col("props")).alias("keys"))


@query(f"WITH {REC} SELECT archive, member, line, 'literal' AS match_type, 0 AS score, 'record=' || line AS provenance, 'mit license' AS patterns FROM rec WHERE contains(lower(text), 'mit license')")
def match_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(document_records(spark, sf_dir), SearchOptions(("mit license",)))
    pairs = provenance.provenance(F.col("member"), F.col("line"), F.col("text"), F.col("header"), F.col("patterns"))
    return _place(found, "match_type", "score", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("provenance"), F.array_join("patterns", ",").alias("patterns"))


@query(f"WITH {REC}, hit AS (SELECT * FROM rec WHERE contains(lower(text), 'license') ORDER BY archive, member, line LIMIT 300) SELECT archive, member, line, CAST(strpos(lower(text), 'license') - 1 AS INT) AS start, CAST(strpos(lower(text), 'license') + 6 AS INT) AS finish FROM hit")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = SearchOptions(("License",))
    rows = ranking.top(annotate(document_records(spark, sf_dir), o), 300, ("archive", "member", "line"))
    spans = rows.withColumn("s", evidence.evidence(o, F.col("text"), F.col("patterns"), F.col("match_type")))
    return _place(spans, F.col("s.text_spans")[0]["start"].alias("start"), F.col("s.text_spans")[0]["end"].alias("finish"))


# paths


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '/a.TXT' WHEN 1 THEN '/b.csv' WHEN 2 THEN '/c.exe' ELSE '/d.json' END AS name FROM pages)
    SELECT page_id, name FROM p WHERE page_id % 4 <> 2 AND (regexp_matches(name, '/en/') OR regexp_matches(name, '[.]json$')) AND NOT regexp_matches(name, '/b[.]csv$')"""
)
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ("/a.TXT", "/b.csv", "/c.exe", "/d.json"))), (F.col("page_id") % 4 + 1).cast("int"))
    names = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("name"))
    return names.filter(paths.wanted(F.col("name"), include=("*/en/*", "*.json"), exclude=("b.csv",)))


@query(
    """WITH m AS (SELECT CAST(l_orderkey AS VARCHAR) AS archive, l_linenumber, CASE l_linenumber WHEN 1 THEN '../up.txt' WHEN 2 THEN '/root.txt' ELSE 'd/' || l_partkey || '.txt' END AS member, l_partkey AS file_size, l_suppkey AS compress_size, l_linenumber = 3 AS encrypted FROM lineitem)
    SELECT archive, l_linenumber, CASE WHEN sum(file_size) OVER w > 6000 THEN 'expanded size' WHEN member LIKE '../%' OR member LIKE '/%' THEN 'unsafe path' WHEN encrypted THEN 'encrypted' WHEN file_size > 1800 THEN 'oversized' WHEN file_size / greatest(compress_size, 1) > 30 THEN 'compression ratio' END AS reject_reason
    FROM m WINDOW w AS (PARTITION BY archive)"""
)
def member_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.when(n == 1, "../up.txt").when(n == 2, "/root.txt").otherwise(F.concat(F.lit("d/"), F.col("l_partkey").cast("string"), F.lit(".txt")))
    m = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("archive"), "l_linenumber", name.alias("member"), F.col("l_partkey").alias("file_size"), F.col("l_suppkey").alias("compress_size"), (n == 3).alias("encrypted"), F.lit(False).alias("is_dir"))
    return validated(m, SafetyLimits(max_member_bytes=1800, max_total_bytes=6000, max_compression_ratio=30.0)).select("archive", "l_linenumber", "reject_reason")


# renderers


@query(f"WITH {REC} SELECT archive || ':' || member || ':' || line || ': ' || text AS value FROM rec WHERE contains(lower(text), 'mit license')")
def render_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(document_records(spark, sf_dir), SearchOptions(("mit license",))).select(render.human_column().alias("value"))


@query(f"WITH {REC} SELECT archive, member, line, '{{\"archive\":\"' || archive || '\",\"line\":' || line || ',\"member\":\"' || member || '\"}}' AS value FROM rec WHERE contains(lower(text), 'mit license')")
def render_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _place(annotate(document_records(spark, sf_dir), SearchOptions(("mit license",))), render.json_column(["archive", "line", "member"]).alias("value"))


@query(f"WITH {REC} SELECT archive, member, line, text FROM rec WHERE contains(lower(text), 'token') ORDER BY archive, line, member LIMIT 1000")
def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every document is a member of its own: its number stands for its place in the archive
    o = SearchOptions(("token",))
    records = document_records(spark, sf_dir)
    rows = ranking.top(annotate(records, o), o.max_matches, ("archive", "line", "member")).withColumn("ordinal", F.lit(0))
    return _place(finished(rows, o), "text")
