import random
import re

import pytest
from pyspark.sql import functions as F

from recordscan.engine import annotate, related_options, search_records, split_patterns
from recordscan.operators import advanced, evidence, grouping, provenance, ranking
from recordscan.options import ConfigurationError, SearchOptions
from recordscan.sources.tables import records_from

from .helpers import model_score


def lines(spark, texts, member="m.txt", archive="a.zip", header=None):
    df = spark.createDataFrame([("\n".join(texts),)], "t string")
    return records_from(df, F.col("t"), F.lit(archive), F.lit(member), F.lit(header) if header else None)


def found(rows):
    return [(r["line"], r["text"]) for r in rows.orderBy("line").collect()]


def test_records_of_texts_with_all_line_ends(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",), ("",), (None,)], "t string")
    got = records_from(df, F.col("t"), F.lit("z"), F.lit("m"))
    assert [(r["line"], r["text"]) for r in got.collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_literal_folds_case_and_takes_patterns_as_written(spark):
    rows = lines(spark, ["Needle", "ПРИВЕТ мир", "a.b", "axb", "\\Q \\E"])
    assert found(annotate(rows, SearchOptions(("needle", "привет")))) == [(1, "Needle"), (2, "ПРИВЕТ мир")]
    assert found(annotate(rows, SearchOptions(("a.b",)))) == [(3, "a.b")]
    assert found(annotate(rows, SearchOptions(("\\q \\e",)))) == [(5, "\\Q \\E")]
    assert found(annotate(rows, SearchOptions(("needle",), case_sensitive=True))) == []


def test_literal_names_the_patterns_that_matched(spark):
    rows = annotate(lines(spark, ["one two", "two", "three"]), SearchOptions(("two", "one")))
    assert [r["patterns"] for r in rows.orderBy("line").collect()] == [["two", "one"], ["two"]]


@pytest.mark.parametrize("pattern", [r"\bn\w+e\b", r"(?P<x>\d)(?P=x)", r"[а-я]+$", r"a{2,3}", r"^\s*#", r"(?i:AB)c", r"x(?=y)", r"[[]"])
def test_regex_agrees_with_python(spark, pattern):
    texts = ["needle nose", "1123", "Жизнь", "xaaay", "  # c", "abC ABc", "xy xz", "a[b", "", "émigré"]
    got = found(annotate(lines(spark, texts), SearchOptions((pattern,), regex=True)))
    assert [t for _, t in got] == [t for t in texts if re.search(pattern, t, re.I)]


def test_smart_scores_follow_the_rules(spark):
    r = random.Random(1)
    words = ["anna", "ann", "lee", "leeds", "ivan", "iv", "89001234567", "x"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(150)] + ["+7 (900) 123-45-67", "Anna-Lee", "ANNALEE"]
    for patterns in (["anna lee"], ["lee anna", "iv"], ["8 900 123 45 67"], ["ann lee iv x"]):
        rows = annotate(lines(spark, texts), SearchOptions(tuple(patterns), smart=True))
        got = {row["line"]: (row["score"], row["match_type"], row["patterns"][0]) for row in rows.collect()}
        assert got == {i + 1: m for i, t in enumerate(texts) if (m := model_score(t, patterns))}


def test_smart_finds_late_strong_matches_under_a_cap(spark):
    texts = ["anna"] * 200 + ["anna lee"]
    got = search_records(lines(spark, texts), SearchOptions(("anna lee",), smart=True, max_matches=3)).collect()
    assert [(m["line"], m["score"]) for m in got] == [(201, 502), (1, 110), (2, 110)]


def test_smart_phrase_is_not_bounded_by_tokens(spark):
    assert [r["match_type"] for r in annotate(lines(spark, ["needles"]), SearchOptions(("edle",), smart=True)).collect()] == ["phrase"]


def test_context_is_a_frame_even_for_neighbouring_matches(spark):
    got = search_records(lines(spark, ["a", "hit 1", "hit 2", "b", "c"]), SearchOptions(("hit",), context=2)).collect()
    assert [(m["context_before"], m["context_after"]) for m in got] == [(["a"], ["hit 2", "b"]), (["a", "hit 1"], ["b", "c"])]


def test_spans_of_evidence():
    text = "Anna Lee, +7 (900) 123-45-67"
    assert evidence.smart_spans(text, "lee 89001234567", "phone") == ([(5, 8), (11, 28)], [(0, 3), (4, 15)])
    assert evidence.smart_spans("Anna Lee", "anna lee", "phrase") == ([(0, 4), (5, 8)], [(0, 4), (5, 8)])
    assert evidence.smart_spans("leeds", "lee xx", "prefix_partial") == ([(0, 5)], [(0, 3)])
    assert evidence.merged([(3, 5), (0, 2), (2, 3), (9, 9)]) == [(0, 5), (9, 9)]


def test_literal_spans_are_all_places_by_pattern(spark):
    m = search_records(lines(spark, ["😀 ab ab b"]), SearchOptions(("b", "ab"))).first()
    assert [tuple(s) for s in m["text_spans"]] == [(3, 4), (6, 7), (8, 9), (2, 4), (5, 7)]
    assert [tuple(s) for s in m["query_spans"]] == [(0, 1), (0, 2)]


def test_advanced_queries(spark):
    rows = lines(spark, ["alpha beta", "alpha gamma", "beta", "Call 900-123-4567", "mail bob@x.org", "al"], member="notes.txt")
    for query, expected in {
        "alpha AND beta": [1], "alpha beta": [1], "alpha OR beta": [1, 2, 3], "alpha NOT beta": [2], '"alpha gamma"': [2], "(alpha OR beta) AND NOT gamma": [1, 3], "gam*": [2], "phone:9001234567": [4], "phone:123": [], "email:BOB@": [5], "format:txt AND al": [1, 2, 4, 6],
        "format:csv": [], 'member:"notes txt" beta': [1, 3], "archive:zip AND mail": [5], "NOT (alpha OR beta OR al)": [5], "alpha and beta": [1], "sheet:x": [],
    }.items():
        assert [n for n, _ in found(annotate(rows, SearchOptions(advanced=query)))] == expected, query


def test_advanced_fields_of_csv(spark):
    rows = lines(spark, ["name,state", "Ann,open", "Bob,ann"], member="users.csv", header="name,state")
    assert [n for n, _ in found(annotate(rows, SearchOptions(advanced="ann AND fields:name")))] == [2]


@pytest.mark.parametrize("query", ["", "a AND (b OR", "format:", "a )", "(a", 'AND a', '"open', "NOT", "format:("])
def test_advanced_syntax_errors(query):
    with pytest.raises(ConfigurationError):
        advanced.parse(query)


def test_advanced_parse_trees_and_terms():
    t = advanced.parse('a b OR NOT format:txt "c \\" d"')
    assert advanced.positive_terms(t) == ("a", "b", 'c " d')
    assert advanced.parse("a OR b AND c").operator == "OR"


def test_provenance_by_format(spark):
    def of(member, text, line=2, header=None, patterns=()):
        df = spark.createDataFrame([(member, line, text, header, list(patterns))], "m string, l long, t string, h string, p array<string>")
        return [tuple(x) for x in df.select(provenance.provenance(F.col("m"), F.col("l"), F.col("t"), F.col("h"), F.col("p"))).first()[0]]

    assert of("p.csv", "Ann,a@x", header="name,email", patterns=["ANN"]) == [("format", "CSV"), ("record", "2"), ("fields", "name")]
    assert of("p.tsv", "Ann\tx", header="name\temail") == [("format", "TSV"), ("record", "2"), ("fields", "name, email")]
    assert of("p.csv", "name,email", line=1, header="name,email") == [("format", "CSV"), ("record", "1")]
    assert of("e.jsonl", '{"b":1,"a":2}') == [("format", "JSONL"), ("record", "2"), ("keys", "b, a")]
    assert of("e.json", "[1]") == [("format", "JSON"), ("record", "2")]
    assert of("d.sqlite", "[users] x") == [("format", "SQLite"), ("record", "2"), ("table", "users")]
    assert of("w.xlsx", "x") == [("format", "XLSX"), ("record", "2"), ("row", "2")]
    assert of("d.docx", "x") == [("format", "DOCX"), ("record", "2"), ("record", "2")]
    assert of("t.txt", "x") == [("record", "2")]


def test_groups_keep_every_occurrence(spark):
    rows = [(1, "a b@c.org"), (2, "B@C.ORG again"), (3, "+7 900 123-45-67"), (4, "8 (900) 1234567 x"), (5, "same"), (6, "same")]
    df = spark.createDataFrame(rows, "ordinal int, text string")
    of = lambda mode: [(g["key"], [m["ordinal"] for m in g["occurrences"]]) for g in grouping.group_matches(df, mode).collect()]
    assert of("exact")[-1] == ("same", [5, 6])
    assert of("email")[0] == ("b@c.org", [1, 2])
    assert ("79001234567", [3, 4]) in of("phone")
    assert of("entity")[0] == ("b@c.org", [1, 2])
    with pytest.raises(ConfigurationError):
        grouping.group_key(F.col("text"), "other")


def test_caps_and_unions(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "archive string, line int")
    assert ranking.cap_per(df, "archive", 3, ("line",)).count() == 5
    both = ranking.hybrid(df.filter("archive = 'a'"), df.filter("archive = 'b'"))
    assert {(r["archive"], r["execution_path"]) for r in both.collect()} == {("a", "index"), ("b", "scan")}


@pytest.mark.parametrize(
    "options",
    [SearchOptions(), SearchOptions(("",)), SearchOptions(("(",), regex=True), SearchOptions(("x",), smart=True, regex=True), SearchOptions(("!",), smart=True), SearchOptions(("x",), context=-1), SearchOptions(("x",), max_matches=0), SearchOptions(("x",), encoding="no-such"), SearchOptions(advanced="(")],
)
def test_wrong_requests(options):
    with pytest.raises(ConfigurationError):
        options.check()


def test_related_searches_and_pattern_lists():
    assert related_options("phone", "79001234567", SearchOptions(("x",))).patterns == ("+79001234567",)
    assert related_options("email", "a@b.co", SearchOptions(("x",), smart=True)).mode == "literal"
    assert split_patterns(" a, b ,,c") == ("a", "b", "c")
