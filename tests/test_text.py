import random

import pytest
from pyspark.sql import functions as F

from recordscan.functions import entities as ent
from recordscan.functions import paths
from recordscan.functions.text import digits_of, java_regex, normalize_text, normalized, phone_components, phone_digits, token_list, tokens


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normal_form_of_known_texts():
    assert normalize_text("Straße Ёлка, X_y2!") == "strasse елка x y2"
    assert normalize_text("  A\tB\n ") == "a b"
    assert normalize_text("ﬁn", True) == "fin"
    assert token_list("!?") == []


def test_fast_and_exact_columns_agree_with_the_model(spark):
    r = random.Random(3)
    alphabet = "abcXYZäöüßéñёЁжЖ0123 _-.,!?@\t\n"
    values = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(300)]
    got = column(spark, values, normalized(F.col("v")).alias("fast"), normalized(F.col("v"), exact=True).alias("exact"), tokens(normalized(F.col("v"))).alias("t"))
    for v, (fast, exact, t) in zip(values, got):
        assert exact == normalize_text(v)
        assert fast == exact
        assert t == token_list(v)


def test_exact_form_folds_what_the_jvm_does_not(spark):
    assert column(spark, ["ﬁnal ①", None], normalized(F.col("v"), exact=True).alias("n")) == [("final 1",), (None,)]


def test_phone_digits_and_components(spark):
    values = ["+7 (900) 123-45-67", "8 900 123 45 67", "id 123456", "a 12.34.56 and 7654321", ""]
    got = column(spark, values, phone_digits(F.col("v")).alias("d"), phone_components(F.col("v")).alias("c"))
    assert got == [("79001234567", ["79001234567"]), ("79001234567", ["79001234567"]), ("123456", []), ("1234567654321", ["7654321"]), ("", [])]
    assert digits_of("8 900 123 45 67") == "79001234567"


def test_java_regex_translates_named_groups_and_ends():
    assert java_regex(r"(?P<a>x)(?P=a)\Z") == r"(?<a>x)\k<a>\z"
    assert java_regex(r"\\Z") == r"\\Z"


def test_entities_in_order_once():
    text = "Mail Ann.Lee@Example.COM, see https://Docs.example.org/a?b=1). IP 192.168.0.1 and 2001:DB8:0:0:0:0:0:1 id 550E8400-E29B-41D4-A716-446655440000 md5 D41D8CD98F00B204E9800998ECF8427E ann.lee@example.com"
    assert ent.entities_of(text) == [
        ("email", "ann.lee@example.com"), ("domain", "example.com"), ("url", "https://Docs.example.org/a?b=1"), ("domain", "docs.example.org"), ("ipv4", "192.168.0.1"), ("ipv6", "2001:db8::1"),
        ("uuid", "550e8400-e29b-41d4-a716-446655440000"), ("md5", "d41d8cd98f00b204e9800998ecf8427e"),
    ]
    assert ent.entities_of("999.1.1.1 1.2.3 01.2.3.4") == []


def test_entity_columns_agree_with_the_whole_extraction(spark):
    texts = ["a@b.co x@y.org a@b.co", "http://h.example/x, https://u@k.example:80/z", "10.0.0.1 10.0.0.256 1.10.0.0.1", "550e8400-e29b-41d4-a716-446655440000", "f" * 40 + " " + "0" * 64 + " " + "e" * 33, None, ""]
    got = column(spark, texts, ent.emails(F.col("v")).alias("a"), ent.ipv4s(F.col("v")).alias("b"), ent.uuids(F.col("v")).alias("c"), ent.digests(F.col("v")).alias("d"), ent.url_hosts(F.col("v")).alias("e"), ent.entities(F.col("v")).alias("f"))
    for text, (mails, ips, uuids, digests, hosts, all_) in zip(texts, got):
        if text is None:
            assert all_ is None
            continue
        found = ent.entities_of(text)
        assert [(e["kind"], e["value"]) for e in all_] == found
        of = lambda *kinds: [v for k, v in found if k in kinds]
        assert mails == of("email") and ips == of("ipv4") and uuids == of("uuid") and digests == of("md5", "sha1", "sha256")
        if not mails:
            assert hosts == of("domain")


@pytest.mark.parametrize(
    "name, wanted",
    [("a.txt", True), ("d/B.CSV", True), ("x.exe", False), ("noext", False), ("in.zip", True), (".txt", False), ("a\\b.md", True)],
)
def test_readable_members(spark, name, wanted):
    assert paths.is_wanted(name) is wanted
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(paths.wanted(F.col("n"))).first()[0] is wanted


def test_globs_cross_folders_and_mind_case(spark):
    names = ["keep/a.csv", "keep/deep/a.csv", "skip/b.txt", "Keep/a.csv"]
    assert [paths.is_wanted(n, include=("keep/*",), exclude=("*deep*",)) for n in names] == [True, False, False, False]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(paths.wanted(F.col("n"), include=("keep/*",), exclude=("*deep*",))).collect()] == [True, False, False, False]


def test_unsafe_paths(spark):
    names = ["../x", "a/../b", "/abs", "a..b/c", "..\\w", "ok/x"]
    model = [paths.is_unsafe(n) for n in names]
    assert model == [True, True, True, False, True, False]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(paths.unsafe(F.col("n"))).collect()] == model
