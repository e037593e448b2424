"""The registered queries on the smallest tables, against SQL or a model of their contract, and the pipeline by stages."""

import hashlib
import html
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from recordscan.llm import decontaminate, linededup, secrets, simhash
from recordscan.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows_of(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    r = c.execute(ORACLES[name])
    columns = [x[0] for x in r.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(x[k] for k in columns) for x in got.collect()))) == sorted(map(repr, r.fetchall()))


def test_op2_predicts_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in rows_of(spark, "documents")}
    got = entry.queries()["op2_language_id"](spark, SF).collect()
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(held) / len(held) > 0.95


def test_op5_by_brute_force(spark):
    docs = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in rows_of(spark, "documents")}
    root = {d: d for d in docs}
    for _ in range(3):
        for a in docs:
            for b in docs:
                if bin(docs[a] ^ docs[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = entry.queries()["op5_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", root[d]) for d, f in docs.items()}


def test_op9_by_brute_force(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for r in rows_of(spark, "benchmark"):
        w = words(r["text"])
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    expected = {}
    for r in rows_of(spark, "documents"):
        w = words(r["text"])
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    items |= found
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        expected[r["doc_id"]] = (len(w), len(hit), len(items), sha, len(items) >= 2)
    got = entry.queries()["op9_decontamination"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected


def test_op10_by_the_known_layout(spark):
    def text(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n\n".join(filter(None, blocks))

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in entry.queries()["op10_html_text"](spark, SF).collect()}
    assert got == {r["page_id"]: (t := text(r["html"]), len(t)) for r in rows_of(spark, "pages")}


@pytest.mark.parametrize("name", ["op4_packing", "op6_embedding_dedup", "op7_secret_scan"])
def test_other_queries_give_whole_results(spark, name):
    got = entry.queries()[name](spark, SF)
    if name == "op6_embedding_dedup":
        assert got.count() == len(rows_of(spark, "embeddings"))
    elif name == "op4_packing":
        assert got.select("doc_id").distinct().count() == len(rows_of(spark, "documents"))
    else:
        tokens, expected, forest = 0, [], secrets.train()
        for r in rows_of(spark, "documents"):
            text = r["text"] or ""
            tokens += len(re.findall('token = "[0-9a-f]{40}"', text))
            for a, b, why in secrets.candidates(text):
                x = secrets.features(text[a:b], text[max(0, a - secrets.NEAR) : a], text[b : b + secrets.NEAR], r["source"] or "", why)
                score = forest.scores(np.array([x]))[0]
                expected.append((r["doc_id"], a, b, why, hashlib.sha256(text[a:b].encode()).hexdigest(), score, score >= 0.5))
        assert sorted(map(tuple, got.collect())) == sorted(expected) and got.filter("secret").count() >= tokens


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.columns
    # no letters, no text, and texts that are as much of one language as of another
    torn = spark.createDataFrame([(10**6 + 9 + i, f"{a} {b}", lang, "s", 9) for i in range(60) for a, b, lang in [("thndoner", "zuchenschkeit", "en" if i % 2 else "de")]], docs.schema)
    junk = spark.createDataFrame([(10**6, "1234 !!", "en", "s", 7), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    first = corpus_pipeline.STAGES[0][1](spark, docs.unionByName(junk).unionByName(torn), SF)
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == own and len({r["doc_id"] for r in docs.collect()} - kept) <= 2 and not kept & set(range(10**6, 10**6 + 100))
    second = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    model = {r["doc_id"]: r["kept"] for r in linededup.dedup_lines(docs).filter("n_dropped = 0 OR trim(kept) <> ''").collect()}
    assert second.columns == own and {r["doc_id"]: r["text"] for r in second.collect()} == model
    third = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    kept = {r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert third.columns == own and {r["doc_id"] for r in third.collect()} == kept
    fourth = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert fourth.columns == own and decontaminate.find_contamination(fourth, bench).filter("n_hit > 0").count() == 0
    clean = {r["doc_id"] for r in decontaminate.find_contamination(docs, bench).filter("n_hit = 0").collect()}
    assert clean <= {r["doc_id"] for r in fourth.collect()}


def test_pipeline_runs_whole(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql()) <= names


def test_settled_tables_need_a_shared_folder_on_a_cluster(monkeypatch):
    from recordscan.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        common.work_root(Session)
