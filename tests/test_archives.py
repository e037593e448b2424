import io
import json
import os
import random

import pytest

from recordscan import cli, render
from recordscan.engine import search
from recordscan.options import ConfigurationError, SafetyLimits, SearchOptions
from recordscan.plans import index as ix
from recordscan.plans.planner import plan_search
from recordscan.sources import decoders
from recordscan.sources.archives import ReadOptions, discover, inspect, issues_of, members, pack, read_tagged, records_of, stats_of, validated

from .helpers import make_zip, sqlite_bytes, xlsx_bytes, zip_bytes


def read(spark, path, **options):
    recursive = options.pop("recursive", True)
    tagged = read_tagged(spark, str(path), ReadOptions(**options), recursive)
    rows = [(os.path.basename(r["archive"]), r["member"], tuple(r["nested_path"]), tuple(r["route"]), r["line"], r["text"]) for r in records_of(tagged).collect()]
    return sorted(rows, key=lambda r: (r[0], r[3], r[4])), [(r["member"], r["message"], r["issue"]) for r in issues_of(tagged).collect()]


def shown(result):
    return [(os.path.basename(m["archive"]), m["member"], m["line"], m["text"]) for m in result.matches.collect()]


def test_discovery(tmp_path):
    (tmp_path / "child").mkdir()
    (tmp_path / "_hidden").mkdir()
    for p in ("b.ZIP", "a.zip", "child/c.zip", "_hidden/.d.zip", "x.txt"):
        make_zip(tmp_path / p, {"t.txt": "x"})
    os.symlink(tmp_path / "child", tmp_path / "link")
    names = lambda found: [os.path.relpath(p, tmp_path) for p in found]
    assert names(discover(str(tmp_path))) == ["a.zip", "b.ZIP", "_hidden/.d.zip", "child/c.zip"]
    assert names(discover(str(tmp_path), recursive=False)) == ["a.zip", "b.ZIP"]
    for wrong in (tmp_path / "none", tmp_path / "x.txt"):
        with pytest.raises(ConfigurationError):
            discover(str(wrong))


def test_text_members_encodings_and_line_ends(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"имя.txt": "first\r\nsecond\rthird\n", "cp.txt": "Привет".encode("cp1251"), "bom.csv": b"\xef\xbb\xbfx,y\n1,2\n", "bin.txt": b"a\0b", "empty.txt": "", "skip.exe": "x"})
    rows, issues = read(spark, tmp_path)
    assert [(r[1], r[4], r[5]) for r in rows] == [("имя.txt", 1, "first"), ("имя.txt", 2, "second"), ("имя.txt", 3, "third"), ("cp.txt", 1, "Привет"), ("bom.csv", 1, "x,y"), ("bom.csv", 2, "1,2")]
    assert issues == []


def test_utf8_is_told_though_the_probe_cuts_a_character():
    data = ("a" * (decoders.PROBE - 1) + "é\nlast").encode()
    assert [t[-1] for _, t in decoders.text_records(io.BytesIO(data), "auto", 1 << 30)] == ["é", "t"]


def test_long_records_go_on(monkeypatch):
    monkeypatch.setattr(decoders, "FRAGMENT", 4)
    assert list(decoders.text_records(io.BytesIO(b"abcdef\ngh"), "auto", 99)) == [(1, "abcd"), (2, "ef"), (3, "gh")]


def test_structured_members(spark, tmp_path):
    ns = 'xmlns:w="urn:w"'
    db = sqlite_bytes(tmp_path, {"first": ("v TEXT", [("one",)]), "second": ("v TEXT, w INT", [(None, 2)])})
    sheet = xlsx_bytes('<row><c t="inlineStr"><is><t>Bob</t></is></c><c><v>7</v></c></row><row/><row><c t="s"><v>0</v></c><c t="s"><v>9</v></c></row>', "<si><t>shared</t></si>")
    make_zip(
        tmp_path / "a.zip",
        {
            "d.sqlite": db, "s.xlsx": sheet, "w.docx": zip_bytes({"word/document.xml": f"<w:d {ns}><w:p><w:t>Para </w:t><w:t>one</w:t></w:p><w:p/></w:d>", "word/styles.xml": f"<w:p {ns}>no</w:p>"}),
            "p.pptx": zip_bytes({"ppt/slides/slide1.xml": f"<w:s {ns}><w:t>Slide</w:t></w:s>"}), "o.odt": zip_bytes({"content.xml": f"<w:o {ns}><w:h>Head</w:h><w:p>Body</w:p></w:o>"}), "bad.docx": b"no zip", "bad.sqlite": b"no database",
            "xml.docx": zip_bytes({"word/document.xml": "<open>"}),
        },
    )
    rows, issues = read(spark, tmp_path)
    assert [(r[1], r[4], r[5]) for r in rows] == [
        ("d.sqlite", 1, "[first] one"), ("d.sqlite", 2, "[second]  2"), ("s.xlsx", 1, "Bob 7"), ("s.xlsx", 3, "shared 9"), ("w.docx", 1, "Para one"), ("p.pptx", 1, "Slide"), ("o.odt", 1, "Head"), ("o.odt", 2, "Body"),
    ]
    assert sorted((m, k) for m, _, k in issues) == [("bad.docx", "member"), ("bad.sqlite", "member"), ("xml.docx", "member")]


def test_nesting_depth_and_routes(spark, tmp_path):
    deep = zip_bytes({"deep.txt": "deepest"})
    make_zip(tmp_path / "a.zip", [("same.txt", "one"), ("same.txt", "two"), ("in.zip", zip_bytes([("x.jsonl", '{"value":"v"}'), ("more.zip", deep)]))])
    rows, issues = read(spark, tmp_path)
    assert [(r[1], r[2], r[3], r[5]) for r in rows] == [("same.txt", (), (0,), "one"), ("same.txt", (), (1,), "two"), ("x.jsonl", ("in.zip",), (2, 0), '{"value":"v"}'), ("deep.txt", ("in.zip", "more.zip"), (2, 1, 0), "deepest")]
    rows, issues = read(spark, tmp_path, limits=SafetyLimits(max_nested_depth=1))
    assert len(rows) == 3 and issues == [("more.zip", "left out: archives are nested too deep", "safety")]
    assert [r[1] for r in read(spark, tmp_path, include=("*.jsonl",))[0]] == ["x.jsonl"]
    assert [r[1] for r in read(spark, tmp_path, exclude=("in.zip",))[0]] == ["same.txt", "same.txt"]


def test_unsafe_members_and_bad_archives(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"../up.txt": "x", "big.txt": "y" * 2000, "ok.txt": "fine"})
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows, issues = read(spark, tmp_path, limits=SafetyLimits(max_member_bytes=100))
    assert [r[5] for r in rows] == ["fine"]
    assert sorted((m or "", k) for m, _, k in issues) == [("", "archive"), ("../up.txt", "safety"), ("big.txt", "safety")]
    assert read(spark, tmp_path, limits=SafetyLimits(max_members=2))[0] == []
    assert read(spark, tmp_path, limits=SafetyLimits(max_total_bytes=10))[0] == []
    make_zip(tmp_path / "c.zip", {"n.txt": "needle\n" * 1000})
    assert any("a byte of it makes" in m for _, m, _ in read(spark, tmp_path, limits=SafetyLimits(max_compression_ratio=20.0))[1])


def test_counts_and_central_directories(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"a.txt": "abc", "d/": "", "b.bin": "zz", "../x.txt": "q"})
    s = stats_of(read_tagged(spark, str(tmp_path))).first()
    assert (s["members_seen"], s["members_scanned"], s["bytes_declared"], s["completed"]) == (3, 1, 6, True)
    m = {r["member"]: r for r in validated(members(spark, str(tmp_path))).collect()}
    assert m["a.txt"]["reject_reason"] is None and m["d/"]["reject_reason"] == "directory" and m["../x.txt"]["reject_reason"] == "unsafe path"
    counts, issues = inspect(str(tmp_path / "a.zip"))
    assert counts["members_seen"] == 3 and [i.member for i in issues] == ["../x.txt"]


def test_large_archives_are_dealt_by_members(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {f"m{i}.txt": os.urandom(600).hex() for i in range(40)})
    parts = pack([str(tmp_path / "a.zip")], target=4000)
    assert len(parts) > 3 and {p.shares[0][2] for p in parts} == {len(parts)}
    spark.dataSource.register(__import__("recordscan.sources.archives", fromlist=["x"]).ArchiveSource)
    tagged = spark.read.format("recordscan_archives").option("path", str(tmp_path)).option("partitionBytes", 4000).load()
    assert records_of(tagged).count() == 40 and stats_of(tagged).first()["members_seen"] == 40


def test_archives_by_a_path_that_spark_reads(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"a.txt": "one\ntwo"})
    tagged = read_tagged(spark, f"file://{tmp_path}")
    assert sorted(r["text"] for r in records_of(tagged).collect()) == ["one", "two"]


@pytest.fixture
def corpus(tmp_path):
    for i in range(6):
        make_zip(tmp_path / f"{i}.zip", {"common.txt": f"shared line {i}\nanother", "other.txt": "nothing", "rare.txt": f"unique{i} token\nphone +7 900 123-45-6{i}"})
    return tmp_path


def test_index_answers_as_the_scan_does(spark, corpus):
    status, issues = ix.build_or_update(spark, str(corpus))
    assert (status.state, status.archives, status.members, issues) == ("READY", 6, 18, [])
    for o, execution in [
        (SearchOptions(("unique3",)), "index"), (SearchOptions(("nique3 tok",)), "index"), (SearchOptions(("unique1", "unique2 token")), "index"), (SearchOptions(("shared line",)), "index"), (SearchOptions(("n",)), "scan"),
        (SearchOptions(("unique4 missing",), smart=True), "index"), (SearchOptions(("ique5",), smart=True), "index"), (SearchOptions(("8 900 123 45 62",), smart=True), "index"), (SearchOptions(("absent",)), "index"), (SearchOptions(("!",)), "scan"),
        (SearchOptions((r"unique\d",), regex=True), "scan"), (SearchOptions(("unique3",), case_sensitive=True), "scan"), (SearchOptions(advanced="unique3"), "scan"),
    ]:
        indexed, scanned = search(spark, str(corpus), o), search(spark, str(corpus), o, force_scan=True)
        assert shown(indexed) == shown(scanned), o
        assert indexed.plan.execution == execution, (o, indexed.plan.explain())
        indexed.close(), scanned.close()


def test_lookups_of_many_terms_are_joined(spark, corpus, monkeypatch):
    monkeypatch.setattr(ix, "LOOKUP_TERMS", 2)
    ix.build_or_update(spark, str(corpus))
    assert ix.candidates(spark, ix.default_path(str(corpus)), SearchOptions(("unique",))).count() == 6


def test_index_life(spark, corpus):
    root = str(corpus)
    assert ix.status(spark, root).state == "NONE"
    ix.build_or_update(spark, root)
    make_zip(corpus / "0.zip", {"new.txt": "changed words"})
    make_zip(corpus / "6.zip", {"new.txt": "fresh words"})
    os.remove(corpus / "5.zip")
    s = ix.status(spark, root)
    assert (s.state, s.usable, s.new, s.changed, s.removed) == ("STALE", False, 1, 1, 1)
    o = SearchOptions(("words",))
    r = search(spark, root, o)
    assert r.plan.execution == "hybrid" and {m["execution_path"] for m in r.matches.collect()} == {"scan"}
    assert len(shown(search(spark, root, SearchOptions(("unique2",))))) == 1
    steps = []
    s, _ = ix.build_or_update(spark, root, progress=lambda done, total: steps.append((done, total)))
    assert s.state == "READY" and s.archives == 6 and steps == [(2, 2)]
    assert search(spark, root, o).plan.execution == "index"
    assert search(spark, root, SearchOptions(("unique5",))).matches.count() == 0
    before = ix.verify(spark, root)
    ix.compact(spark, ix.default_path(root))
    after = ix.verify(spark, root)
    assert before.state == after.state == "READY" and before.postings == after.postings
    assert len(os.listdir(os.path.join(ix.default_path(root), "postings"))) <= 2
    ix.clean(ix.default_path(root))
    assert ix.status(spark, root).state == "NONE"


def test_index_resumes_and_tells_damage(spark, corpus):
    root, at = str(corpus), ix.default_path(str(corpus))
    calls = iter([False, True])
    s, _ = ix.build_or_update(spark, root, cancelled=lambda: next(calls), batch=2)
    assert (s.state, s.archives, s.new) == ("BUILDING", 2, 4)
    r = search(spark, root, SearchOptions(("unique0", "unique5")))
    assert r.plan.execution == "hybrid" and len(shown(r)) == 2
    assert ix.build_or_update(spark, root)[0].state == "READY"
    for d, _, files in os.walk(os.path.join(at, "postings")):
        for f in files:
            if f.endswith(".parquet"):
                os.remove(os.path.join(d, f))
                break
    assert ix.verify(spark, root).state == "CORRUPT"
    with open(os.path.join(at, "manifest.json"), "w") as f:
        f.write("{")
    assert ix.status(spark, root).state == "CORRUPT"
    assert plan_search(spark, root, SearchOptions(("unique0",))).execution == "scan"
    assert ix.build_or_update(spark, root)[0].state == "READY"


def test_index_made_for_other_limits_is_not_used(spark, corpus):
    ix.build_or_update(spark, str(corpus), limits=SafetyLimits(max_nested_depth=1))
    assert plan_search(spark, str(corpus), SearchOptions(("unique0",))).execution == "scan"


@pytest.mark.parametrize("seed", range(3))
def test_index_and_scan_agree_on_random_archives(spark, tmp_path, seed):
    r = random.Random(seed)
    words = ["alpha", "alphabet", "beta", "gamma-ray", "Delta", "épée"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
    for i in range(3):
        make_zip(tmp_path / f"{i}.zip", [("records.txt", "\n".join(line() for _ in range(12))), ("records.txt", line()), ("e.jsonl", json.dumps({"value": line(), "seed": seed})), ("n.zip", zip_bytes({"in.txt": line() + "\n+7 900 000 11 22"}))])
    ix.build_or_update(spark, str(tmp_path))
    for o in (SearchOptions(("alpha beta",), smart=True, max_matches=7), SearchOptions(("lpha",)), SearchOptions(("gamma-ray",)), SearchOptions(("79000001122",), smart=True)):
        a, b = search(spark, str(tmp_path), o), search(spark, str(tmp_path), o, force_scan=True)
        strip = lambda x: [{k: v for k, v in m.asDict(True).items() if k != "execution_path"} for m in x.matches.collect()]
        assert strip(a) == strip(b)


def run(*argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, corpus):
    root = str(corpus)
    code, out, err = run("search", root, "unique3", "-C", "1", "--explain")
    assert code == 0 and out.endswith("3.zip:rare.txt:1: unique3 token\n  + phone +7 900 123-45-63\n") and "matches=1" in err and "execution=scan" in err
    code, out, _ = run("search", root, "unique3", "--jsonl")
    match, summary = map(json.loads, out.splitlines())
    assert match["type"] == "match" and match["text_spans"] == [[0, 7]] and match["provenance"] == [["record", "1"]] and summary["matches"] == 1
    code, out, _ = run("related", root, "unique3 shared", "--max-matches", "2", "--group-by", "exact", "--jsonl")
    assert [json.loads(x)["type"] for x in out.splitlines()] == ["group", "group", "summary"]
    assert run("search", root, "(", "-r")[0] == 2 and run("search", root, "a", "b", "--advanced")[0] == 2 and run("search", root + "/none", "x")[0] == 2
    assert run("inspect", str(corpus / "1.zip"))[0] == 0
    assert run("index", "status", root)[0] == 1
    assert run("index", "build", root)[0] == 0 and run("index", "verify", root)[0] == 0
    assert json.loads(run("index", "status", root, "--json")[1])["state"] == "READY"
    assert run("index", "compact", root)[0] == 0 and run("index", "clean", root)[0] == 0
    told = json.loads(run("inspect", str(corpus / "1.zip"), "--json")[1])
    assert set(told) == {"archive", "members", "declared_uncompressed_bytes", "issues"} and told["members"] > 0
    generations = []
    for action in ("build", "update", "build", "build"):
        assert run("index", action, root)[0] == 0
        generations.append(json.loads(run("index", "status", root, "--json")[1])["generations"])
    assert generations[0] == generations[1] == generations[2] == generations[3]  # made anew, not added to
    with pytest.raises(SystemExit) as stop:
        run("--version")
    assert stop.value.code == 0
    for wrong in (("search", root, "a", "--max-matches", "0"), ("search", root), ("index", root), ("search", root, "a", "--group-by", "x")):
        with pytest.raises(SystemExit) as stop:
            run(*wrong)
        assert stop.value.code == 2
    (corpus / "bad.zip").write_bytes(b"x")
    assert run("search", root, "unique3", "-q")[0] == 1
    code, out, _ = run("inspect", str(corpus / "bad.zip"), "--json")
    assert code == 1 and json.loads(out)["issues"][0]["kind"] == "archive"


def test_cells_of_sheets():
    from recordscan.sources.decoders import sheet_records

    rows = (
        '<row><c><v>1</v><v>2</v></c><c><v/><is><t>in</t></is></c><c><is><r><t>a</t></r><r><t>b<x>no</x>tail</t></r></is></c><c t="s"><v>0</v></c><c t="s"><v>9</v></c><c t="s"><v>x</v></c></row><row><c/></row>'
        '<row><c><f><v>inner</v></f></c><c><v>&amp; é</v></c></row><row xmlns=""><c><v>no namespace</v></c></row>'
    )
    found = list(sheet_records(io.BytesIO(xlsx_bytes(rows, "<si><t>one</t><r><t> two</t></r></si>")), "auto", 1 << 20))
    assert found == [(1, "1 in ab one two 9 x"), (3, "& é")]


def test_blocks_inside_blocks_are_records_of_their_own():
    from recordscan.sources.decoders import office_records

    said = '<w:d xmlns:w="urn:w"><w:p>outer <w:p> inner </w:p>end</w:p><w:p>  </w:p><w:t>no</w:t><p>no</p></w:d>'
    assert list(office_records(".docx")(io.BytesIO(zip_bytes({"word/document.xml": said, "word/header1.xml": '<w:p xmlns:w="u">head</w:p>', "word/other.xml": '<w:p xmlns:w="u">no</w:p>'})), "auto", 1 << 20)) == [(1, "inner"), (2, "outer end"), (3, "head")]


def test_exports(spark, corpus, tmp_path):
    r = search(spark, str(corpus), SearchOptions(("unique3",)))
    base = render.export(r.matches, str(tmp_path))
    assert json.loads(open(base + ".jsonl").read())["member"] == "rare.txt"
    assert open(base + ".csv").read().splitlines()[0] == "archive,nested_path,member,line,text,patterns"
    for form in ("jsonl", "csv", "txt"):
        render.write(r.matches, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 1
    r.close()


def test_streams_of_archives(spark, corpus, tmp_path):
    from recordscan.streaming.ingest import index_stream, match_stream

    found = match_stream(spark, str(corpus), SearchOptions(("unique2",)))
    q = found.writeStream.format("memory").queryName("stream_matches").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["text"] for r in spark.table("stream_matches").collect()] == ["unique2 token"]
    at = ix.default_path(str(corpus))
    index_stream(spark, str(corpus), at, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert ix.status(spark, str(corpus)).state == "READY"


def test_index_is_built_without_a_shuffle_of_postings_and_keeps_counts_and_issues(spark, tmp_path, monkeypatch):
    make_zip(tmp_path / "a.zip", {"t.txt": "one two one\n\n...\n+7 900 123-45-67", "bad.docx": b"no zip"})
    make_zip(tmp_path / "b.zip", {"t.txt": "one"})
    (tmp_path / "c.zip").write_bytes(b"no archive")
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.repartitionByRange", None)  # samples postings to the driver
    status, issues = ix.build_or_update(spark, str(tmp_path))
    assert (status.state, status.archives, status.members, status.records, status.postings, status.terms) == ("READY", 3, 2, 5, 9, 8)
    assert sorted((os.path.basename(i.message.split(": ")[0]), i.member, i.kind) for i in issues) == [("a.zip", "bad.docx", "member"), ("c.zip", None, "archive")]
    assert sorted((r["kind"], r["term"]) for r in ix.postings(spark, ix.default_path(str(tmp_path))).collect() if r["relative"] == "a.zip") == [("digits", "79001234567"), *(("term", t) for t in ("123", "45", "67", "7", "900", "one", "two"))]


def test_postings_are_made_in_the_tasks_that_read(spark, tmp_path, monkeypatch):
    from recordscan.functions.text import digits_of, token_list
    from recordscan.plans import postings
    from recordscan.sources.archives import read_archive

    lines = ["one Two_two one", "", "...", "8 (900) 123-45-67", "тел. ٠١٢٣٤٥٦٧", "Straße №5 Ёлка 𝟗𝟗", "x" * 40]
    for i in range(3):
        make_zip(tmp_path / f"{i}.zip", {"a.txt": "\n".join(lines[i:]), "e.txt": "", "n.zip": zip_bytes({"b.txt": "\n".join(lines), "c.zip": zip_bytes({"d.txt": f"deep {i}"})})})
    own = set()
    for p in discover(str(tmp_path)):
        for row in read_archive(p, ReadOptions()):
            if row[0] == "record":
                at = (os.path.basename(p), row[3], row[4])
                own |= {("term", t, *at) for t in token_list(row[5])} | {("digits", d, *at) for d in [digits_of(row[5])] if len(d) >= 7}
    monkeypatch.setattr(postings, "HELD", 7)  # a task here; its files are several
    marks = postings.write_part(0, [(os.path.basename(p), p, k, 2) for p in discover(str(tmp_path)) for k in range(2)], str(tmp_path), str(tmp_path), ReadOptions(), postings.decimals(spark))
    assert len([f for f in os.listdir(tmp_path) if f.startswith("part-")]) > 3 and sum(m[3] for m in marks) == len(own)
    monkeypatch.undo()
    monkeypatch.setattr(ix, "TASK_BYTES", 1 << 10)
    status, issues = ix.build_or_update(spark, str(tmp_path))
    at = ix.default_path(str(tmp_path))
    held = [(r["kind"], r["term"], r["relative"], tuple(r["route"]), r["line"]) for r in ix.postings(spark, at).collect()]
    assert sorted(held) == sorted(own) and (status.postings, status.members, issues) == (len(own), 9, [])
    assert status.terms == len({x[:2] for x in own})
    assert ix.verify(spark, str(tmp_path)).state == "READY"  # Spark's checksums are those of the tasks
    of = {r: [sum(m[i] for m in marks if m[0] == r) for i in (1, 2, 3)] for r in {m[0] for m in marks}}
    for r in ix.archives_table(spark, at, ix.read_manifest(at)).collect():
        x = 0
        for m in marks:
            x ^= m[4] if m[0] == r["relative"] else 0
        assert [r["members"], r["records"], r["postings"]] == of[r["relative"]] and x == r["checksum"]


def test_only_members_that_rows_name_are_read(spark, corpus):
    from recordscan.sources.archives import read_found

    found = spark.createDataFrame([(str(corpus / "1.zip"), [2]), (str(corpus / "1.zip"), [2]), (str(corpus / "4.zip"), [0])], "archive string, route array<int>")
    tagged = read_found(spark, found, ReadOptions())
    assert sorted((os.path.basename(r["archive"]), r["member"], r["line"]) for r in records_of(tagged).collect()) == [("1.zip", "rare.txt", 1), ("1.zip", "rare.txt", 2), ("4.zip", "common.txt", 1), ("4.zip", "common.txt", 2)]


def test_routes_travel_with_their_partition(tmp_path):
    from recordscan.sources.archives import ArchiveReader, _listing

    paths = [str(make_zip(tmp_path / f"{i}.zip", {"a.txt": os.urandom(600).hex(), "b.txt": "b"})) for i in range(4)]
    reader = ArchiveReader({"path": str(tmp_path), "listing": _listing(paths, {p: [(1,)] for p in paths[:3]}), "partitionbytes": "700"})
    parts = reader.partitions()
    assert [sorted(p.routes) for p in parts] == [[p] for p in paths[:3]]
    assert not any(p in repr(vars(reader)) for p in paths)
