import os
import subprocess
import sys

from recordscan.functions.registry import register
from recordscan.functions.width import cells, cells_of, clipped
from recordscan.history import KEPT, LocalState
from recordscan.operators.smart import score_text
from recordscan.package import build

from .helpers import make_zip, model_score


def test_sql_functions_and_data_source(spark, tmp_path):
    register(spark)
    make_zip(tmp_path / "a.zip", {"a.txt": "Anna Lee\na@b.co"})
    spark.read.format("recordscan_archives").option("path", str(tmp_path)).load().createOrReplaceTempView("archived")
    rows = spark.sql("SELECT normalize_text(text) AS n, phone_digits('8 900 123 45 67') AS d, extract_entities(text).kind AS k, smart_score(text, 'lee ann') AS s FROM archived WHERE kind = 'record' ORDER BY line").collect()
    assert [tuple(r) for r in rows] == [("anna lee", "79001234567", [], 311), ("a b co", "79001234567", ["email", "domain"], 0)]


def test_score_of_one_text():
    for t in ("Anna Lee", "leeds", "+7 900 123-45-67", "x", "lee anna"):
        for p in ("anna lee", "lee", "89001234567", "le xx"):
            assert score_text(t, p) == (model_score(t, [p]) or (0,))[0]


def test_local_state(tmp_path):
    s = LocalState.load(str(tmp_path / "none.json"))
    for i in range(300):
        s.add("history", f"q{i}")
    s.add("history", "q250")
    s.add("saved", {"q": 1})
    s.save()
    again = LocalState.load(s.path)
    assert again.history[:2] == ["q250", "q299"] and len(again.history) == KEPT["history"] and again.saved == [{"q": 1}]
    again.remove("saved", {"q": 1})
    assert again.saved == []
    (tmp_path / "bad.json").write_text("[")
    assert LocalState.load(str(tmp_path / "bad.json")).history == []


def test_cells_of_a_terminal(spark):
    texts = ["", "abc", "漢字", "é", "ｶﾞ", "한글 x", "😀", "〪", "日本゙", None]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cells("t").alias("c")).collect()]
    assert got == [0, 3, 4, 1, 2, 6, 2, 0, 4, None] and [cells_of(t) for t in texts[:-1]] == got[:-1]
    assert clipped("漢字x", 3) == "漢" and clipped("漢字x", 5) == "漢字x" and clipped("a", -1) == "" and clipped("éx", 1) == "é"


def test_the_library_as_one_archive(tmp_path):
    target = build(str(tmp_path / "tool.pyz"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, target, "--version"], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert ran.returncode == 0 and ran.stdout.startswith("recordscan ")


def test_cells_of_all_characters_by_classes_of_few_runs_first(spark):
    texts = ["".join(chr(i) for i in range(at, min(at + 4096, 0x110000)) if not 0xD800 <= i < 0xE000) for at in range(0, 0x110000, 4096)]
    made = spark.createDataFrame([(t,) for t in texts if t], "t string").select("t", cells("t").alias("c"))
    assert all(r["c"] == cells_of(r["t"]) for r in made.collect())
    # the class that every character of every text meets: hundreds of runs before
    plan = made._jdf.queryExecution().analyzed().toString()
    first = plan[plan.index("regexp_replace(t#") :]
    assert first[: first.index("]+")].count("-") < 50
