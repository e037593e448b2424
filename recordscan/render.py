"""Results as text, JSON lines and files."""

from __future__ import annotations

import csv
import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Name before the tool's own lines.
NAME = "recordscan"


def match_dict(m: Row) -> dict:
    """A match as its JSON object has it."""
    d = m.asDict(recursive=True)
    for drop in ("ordinal", "route"):
        d.pop(drop, None)
    for spans in ("text_spans", "query_spans"):
        d[spans] = [[s["start"], s["end"]] for s in d[spans]]
    d["provenance"] = [[p["key"], p["value"]] for p in d["provenance"]]
    return d


def match_lines(m: Row) -> list[str]:
    where = "!".join([*m["nested_path"], m["member"]])
    return [f"{m['archive']}:{where}:{m['line']}: {m['text']}", *(f"  - {x}" for x in m["context_before"]), *(f"  + {x}" for x in m["context_after"])]


def match_json(m: Row) -> str:
    return json.dumps({"type": "match", **match_dict(m)}, ensure_ascii=False, sort_keys=True)


def group_json(g: Row) -> str:
    return json.dumps({"type": "group", "mode": g["mode"], "key": g["key"], "occurrences": [match_dict(m) for m in g["occurrences"]]}, ensure_ascii=False, sort_keys=True)


def group_lines(g: Row) -> list[str]:
    return [f"{NAME} group: mode={g['mode']} key={g['key']} occurrences={g['n']}", *(line for m in g["occurrences"] for line in match_lines(m))]


def issue_line(i: Row) -> str:
    return f"{NAME}: {i['archive']}: {i['member'] + ': ' if i['member'] else ''}{i['message']}"


def summary_line(s: dict) -> str:
    return f"{NAME}: archives={s['archives_completed']}/{s['archives_seen']} members={s['members_scanned']}/{s['members_seen']} matches={s['matches']} issues={s['issues']} path={s['execution_path']}"


def summary_json(s: dict) -> str:
    return json.dumps({"type": "summary", **s}, sort_keys=True)


def human_column() -> Column:
    """The first line of a match as a Column, for results that are written by Spark."""
    where = F.array_join(F.concat("nested_path", F.array("member")), "!")
    return F.concat_ws(":", "archive", where, F.col("line").cast("string"), F.concat(F.lit(" "), "text"))


def json_column(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write(matches: DataFrame, path: str, form: str) -> None:
    """A result of any size as a folder of jsonl, csv or txt files, written by the executors."""
    if form == "jsonl":
        matches.drop("ordinal").write.mode("overwrite").json(path, ignoreNullFields=False)
    elif form == "csv":
        matches.select("archive", F.array_join("nested_path", "!").alias("nested_path"), "member", "line", "text", F.array_join("patterns", ";").alias("patterns")).write.mode("overwrite").csv(path, header=True)
    elif form == "txt":
        matches.select(human_column()).write.mode("overwrite").text(path)
    else:
        raise ValueError("exports are jsonl, csv or txt")


def export(matches: DataFrame, folder: str = ".", now: datetime | None = None) -> str:
    """A limited result as timestamped .jsonl, .csv and .txt files; returns their common path."""
    base = os.path.join(folder, f"{NAME}-results-{now or datetime.now():%Y%m%d-%H%M%S}")
    with open(base + ".jsonl", "w", encoding="utf-8") as j, open(base + ".csv", "w", encoding="utf-8", newline="") as c, open(base + ".txt", "w", encoding="utf-8") as t:
        table = csv.writer(c)
        table.writerow(("archive", "nested_path", "member", "line", "text", "patterns"))
        for m in matches.toLocalIterator():
            print(json.dumps(match_dict(m), ensure_ascii=False), file=j)
            table.writerow((m["archive"], "!".join(m["nested_path"]), m["member"], m["line"], m["text"], ";".join(m["patterns"])))
            print(match_lines(m)[0], file=t)
    return base
