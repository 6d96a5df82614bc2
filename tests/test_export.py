"""Every writer: what is read back equals what was written."""

import csv
import json

from botqa.sources import export as X

TEXTS = ["plain", "two\nlines", 'says "hi", then, leaves', "é中\U0001f600", "back\\slash", "", None]


def _pairs(spark):
    rows = [(i, t, f"out {i}\n\"x\"", "HALLUCINATION" if i % 2 else None, "EASY") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "scenario_id long, input string, correct_output string, failure_type string, difficulty string")


def _lines(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text(encoding="utf-8").split("\n") if line]


def test_finetune_lines(spark, tmp_path):
    X.write_finetune_jsonl(_pairs(spark), str(tmp_path / "o"))
    got = [json.loads(line) for line in _lines(tmp_path / "o")]
    assert len(got) == len(TEXTS)
    said = {g["messages"][1]["content"]: g["messages"][0].get("content") for g in got}
    assert said == {f"out {i}\n\"x\"": t for i, t in enumerate(TEXTS)}
    assert all([m["role"] for m in g["messages"]] == ["user", "assistant"] for g in got)
    assert sum(g["metadata"].get("failure_type") == "HALLUCINATION" for g in got) == 3


def test_finetune_records(spark, tmp_path):
    pairs = _pairs(spark)
    X.write_finetune_json(pairs, str(tmp_path / "o"))
    back = spark.read.schema(pairs.schema).json(str(tmp_path / "o"))
    assert sorted(map(str, back.collect())) == sorted(map(str, pairs.collect()))


def test_csv(spark, tmp_path):
    pairs = _pairs(spark)
    X.write_csv(pairs, str(tmp_path / "o"))
    back = spark.read.schema(pairs.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "o"))
    # the file tells "" from nothing, Spark's reader does not
    assert sorted(map(str, back.fillna("").collect())) == sorted(map(str, pairs.fillna("").collect()))
    plain = []
    for f in (tmp_path / "o").glob("part-*.csv"):
        with open(f, encoding="utf-8", newline="") as h:
            plain += list(csv.DictReader(h))
    assert {r["scenario_id"]: r["input"] for r in plain} == {str(i): t or "" for i, t in enumerate(TEXTS)}


def test_text(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(50)], "line string")
    X.write_text(lines, str(tmp_path / "o"), "line")
    assert sorted(_lines(tmp_path / "o")) == sorted(f"line {i}" for i in range(50))
    X.write_text(lines.limit(1), str(tmp_path / "o"), "line")  # written again: replaced
    assert len(_lines(tmp_path / "o")) == 1
