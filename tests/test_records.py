"""One JSON value or quoted CSV file read by several tasks."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.sources import formats, records

TEXTS = ["plain", 'quote " and \\ backslash', "brackets ]}{[ inside", "line\nbreak", "tab\t", "ünï 日本 \U0001f600", "ends with backslash\\", '\\"', ""]


def values(df):
    return [r.value for r in df.orderBy("file", "idx").collect()]


@pytest.mark.parametrize("stretch", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_array_elements(spark, tmp_path, stretch, ascii_only):
    rng = random.Random(stretch)
    for n in range(2):
        rows = [{"id": i, "t": rng.choice(TEXTS) * rng.randrange(4), "more": [{"x": rng.choice(TEXTS)} for _ in range(rng.randrange(3))]} for i in range(60)]
        (tmp_path / f"f{n}.json").write_text(json.dumps(rows, ensure_ascii=ascii_only, indent=n or None), encoding="utf-8")
    got = records.json_records(spark, str(tmp_path), 1, stretch)
    want = [r for n in range(2) for r in json.loads((tmp_path / f"f{n}.json").read_text(encoding="utf-8"))]
    assert [json.loads(v) for v in values(got)] == want
    assert [r.idx for r in got.orderBy("file", "idx").collect()] == list(range(60)) * 2


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"id": i, "t": "x" * 50} for i in range(500)]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    got = records.json_records(spark, str(tmp_path / "f.json"), 1, 4000).withColumn("task", F.spark_partition_id())
    per = {r["task"]: r["count"] for r in got.groupBy("task").count().collect()}
    assert sum(per.values()) == 500 and len(per) >= 4 and max(per.values()) < 300


def test_lines_and_nested_arrays(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"i": i, "s": "a\"b}"}) for i in range(20)))
    assert [json.loads(v)["i"] for v in values(records.json_records(spark, str(tmp_path / "l.json"), 0, 33))] == list(range(20))
    (tmp_path / "n.json").write_text(json.dumps({"version": "x{", "data": [{"i": i, "p": [{"q": []}]} for i in range(20)]}))
    assert [json.loads(v)["i"] for v in values(records.json_records(spark, str(tmp_path / "n.json"), 2, 20))] == list(range(20))
    (tmp_path / "e.json").write_text("")
    assert values(records.json_records(spark, str(tmp_path / "e.json"))) == []
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"b": ')
    with pytest.raises(Exception, match="ends inside a record"):
        values(records.json_records(spark, str(tmp_path / "cut.json")))


@pytest.mark.parametrize("stretch", [5, 50, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv(spark, tmp_path, stretch, end, monkeypatch):
    rng = random.Random(3)
    cells = ["plain", 'say "hi"', "two\nlines", "comma, inside", "x\n\n\"\"\ny", "日本"]
    rows = [[rng.choice(cells) for _ in range(3)] for _ in range(40)]
    with open(tmp_path / "f.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["a", "b", "c"], *rows])
    monkeypatch.setattr(formats, "csv_records", lambda s, p: records.csv_records(s, p, stretch))
    got = formats.read_quoted_csv(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["a", "b", "c"] and sorted(map(list, got.collect())) == sorted(rows)
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "f.csv"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.collect()))


def test_squad_equals_the_plain_reader(spark, tmp_path, monkeypatch):
    docs = [{"title": f"t{d}", "paragraphs": [{"context": f"c{d} {p} \"quoted\" [x]", "qas": [
        {"id": f"{d}-{p}-{q}", "question": "why?", "is_impossible": q == 1, "answers": [{"text": "c", "answer_start": 0}] if q != 1 else []} for q in range(3)]}
        for p in range(4)]} for d in range(30)]
    f = str(tmp_path / "s.json")
    with open(f, "w") as h:
        json.dump({"version": "v2.0", "data": docs}, h)
    monkeypatch.setattr(formats, "json_records", lambda s, p, depth: records.json_records(s, p, depth, 700))
    got = formats.read_squad(spark, f)
    raw = spark.read.schema(formats.SQUAD_SCHEMA).option("multiLine", True).json(f).select(F.posexplode("data").alias("doc_idx", "d"))
    p = raw.select("doc_idx", F.posexplode("d.paragraphs").alias("par_idx", "p")).select("doc_idx", "par_idx", "p.context", F.explode("p.qas").alias("qa"))
    want = p.select("doc_idx", "par_idx", "context", F.col("qa.id").alias("qid"), "qa.question", "qa.answers",
                    F.when(F.col("qa.is_impossible"), "no_answer").otherwise("span").alias("answer_type"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 360


def test_retrieval_samples_and_orders(spark, tmp_path):
    rows = [{"question": f"q{i}?", "positive_ctxs": [{"title": "t", "text": f"p{i}-{k}"} for k in range(5)], "hard_negative_ctxs": [{"text": f"n{i}", "passage_id": "9"}]} for i in range(40)]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    plain = formats.read_retrieval_json(spark, str(tmp_path / "r.json"), 2).collect()
    assert sorted(map(str, plain)) == sorted(map(str, formats.read_retrieval_json(spark, str(tmp_path / "r.jsonl"), 2, lines=True).collect()))
    assert all([c.text for c in r.positives] == [f"p{r.query[1:]}-0", f"p{r.query[1:]}-1"] for r in plain)
    few = [formats.read_retrieval_json(spark, str(tmp_path / "r.json"), max_samples=7, seed=5).collect() for _ in range(2)]
    assert sorted(map(str, few[0])) == sorted(map(str, few[1])) and len({r.query for r in few[0]}) == 7
    mixed = formats.read_retrieval_json(spark, str(tmp_path / "r.json"), 5, shuffle_positives=True).collect()
    assert all(len({c.text for c in r.positives}) == 5 for r in mixed) and any([c.text[-1] for c in r.positives] != list("01234") for r in mixed)
