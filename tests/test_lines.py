"""Numbered lines of split files, query files and JSON arrays."""

import json

import pytest

from docketry.sources import jsonl


@pytest.fixture
def split(spark):
    """Files are cut into splits of 400 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_numbers_over_splits(spark, tmp_path, split):
    texts = {"a.jsonl": [f"line {i} " + "x" * (i * 7 % 60) for i in range(120)], "b.jsonl": ["", "y" * 1500, "", "z", ""], "c.jsonl": ["one"], "d.jsonl": [str(i % 3) for i in range(900)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "c.jsonl" else ""))
    rows = jsonl.numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 10
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items()}


def test_log_lines_keep_their_numbers(spark, tmp_path, split):
    lines = [json.dumps({"at": "2024-01-01", "kind": "legal", "status": i}) if i % 3 else " \t" if i % 2 else "[1]" for i in range(100)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    rows = jsonl.read_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted((r.line_no, r.skipped, r.status) for r in rows) == [(i + 1, not i % 3, str(i) if i % 3 else "") for i in range(100) if i % 3 or not i % 2]


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert jsonl.numbered_lines(spark, str(tmp_path)).collect() == []


def test_query_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("　ta=x \n#no\n\n \t\n  # no\nta=y # z\n")
    assert [(r.line_no, r["query"]) for r in jsonl.read_queries(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "ta=x"), (6, "ta=y # z")]


def test_arrays(spark, tmp_path):
    for name, text in {"a": '[{"k": 1}, 5, {"k": [2]}]', "b": '{"k": 1}', "c": "[", "d": "[]"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "e").write_bytes(b"\xff")
    rows = jsonl.read_array(spark, str(tmp_path)).selectExpr("element_at(split(path, '/'), -1) AS name", "idx", "to_json(v) AS v", "problem").collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, '{"k":1}', None), ("a", 1, None, "no object"), ("a", 2, '{"k":[2]}', None), ("b", None, None, "no array"), ("c", None, None, "json"), ("e", None, None, "encoding")]
