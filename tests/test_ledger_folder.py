"""Ledgers checked from a folder, and rules built alone."""

import json

from pyspark.sql import functions as F

from docketry.operators import ledger
from docketry.sources.ledgers import ledger_check, read_ledgers
from tests.test_records import BREAKS, LEDGER, frames, written


def lay(base, target, edits=None):
    """A whole ledger as files, with the report files it names."""
    folder = base / "ledger" / target
    folder.mkdir(parents=True)
    files = {name: "".join(json.dumps(r) + "\n" for r in rows) for name, rows in LEDGER.items()}
    files |= {"ledger.json": json.dumps({"format": 1, "target": target, "created_at": "2028-02-14T11:00:00Z"}), "translation.md": ""} | (edits or {})
    for name, text in files.items():
        if text is not None:
            (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    (base / "reports").mkdir(exist_ok=True)
    for name in ("winter.md", "summer.md"):
        (base / "reports" / name).write_text("x")


def test_folder(spark, tmp_path):
    lay(tmp_path, "whole")
    lay(tmp_path, "odd", {"translation.md": None, "queries.jsonl": "", "watch.jsonl": b"\xff", "features.jsonl": LEDGER_WITH_BLANKS, "ledger.json": "[]"})
    (tmp_path / "ledger" / "Bare").mkdir()
    (tmp_path / "ledger" / "note.txt").write_text("x")
    rows = {r.target: r for r in ledger_check(spark, str(tmp_path)).collect()}
    assert set(rows) == {"whole", "odd", "Bare"}
    whole, odd, bare = rows["whole"], rows["odd"], rows["Bare"]
    assert whole.ok and whole.errors == whole.warnings == [] and tuple(whole.counts) == (2, 2, 2, 2, 2)
    assert [(f.file, f.line, f.rule) for f in odd.errors] == [("ledger.json", None, "json"), ("features.jsonl", 3, "id-format"), ("features.jsonl", 4, "json"), ("watch.jsonl", None, "encoding")]
    assert [(f.file, f.rule) for f in odd.warnings] == [("translation.md", "translation-missing")] and odd.counts.queries == 0 and odd.counts.features == 3 and not odd.ok
    assert [f.rule for f in bare.errors] == ["missing-file"] * 6 and [f.rule for f in bare.warnings] == ["target-name", "translation-missing"]


LEDGER_WITH_BLANKS = "\n".join([json.dumps(LEDGER["features.jsonl"][0]), " \t", json.dumps(LEDGER["features.jsonl"][1] | {"id": "x"}), "{", json.dumps(LEDGER["features.jsonl"][1])]) + "\n"


def test_reports_and_one_target(spark, tmp_path):
    lay(tmp_path, "whole")
    (tmp_path / "reports" / "summer.md").unlink()
    row = ledger_check(spark, str(tmp_path), "whole").first()
    assert [(f.file, f.line, f.rule, f.key) for f in row.errors] == [("runs.jsonl", 2, "report-missing", "report")]
    gone = ledger_check(spark, str(tmp_path), "other").collect()
    assert [(r.target, r.ok, [f.rule for f in r.errors]) for r in gone] == [("other", False, ["missing-ledger"])]
    assert [f.rule for f in ledger_check(spark, str(tmp_path / "nowhere")).first().errors] == ["missing-ledger"]


def test_wanted_rules_give_what_all_rules_give(spark):
    _, files, lines, _, _ = frames(spark, *written([b[:3] for b in BREAKS]))
    every = {tuple(r) for r in ledger.line_findings(lines).collect()}
    by = {rule: {f for f in every if f[3] == rule} for rule in {f[3] for f in every}}
    assert len(by) >= 12
    for rules in ({"required-key"}, {"enum", "window"}, {"pub-spelling", "pub-kind"}, {"snapshot"}, {"id-format"}):
        got = {tuple(r) for r in ledger.line_findings(lines, rules).collect()}
        assert got == set().union(*(by[r] for r in rules))
    refs = {tuple(r) for r in ledger.reference_findings(lines, files).collect()}
    assert {tuple(r) for r in ledger.reference_findings(lines, files, {"run-ref"}).collect()} == {r for r in refs if r[3] == "run-ref"} != set()
    assert ledger.line_findings(lines, {"no rule"}).collect() == []


def test_unwanted_rules_are_not_in_the_plan(spark, tmp_path):
    lay(tmp_path, "whole")
    lines = read_ledgers(spark, str(tmp_path)).lines
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(ledger.line_findings(lines, {"reason-missing"}).select(F.count("*"))) * 4 < size(ledger.line_findings(lines).select(F.count("*")))
