"""Stored snapshots read back from JSON and compared as multisets."""

import json

from pyspark.sql import functions as F
from tests.test_records import LEDGER, SUMMER, frames, written

from docketry.operators import ledger, snapshots

EVENTS = "array<struct<code: string, desc: string, gazette_date: string, pre_lines: array<string>>>"
LAPSE = lambda state, day="20280301": ("PG25", "lapsed", day, [state])


def status(spark, *rows):
    """Rows ``pub, events[, note]``."""
    return spark.createDataFrame([(r[0], "t1", r[1], r[2] if len(r) > 2 else None) for r in rows], f"pub string, fetched_at string, events {EVENTS}, note string")


def kin(spark, *rows):
    return spark.createDataFrame([(p, "t2", f, m) for p, f, m in rows], "pub string, fetched_at string, family_id string, members array<string>")


def stored(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx int, raw string").select("idx", F.parse_json("raw").alias("v"))


def built(spark, legal, family):
    return [r["s"] for r in snapshots.build_snapshot(legal, family).select(F.to_json("snapshot").alias("s")).orderBy("s").collect()]


def test_the_record(spark):
    legal = status(spark, ("EP.2.A1", [LAPSE("SE"), LAPSE("DE"), LAPSE("SE")]), ("EP.3.A1", [], "nothing reported"))
    one, two = [json.loads(s) for s in built(spark, legal, kin(spark, ("EP.2.A1", "9", ["b", "a", "b", None]), ("EP.3.A1", None, [])))]
    assert one["snapshot_format"] == 1 and one["legal"]["event_count"] == 3 and len(one["legal"]["events"]) == 3 and "note" not in one["legal"]
    assert one["legal"]["events"] == sorted(one["legal"]["events"]) and one["family"] == {"fetched_at": "t2", "family_id": "9", "members": ["a", "b", "b"]}
    assert two["legal"] == {"fetched_at": "t1", "event_count": 0, "events": [], "note": "nothing reported"} and two["family"]["members"] == []


def test_round_trip_gives_no_change(spark):
    legal, family = status(spark, ("EP.2.A1", [LAPSE("SE"), LAPSE("DE"), LAPSE("SE")])), kin(spark, ("EP.2.A1", "9", ["b", "a"]))
    turned = status(spark, ("EP.2.A1", [LAPSE("DE"), LAPSE("SE"), LAPSE("SE")]))
    row = snapshots.diff_snapshots(turned, family, stored(spark, *built(spark, legal, family))).first()
    assert (row.changed, row.first_snapshot, row.legal.new_events, row.legal.missing_events, row.legal.previous_fetched_at, row.family.previous_fetched_at) == (False, False, [], [], "t1", "t2")


def test_events_are_counted(spark):
    family = kin(spark, ("EP.2.A1", "9", ["a"]), ("EP.4.A1", "9", ["a"]))
    before = built(spark, status(spark, ("EP.2.A1", [LAPSE("SE"), LAPSE("DE"), LAPSE("DE")])), kin(spark, ("EP.2.A1", "8", ["a", "c", "c"])))
    now = status(spark, ("EP.2.A1", [LAPSE("SE"), LAPSE("FR"), LAPSE("SE", "n/a"), LAPSE("SE"), LAPSE("DE")]), ("EP.4.A1", [LAPSE("SE")]))
    rows = {r.pub: r for r in snapshots.diff_snapshots(now, family, stored(spark, *before), F.lit("2028-01-01").cast("date")).collect()}
    a, b = rows["EP.2.A1"], rows["EP.4.A1"]
    # of a repeated event the later occurrence is the new one
    assert [e.pre_lines[0] + e.gazette_date for e in a.legal.new_events] == ["FR20280301", "SEn/a", "SE20280301"]
    assert len(a.legal.missing_events) == 1 and a.changed and (a.family.new_members, a.family.missing_members) == ([], ["c"])
    assert (a.family.family_id_changed["from"], a.family.family_id_changed.to) == ("8", "9")
    assert (len(a.legal.events_since), a.legal.undated_events) == (4, 1)
    assert b.first_snapshot and not b.changed and b.legal.new_events == [] and b.family.new_members == [] and b.legal.previous_fetched_at is None


def test_stored_parts_of_any_type(spark):
    text = json.dumps({"pub": "ep 2 a1", "snapshot_format": 1, "legal": {"fetched_at": 5, "events": [["20280301", "X", 7], [], "s", {"a": 1}, ["20280301", "X", None], ["20280301", "X", ""]]}, "family": {"family_id": 9, "members": ["a", 3, None]}})
    row = snapshots.index_previous(stored(spark, text)).first()
    assert row.key == "EP.2.A1" and row["keys"] == [["20280301", "X", ""]] * 3 and row.members == ["a"] and row.fetched_at is None
    diff = snapshots.diff_snapshots(status(spark, ("EP.2.A1", [])), kin(spark, ("EP.2.A1", "9", ["a"])), stored(spark, text)).first()
    assert len(diff.legal.missing_events) == 3 and diff.family.family_id_changed["from"] == "9" and diff.family.missing_members == []


def test_problems_of_stored_snapshots(spark):
    whole = {"pub": "US.1.A1", "snapshot_format": 1, "legal": {}, "family": {}}
    without = lambda k: {a: b for a, b in whole.items() if a != k}
    cases = ["x", without("pub"), whole | {"pub": 5}, whole | {"pub": "no number"}, without("snapshot_format"), whole | {"snapshot_format": 2}, whole | {"snapshot_format": "1"}, without("legal"), whole | {"legal": []}, without("family"), whole, whole | {"pub": "us1a1"}, whole | {"pub": "US.2.A1", "snapshot_format": 1.0}]
    rows = snapshots.index_previous(stored(spark, *map(json.dumps, cases))).orderBy("idx").collect()
    assert [r.problem for r in rows] == ["no object", "pub missing", "pub is no text", "pub unparseable", "format", "format", "format", "legal", "legal", "family", None, "repeated", None]
    assert snapshots.index_previous(stored(spark)).collect() == []


def test_watch(spark):
    pubs = spark.createDataFrame([(0, "EP4A1"), (1, "EP 2 A1"), (2, "EP.5.A1"), (3, "EP.6.A1")], "idx int, pub string")
    family = kin(spark, ("EP.2.A1", "9", ["a"]), ("EP.4.A1", "9", ["a"]))
    before = built(spark, status(spark, ("EP.2.A1", [LAPSE("SE")]), ("EP.7.A1", [])), kin(spark, ("EP.2.A1", "9", ["a"]), ("EP.7.A1", "1", [])))
    errors = spark.createDataFrame([("EP.5.A1", "external_api_error", "503")], "pub string, error_type string, error string")
    results = snapshots.watch(pubs, status(spark, ("EP.2.A1", [LAPSE("SE")] * 2), ("EP.4.A1", [])), family, stored(spark, *before), errors)
    rows = results.collect()
    assert [(r.pub, r.changed, r.first_snapshot, r.error_type) for r in rows] == [("EP.4.A1", False, True, None), ("EP.2.A1", True, False, None), ("EP.5.A1", None, None, "external_api_error"), ("EP.6.A1", None, None, "upstream_data")]
    assert tuple(snapshots.watch_counts(results, pubs, stored(spark, *before)).first()) == (1, 0, 1, 2, 1)


def test_a_ledger_takes_the_snapshot(spark):
    pub = LEDGER["watch.jsonl"][0]["pub"]
    shot = json.loads(built(spark, status(spark, (pub, [LAPSE("SE")] * 2)), kin(spark, (pub, "41200931", [pub])))[0])
    found = ledger.check(*frames(spark, *written([("watch.jsonl", 0, {"snapshot": shot, "checked_run": SUMMER})]))).collect()
    assert found == []
