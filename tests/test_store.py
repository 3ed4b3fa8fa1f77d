"""Stored documents as files, and as a table replaced by key."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import folders
from docketry.sources.versions import Conflict, Versioned

NOW = "2024-06-01T00:00:00+00:00"
ENTRY = "kind string, key string, ident string, fetched_at string, content string"


def now():
    return F.lit(NOW).cast("timestamp")


def entries(spark, *rows):
    return spark.createDataFrame([(k, key, f"about {key}", at, body) for k, key, at, body in rows], ENTRY)


FEW = [("biblio", "EP.1.A1", "2024-05-31T00:00:00+00:00", "<b/>"), ("gp", "US.2.B2", "2010-01-01T00:00:00", "<html>é</html>"), ("legal", "EP.1.A1", "2024-05-01T00:00:00+00:00", "<l/>"), ("search", "0a1b", "2024-05-31T12:00:00+00:00", "")]


def reads(spark, shared, local, *wanted):
    out = folders.read_store(spark, str(shared), None if local is None else str(local), spark.createDataFrame(list(wanted), "kind string, key string"), now())
    return {(r.kind, r.key): (None if r.content is None else bytes(r.content).decode(), r.ident, r.miss) for r in out.collect()}


def test_entries_lie_in_their_roots_and_come_back(spark, tmp_path):
    shared, local = tmp_path / "shared", tmp_path / "local"
    assert folders.store_documents(entries(spark, *FEW), str(shared), str(local)) == 4
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == [
        "local/ops/search/0a1b.meta.json", "local/ops/search/0a1b.xml", "shared/gp/US.2.B2.html", "shared/gp/US.2.B2.meta.json",
        "shared/ops/biblio/EP.1.A1.meta.json", "shared/ops/biblio/EP.1.A1.xml", "shared/ops/legal/EP.1.A1.meta.json", "shared/ops/legal/EP.1.A1.xml",
    ]
    assert json.loads((shared / "gp/US.2.B2.meta.json").read_text()) == {"kind": "gp", "key": "US.2.B2", "ident": "about US.2.B2", "fetched_at": "2010-01-01T00:00:00", "size": 15}
    got = reads(spark, shared, local, *[r[:2] for r in FEW], ("claims", "EP.1.A1"), ("biblio", "../x"), ("odd", "x"), ("biblio", None), (None, "x"))
    assert got == {
        ("biblio", "EP.1.A1"): ("<b/>", "about EP.1.A1", None), ("gp", "US.2.B2"): ("<html>é</html>", "about US.2.B2", None), ("legal", "EP.1.A1"): (None, None, "expired"), ("search", "0a1b"): ("", "about 0a1b", None),
        ("claims", "EP.1.A1"): (None, None, "absent"), ("biblio", "../x"): (None, None, "invalid key"), ("odd", "x"): (None, None, "unknown kind"), ("biblio", None): (None, None, "invalid key"), (None, "x"): (None, None, "unknown kind"),
    }
    # a kind is looked for in its own root alone
    assert reads(spark, local, shared, ("biblio", "EP.1.A1"))[("biblio", "EP.1.A1")][2] == "absent"


def test_a_later_write_replaces(spark, tmp_path):
    folders.store_documents(entries(spark, *FEW), str(tmp_path))
    again = [("biblio", "EP.1.A1", "2024-05-31T01:00:00+00:00", "new"), ("biblio", "EP.1.A1", "2024-05-31T00:30:00+00:00", "older")]
    assert folders.store_documents(entries(spark, *again), str(tmp_path)) == 1
    assert reads(spark, tmp_path, None, ("biblio", "EP.1.A1"), ("gp", "US.2.B2")) == {("biblio", "EP.1.A1"): ("new", "about EP.1.A1", None), ("gp", "US.2.B2"): ("<html>é</html>", "about US.2.B2", None)}
    with pytest.raises(ValueError):
        folders.store_documents(entries(spark, ("biblio", "a/b", NOW, "x")), str(tmp_path))
    assert not list(tmp_path.rglob("*.tmp"))


def test_broken_entries_are_misses(spark, tmp_path):
    folder = tmp_path / "ops" / "biblio"
    folder.mkdir(parents=True)
    told = {"kind": "biblio", "key": "k", "ident": "i", "fetched_at": "2024-05-31T00:00:00+00:00"}
    cases = {
        "whole": ("body", told | {"size": 4}, None), "unsized": ("body", told, None), "null.size": ("body", told | {"size": None}, None), "short": ("body", told | {"size": 5}, "size mismatch"), "odd.size": ("body", told | {"size": "4"}, "size mismatch"),
        "no.ident": ("body", {k: v for k, v in told.items() if k != "ident"}, "unreadable sidecar"), "list": ("body", [1], "unreadable sidecar"), "torn": ("body", None, "unreadable sidecar"), "undated": ("body", told | {"fetched_at": "soon"}, "unreadable time"), "old": ("body", told | {"fetched_at": "2023-01-01T00:00:00+00:00"}, "expired"),
        "no.body": (None, told, "missing body"), "no.meta": ("body", ..., "missing sidecar"), "nothing": (None, ..., "absent"),
    }
    for key, (body, meta, _) in cases.items():
        if body is not None:
            (folder / f"{key}.xml").write_text(body)
        if meta is not ...:
            (folder / f"{key}.meta.json").write_text("{" if meta is None else json.dumps(meta))
    (folder / "latin.xml").write_text("body")
    (folder / "latin.meta.json").write_bytes(json.dumps(told, ensure_ascii=False).replace("i", "\xe9").encode("latin-1"))
    (folder / "half.xml.77.0af9.tmp").write_text("x")
    (folder / "half2.meta.json.tmp").write_text("x")
    (folder / "readme.txt").write_text("x")
    (tmp_path / "ops" / "odd").mkdir()
    (tmp_path / "ops" / "odd" / "a.xml").write_text("x")
    (tmp_path / "ops" / "gp").mkdir()
    (tmp_path / "ops" / "gp" / "a.html").write_text("x")
    got = reads(spark, tmp_path, None, *[("biblio", k) for k in [*cases, "latin", "half"]])
    assert {k: got[("biblio", k)][2] for k in cases} == {k: c[2] for k, c in cases.items()}
    assert got[("biblio", "latin")][2] == "unreadable sidecar" and got[("biblio", "half")][2] == "stray tmp file"
    rows = {r.key: r for r in folders.inventory(spark, str(tmp_path), None, now()).collect()}
    assert set(rows) == {*cases, "latin", "half", "half2"} - {"nothing"}
    assert rows["half2"].problem == "stray tmp file" and rows["old"].expired and not rows["short"].expired and rows["no.meta"].size == 4 and rows["no.body"].size == 0
    counts = {r.kind: r.n for r in folders.quick_counts(spark, str(tmp_path)).collect()}
    assert counts["biblio"] == 12 and sum(counts.values()) == 12 and len(counts) == 7


def test_bodies_are_not_opened_by_listings(spark, tmp_path):
    folders.store_documents(entries(spark, *FEW), str(tmp_path))
    plan = folders.listing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_no_folder_and_many_wanted(spark, tmp_path, monkeypatch):
    assert folders.inventory(spark, str(tmp_path / "none"), None, now()).collect() == []
    assert reads(spark, tmp_path / "none", None, ("gp", "a"))[("gp", "a")][2] == "absent"
    folders.store_documents(entries(spark, *FEW), str(tmp_path))
    monkeypatch.setattr(folders, "BY_NAME", 1)
    assert [v[2] for _, v in sorted(reads(spark, tmp_path, None, *[r[:2] for r in FEW]).items())] == [None, None, "expired", None]


@pytest.mark.parametrize("named", [1, 1000])
def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(folders, "BY_NAME", named)
    folders.store_documents(entries(spark, *FEW), str(tmp_path))
    wanted = spark.createDataFrame([r[:2] for r in FEW], "kind string, key string")
    asked = [folders.inventory(spark, str(tmp_path), None, now()), folders.quick_counts(spark, str(tmp_path)), folders.sidecars(spark, str(tmp_path)), folders.read_store(spark, str(tmp_path), None, wanted, now())]
    # Spark's own file sources hold the names of all files on the driver; tasks list folders here
    assert not any(out.inputFiles() for out in asked)
    assert [out.count() for out in asked] == [4, 7, 4, 4]


def test_wanted_entries_meet_the_listing_by_shuffle(spark, tmp_path):
    folders.store_documents(entries(spark, *FEW), str(tmp_path))
    wanted = spark.createDataFrame([r[:2] for r in FEW], "kind string, key string")
    out = folders.read_store(spark, str(tmp_path), None, wanted, now())
    assert sorted(r.miss or "" for r in out.collect()) == ["", "", "", "expired"]
    # the plan as it ran: a listing of any size must not pass the driver
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in ran and "Broadcast" not in ran


def test_empty_sidecars_count_and_are_unreadable(spark, tmp_path):
    folder = tmp_path / "ops" / "biblio"
    folder.mkdir(parents=True)
    (folder / "k.xml").write_text("body")
    (folder / "k.meta.json").write_text("")
    assert [(r.key, r.problem) for r in folders.inventory(spark, str(tmp_path), None, now()).collect()] == [("k", "unreadable sidecar")]
    assert {r.kind: r.n for r in folders.quick_counts(spark, str(tmp_path)).collect()}["biblio"] == 1


def rows(spark, *given):
    return spark.createDataFrame([(k, key, "i", at, body) for k, key, at, body in given], ENTRY).withColumnRenamed("content", "body")


def held(table, version=None):
    return {(r.kind, r.key): bytes(r.body).decode() for r in table.read(version).collect()}


def test_commits(spark, tmp_path):
    table = Versioned(spark, str(tmp_path), buckets=4)
    assert table.version() == 0 and held(table) == {}
    assert table.replace(rows(spark, *[("gp", f"k{i}", NOW, "one") for i in range(40)], ("legal", "k1", NOW, "one"))) == 1
    assert table.replace(rows(spark, ("gp", "k3", "2024-07-01", "two"), ("gp", "k3", "2024-06-30", "older"), ("gp", "new", NOW, "two"))) == 2
    second = held(table)
    assert len(second) == 42 and second[("gp", "k3")] == second[("gp", "new")] == "two" and second[("gp", "k4")] == "one"
    assert held(table, 1)[("gp", "k3")] == "one"
    # partitions without new rows keep their files
    one, two = table._parts(1), table._parts(2)
    assert one["legal/" + next(p for p in one if p.startswith("legal")).split("/")[1]] in two.values() and set(one.values()) & set(two.values())

    few = table.entries([("gp", "k3"), ("legal", "k1"), ("legal", "none"), ("biblio", "k1")])
    assert {(r.kind, r.key, bytes(r.body)) for r in few.collect()} == {("gp", "k3", b"two"), ("legal", "k1", b"one")} and len(few.inputFiles()) <= 3

    # a third write that fails on the way leaves the second
    bad = rows(spark, ("gp", "k5", NOW, "three")).withColumn("body", F.when(F.col("key") == "k5", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert table.version() == 2 and held(table) == second
    # so does one that fails just before its marker
    lost = Versioned(spark, str(tmp_path), buckets=4)
    lost.commit = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        lost.replace(rows(spark, ("gp", "k6", NOW, "three")))
    assert held(Versioned(spark, str(tmp_path), buckets=4)) == second
    assert table.replace(rows(spark)) == 2
    assert table.vacuum(keep=1) >= 1 and held(table) == second


def test_of_two_writers_the_second_fails(spark, tmp_path):
    a, b = Versioned(spark, str(tmp_path), buckets=2), Versioned(spark, str(tmp_path), buckets=2)
    a.replace(rows(spark, ("gp", "k", NOW, "one")))
    b.version = lambda: 0
    with pytest.raises(Conflict):
        b.replace(rows(spark, ("gp", "j", NOW, "two")))
    assert held(a) == {("gp", "k"): "one"} and not list((tmp_path / "commits").glob("*.tmp"))


def test_expired_searches_leave_when_replaced(spark, tmp_path):
    table = Versioned(spark, str(tmp_path), buckets=1)
    table.replace(rows(spark, ("search", "old", "2024-05-01T00:00:00+00:00", "x"), ("legal", "old", "2024-01-01T00:00:00+00:00", "x")))
    table.replace(rows(spark, ("search", "new", "2024-05-31T12:00:00+00:00", "x")), now())
    assert set(held(table)) == {("search", "new"), ("legal", "old")}
    assert {r.key for r in table.read(kinds=["legal"]).collect()} == {"old"}
