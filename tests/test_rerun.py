"""Batches over overlapping windows are done once."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import rerun
from docketry.operators.rerun import FollowUps

HITS = "idx long, pub string, family_id string, abstract string, publication_date string, query_id string"


def hits(spark, *families):
    return spark.createDataFrame([(i, f"EP.{f or i}.A1", f, "", "20240101", "Q1") for i, f in enumerate(families)], HITS)


def split(frame):
    return {(r.family_id, r.known) for r in frame.collect()}


def test_a_batch_replayed_changes_nothing(spark, tmp_path):
    runs = FollowUps(spark, str(tmp_path))
    assert split(runs.run("one", hits(spark, "a", "b", "a", ""))) == {("a", False), ("b", False), ("", False)}
    assert split(runs.run("two", hits(spark, "b", "c", ""))) == {("b", True), ("c", False), ("", False)}
    assert split(runs.run("one", hits(spark, "a", "z"))) == {("a", False), ("b", False), ("", False)}
    assert runs.version() == 2 and {tuple(r) for r in runs.known().collect()} == {("a", "one"), ("b", "one"), ("c", "two")}
    assert {r.family_id for r in runs.known(1).collect()} == {"a", "b"} and runs.result("three") is None


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    runs = FollowUps(spark, str(tmp_path))
    runs.run("one", hits(spark, "a"))
    with pytest.raises(Exception, match="lost"):
        runs.run("two", hits(spark, "b").withColumn("abstract", F.raise_error(F.lit("lost"))))
    broken = FollowUps(spark, str(tmp_path))
    broken.commit = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        broken.run("two", hits(spark, "b"))
    assert runs.version() == 1 and runs.result("two") is None
    assert split(runs.run("two", hits(spark, "a", "b"))) == {("a", True), ("b", False)}


def test_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rerun, "FOLDERS", 2)
    runs = FollowUps(spark, str(tmp_path))
    for k in range(5):
        runs.run(str(k), hits(spark, f"f{k}", "same"))
    assert len(runs.marker(5)["known"]) <= 2
    assert {tuple(r) for r in runs.known().collect()} == {("same", "0"), *((f"f{k}", str(k)) for k in range(5))}


def test_a_stream_of_batches(spark, tmp_path):
    for k, families in enumerate((["a", "b"], ["b", "c"])):
        hits(spark, *families).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    runs = FollowUps(spark, str(tmp_path / "table"))
    source = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    for _ in range(2):
        # the second start begins again from the first batch, as after a lost checkpoint
        q = source.writeStream.foreachBatch(runs.sink).option("checkpointLocation", str(tmp_path / f"state{_}")).start()
        q.processAllAvailable()
        q.stop()
    assert runs.version() == 2 and {r.family_id for r in runs.known().collect()} == {"a", "b", "c"}
