"""Streams with timers equal a sequential replay and the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import cache_views
from docketry.operators.pacing import FUTURE_US, next_slot
from docketry.streaming import pacer

T0 = 1_700_000_000_000_000
UTC = dt.UTC


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream(spark, path, parts, schema):
    """One file, and so one batch, for each part."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(path))


def drain(spark, frame, name, state):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(state)).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def replay(events):
    """The rules one event after another, with nothing but dictionaries."""
    cool, steps, blocks, reasons, slots, out = {}, {}, {}, {}, {}, []
    live = lambda d, now: d if d is not None and now < d <= now + FUTURE_US else None
    for up, service, seq, kind, at, interval, floor, cool_until, intervals, block, reason in events:
        now = int(at.timestamp()) * 1_000_000
        if kind == "note":
            if cool_until is not None:
                cool[up] = cool_until
            if intervals is not None:
                steps[up] = intervals
            if block is not None:
                blocks[up, service] = block
            if reason is not None:
                reasons[up, service] = reason
        else:
            ready = max(now, floor or 0, live(cool.get(up), now) or 0)
            slots[up, service] = next_slot(slots.get((up, service)), now, ready, max(interval, steps.get(up, {}).get(service, 0)))
            until = live(blocks.get((up, service)), now)
            out.append((up, service, seq, slots[up, service], until, None if until is None else reasons.get((up, service), "")))
    return out


def test_notes_and_reservations(spark, tmp_path):
    rng, events, now = random.Random(3), [], T0
    for seq in range(240):
        now += rng.choice([1, 20, 400]) * 1_000_000
        at, up, service = dt.datetime.fromtimestamp(now / 1e6, UTC), rng.choice(["ops", "gp"]), rng.choice(["search", "legal"])
        ahead = lambda: now + rng.choice([-5, 30, 900, 4000]) * 1_000_000
        if rng.random() < 0.4:
            what = rng.randrange(4)
            events.append((up, service, seq, "note", at, None, None, ahead() if what == 0 else None, rng.choice([{}, {"search": 50_000_000}, {"legal": 9_000_000, "search": 1}]) if what == 1 else None, ahead() if what == 2 else None, rng.choice([None, "refused"]) if what >= 2 else None))
        else:
            events.append((up, service, seq, "reserve", at, rng.choice([1, 60, 2000]) * 1_000_000, rng.choice([None, now + 7]), None, None, None, None))
    frame = stream(spark, tmp_path / "in", [events[k : k + 60] for k in range(0, 240, 60)], pacer.EVENTS)
    got = [tuple(r) for r in drain(spark, pacer.shared_pacing(frame), "shared", tmp_path / "state")]
    want = replay(events)
    # a reason outlives its block in the replay; the stream forgets it with the block
    assert sorted(g[:5] for g in got) == sorted(w[:5] for w in want)
    assert any(g[4] is not None for g in got) and all((g[5] is None) == (g[4] is None) for g in got)


def test_expiry_equals_evict(spark, tmp_path):
    rng, rows, start = random.Random(8), [], dt.datetime(2024, 1, 1, tzinfo=UTC)
    for seq in range(150):
        at = start + dt.timedelta(hours=8 * seq)
        kind = rng.choice(["legal", "search", "family", "gp", "claims", "biblio"])
        key = f"EP.{rng.randrange(12)}" + rng.choice(["", ".A1"])
        rows.append((kind, key, at.isoformat() if rng.random() < 0.95 else "never", seq, at))
    schema = "kind string, key string, fetched_at string, seq long, at timestamp"
    frame = stream(spark, tmp_path / "in", [rows[k : k + 50] for k in range(0, 150, 50)], schema)
    gone = {(r.kind, r.key, r.fetched_at) for r in drain(spark, pacer.evictions(frame), "gone", tmp_path / "state")}
    end = rows[-1][4]
    table = cache_views.latest(spark.createDataFrame(rows, schema).withColumn("body", F.lit("")))
    kept = cache_views.evict(table, F.lit(end), kinds=("legal", "search", "family", "gp", "claims", "biblio"))
    expired = {(r.kind, r.key, r.fetched_at) for r in table.join(kept, ["kind", "key"], "left_anti").collect()}
    # of documents written again after they expired the stream has given out the earlier state too
    last = {(r.kind, r.key): r.fetched_at for r in table.collect()}
    assert {g for g in gone if last[g[:2]] == g[2]} == expired and expired
