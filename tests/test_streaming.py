from docketry.operators.pacing import pacing_slots
from docketry.streaming.logs import log_stream, pacing_stream, usage_by_window

SCHEMA = "service string, seq long, at_us long, interval_us long"


def test_stream_of_slots_equals_batch(spark, tmp_path):
    # the last service falls more than an hour behind
    rows = [(f"s{i % 3}", i, i * 700_000, 1_000_000 * (1 + i % 4) * (1 if i % 3 else 200)) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(3, "seq").write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = pacing_stream(log_stream(spark, str(tmp_path / "in"), SCHEMA)).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        got = {(r.service, r.seq): r.slot_us for r in spark.table("slots").collect()}
    finally:
        q.stop()
    assert got == {(r.service, r.seq): r.slot_us for r in pacing_slots(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_windows_of_a_log(spark, tmp_path):
    rows = [(f"2024-01-01T0{h}:00:00", "search", "idle (search=red:1)" if h % 2 else "") for h in range(6)]
    spark.createDataFrame(rows, "at string, kind string, throttling string").write.json(str(tmp_path / "in"))
    q = usage_by_window(log_stream(spark, str(tmp_path / "in"), "at string, kind string, throttling string")).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        got = spark.table("windows").collect()
    finally:
        q.stop()
    assert len(got) == 6 and sum(r.non_green for r in got) == 3
