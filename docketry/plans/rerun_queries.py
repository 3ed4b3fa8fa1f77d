"""Registered queries of follow-up runs, numbered log lines, nested items and pacing notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import cleanup, pacing
from docketry.operators.rerun import FollowUps
from docketry.plans.catalog import LOG, query
from docketry.plans.proxies import duck, view
from docketry.plans.scratch import scratch_folder
from docketry.sources import jsonl

#: Ends of the runs' windows; each begins 90 days before the end of the one before.
ENDS = ("1996-12-31", "1997-11-30", "1998-12-31", "2030-12-31")
_WINDOWS = ", ".join(f"({k}, {'NULL' if k == 0 else f'''strftime(DATE '{ENDS[k - 1]}' - 90, '%Y%m%d')'''}, strftime(DATE '{e}', '%Y%m%d'))" for k, e in enumerate(ENDS))


@query(duck("hits") + f""", w(batch, low, high) AS (VALUES {_WINDOWS}), f AS (SELECT DISTINCT batch, CASE WHEN family_id <> '' THEN family_id ELSE pub END AS family_key, family_id <> '' AS has_id FROM hits JOIN w ON publication_date <= high AND (low IS NULL OR publication_date >= low)),
    g AS (SELECT *, min(batch) OVER (PARTITION BY family_key) AS first_batch FROM f) SELECT batch, count(*) AS families, count(*) FILTER (has_id AND first_batch < batch) AS known, count(*) FILTER (NOT has_id OR first_batch = batch) AS new, true AS unchanged FROM g GROUP BY batch""")
def follow_up_runs(spark, sf_dir):
    runs, hits = FollowUps(spark, scratch_folder(spark, "follow-ups")), view(spark, sf_dir, "hits")
    day = lambda text, back=0: F.date_format(F.date_sub(F.lit(text).cast("date"), back), "yyyyMMdd")
    window = lambda k: hits.where((F.col("publication_date") <= day(ENDS[k])) & (F.lit(k == 0) | (F.col("publication_date") >= day(ENDS[max(k - 1, 0)], 90))))
    for k in range(len(ENDS)):
        runs.run(f"run-{k}", window(k))
    before = runs.version()
    # the second run is repeated: it gives what it gave, and nothing is committed
    again = runs.run("run-1", window(1))
    out = [(again if k == 1 else runs.result(f"run-{k}")).agg(F.lit(k).alias("batch"), F.count(F.lit(1)).alias("families"), F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("new"), F.lit(runs.version() == before).alias("unchanged")) for k in range(len(ENDS))]
    return reduce(DataFrame.unionByName, out)


@query(LOG + "SELECT line_no AS event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY line_no) AS number FROM request_log")
def log_line_numbers(spark, sf_dir):
    path = scratch_folder(spark, "log")
    log = view(spark, sf_dir, "request_log").withColumnRenamed("line_no", "event_id")
    # a file for each kind, in order, as a log is written
    line = F.to_json(F.struct("event_id", "kind", "status", "throttling"))
    log.repartition("kind").sortWithinPartitions("kind", "event_id").select("kind", line.alias("value")).write.partitionBy("kind").text(path)
    lines = jsonl.numbered_lines(spark, path)
    v = F.parse_json("value")
    return lines.select(F.try_variant_get(v, "$.event_id", "long").alias("event_id"), F.try_variant_get(v, "$.kind", "string").alias("kind"), F.col("line_no").alias("number"))


NESTED = """WITH p AS (SELECT o_orderkey AS idx, '/r' || o_custkey % 700 AS top, 'd' || o_orderkey % 30 AS mid, 'f' || o_orderkey % 900 AS leaf, CASE WHEN o_orderkey % 40 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS depth, o_orderpriority AS kind FROM orders),
    i AS (SELECT *, CASE depth WHEN 1 THEN top WHEN 2 THEN top || '/' || mid ELSE top || '/' || mid || '/' || leaf END AS path FROM p), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY path ORDER BY idx) = 1),
    kept AS (SELECT * FROM f WHERE NOT (depth > 1 AND top IN (SELECT path FROM f)) AND NOT (depth > 2 AND top || '/' || mid IN (SELECT path FROM f))) """


def _items(spark, sf_dir):
    k = F.col("o_orderkey")
    text = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    top, mid, leaf = text("/r", F.col("o_custkey") % 700), text("d", k % 30), text("f", k % 900)
    # some paths are spelled by detours
    path = F.when(k % 40 == 0, top).when(k % 5 == 0, F.concat(top, F.lit("/./x/../"), mid, F.lit("/"))).otherwise(F.concat_ws("/", top, mid, leaf))
    return view(spark, sf_dir, "orders").select(k.alias("idx"), path.alias("path"), F.col("o_orderpriority").alias("kind"), F.lit(10).cast("long").alias("bytes"))


@query(NESTED + "SELECT idx FROM kept")
def nested_items(spark, sf_dir):
    return cleanup.drop_covered(_items(spark, sf_dir)).select("idx")


@query(NESTED + "SELECT kind, count(*) AS n, CAST(10 * count(*) AS BIGINT) AS bytes FROM kept GROUP BY ROLLUP (kind)")
def nested_rollup(spark, sf_dir):
    return cleanup.rollup(_items(spark, sf_dir), "kind")


#: A moment in microseconds, and deadlines around it: some passed, some more than an hour ahead.
MOMENT = 1_705_000_000_000_000
NOTES = f"""WITH n AS (SELECT 'u' || event_id % 300 AS upstream, event_type AS service, event_id AS seq, {MOMENT} + (event_id % 5000 - 1000) * 1000000 AS due, event_id % 10 = 0 AS cools, event_id % 12 = 0 AS steps, event_id % 60 = 6 AS clears, event_id % 7 = 0 AS blocks, event_id % 14 = 0 AS says FROM events),
    j AS (SELECT upstream, max(seq) AS seq FROM n WHERE steps OR clears GROUP BY upstream),
    st AS (SELECT n.upstream, n.service, n.seq * 1000 AS interval_us FROM n JOIN j USING (upstream, seq) WHERE NOT clears),
    b AS (SELECT upstream, service, arg_max(due, seq) FILTER (blocks) AS blocked_until_us, coalesce(max(CASE WHEN says THEN 'refused' END), '') AS blocked_reason FROM n GROUP BY ALL HAVING arg_max(due, seq) FILTER (blocks) > {MOMENT} AND arg_max(due, seq) FILTER (blocks) <= {MOMENT} + 3600000000),
    c AS (SELECT upstream, arg_max(due, seq) AS cool FROM n WHERE cools GROUP BY upstream)
    SELECT upstream, service, CAST(interval_us AS BIGINT) AS interval_us, CAST(NULL AS BIGINT) AS cool_down_until_us, CAST(blocked_until_us AS BIGINT) AS blocked_until_us, blocked_reason FROM st FULL JOIN b USING (upstream, service)
    UNION ALL SELECT upstream, NULL, NULL, cool, NULL, NULL FROM c WHERE cool > {MOMENT} AND cool <= {MOMENT} + 3600000000"""


@query(NOTES)
def pacing_notes(spark, sf_dir):
    k = F.col("event_id")
    due, none = F.lit(MOMENT) + (k % 5000 - 1000) * 1_000_000, F.lit(None).cast("map<string,long>")
    steps = F.when(k % 12 == 0, F.create_map("event_type", k * 1000)).when(k % 60 == 6, F.create_map().cast("map<string,long>")).otherwise(none)
    notes = view(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (k % 300).cast("string")).alias("upstream"), F.col("event_type").alias("service"), k.alias("seq"), F.when(k % 10 == 0, due).alias("cool_down_until_us"), steps.alias("intervals"),
        F.when(k % 7 == 0, due).alias("block_until_us"), F.when(k % 14 == 0, "refused").alias("block_reason"),
    )
    return pacing.pacing_state(notes, MOMENT)
