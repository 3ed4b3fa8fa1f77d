"""Patent-like views of the driver's tables; each is given as the same expression in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("US", "EP", "WO", "GB", "CA", "AU", "KR", "CN", "JP", "DE")
_LIST = ", ".join(f"'{c}'" for c in COUNTRIES)

#: SQL that both engines read alike, by name of the view.  Element numbers count from 1 in both.
SHARED = {
    "pub_strings": """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 17 = 0 THEN concat('X', CAST(o_orderkey AS {text}))
        WHEN o_orderkey % 5 = 1 THEN concat('US', CAST(1990 + o_orderkey % 40 AS {text}), CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '' END, lpad(CAST(o_orderkey % 1000000 AS {text}), 6, '0'), 'A', CAST(o_orderkey % 3 AS {text}))
        WHEN o_orderkey % 5 = 2 THEN concat(' ', lower({country}), '-', CAST(10000 + o_orderkey AS {text}), ' B1 ')
        ELSE concat({country}, '.', CAST(10000 + o_orderkey AS {text}), CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('.', o_orderstatus) END) END AS pub,
        CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS {text}) END AS family_id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS abstract, {ymd} AS publication_date, concat('Q', CAST(o_orderkey % 5 AS {text})) AS query_id FROM orders""",
    "hits": """SELECT idx, pub, family_id, abstract, publication_date, query_id FROM pub_strings""",
    "known": "SELECT CAST(c_custkey AS {text}) AS family_id FROM customer WHERE c_nationkey < 12",
    "verify_in": "SELECT o_orderkey AS idx, concat('EP', CAST(o_orderkey AS {text}), 'A1') AS pub FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 22 = 0",
    "verify_out": "SELECT l_orderkey * 10 + l_linenumber AS idx, CASE WHEN l_orderkey % 19 = 0 THEN concat('?', CAST(l_orderkey AS {text})) ELSE concat('ep.', CAST(l_orderkey AS {text}), '.a1') END AS pub FROM lineitem",
    "request_log": """SELECT event_id AS line_no, ts AS at, event_type AS kind, CASE WHEN event_id % 50 = 0 THEN '403' WHEN event_id % 9 = 0 THEN '404' ELSE '200' END AS status,
        CASE WHEN event_id % 31 = 0 THEN 'garbage' ELSE concat(CASE event_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'busy' ELSE 'overloaded' END, ' (search=', CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' ELSE 'black' END, ':', CAST(event_id % 7 AS {text}), ', other=green:1000)') END AS throttling FROM events""",
    "legal_events": """SELECT concat('EP.', CAST(1000000 + user_id AS {text}), '.A1') AS pub, event_id AS pos, {event_ymd} AS gazette_date, event_type AS code, event_type AS descr, CAST(event_id % 3 AS {text}) AS pre, ts FROM events""",
    "family_members": "SELECT concat('F', CAST(c_nationkey AS {text})) AS pub, CAST(c_custkey AS {text}) AS member, c_custkey AS k FROM customer",
    "cache_meta": """SELECT CASE doc_id % 7 WHEN 0 THEN 'biblio' WHEN 1 THEN 'claims' WHEN 2 THEN 'legal' WHEN 3 THEN 'family' WHEN 4 THEN 'gp' WHEN 5 THEN 'search' ELSE 'searchbib' END AS kind,
        CASE WHEN doc_id % 7 >= 5 THEN concat('h', CAST(doc_id AS {text})) WHEN doc_id % 3 = 0 THEN concat('EP.', CAST(doc_id AS {text})) ELSE concat('EP.', CAST(doc_id AS {text}), '.A1') END AS key,
        doc_id, n_chars AS size, CASE WHEN doc_id % 23 = 0 THEN n_chars + 1 ELSE n_chars END AS meta_size, doc_id % 29 <> 0 AS has_body, doc_id % 31 <> 0 AS has_meta, doc_id % 37 <> 0 AS meta_ok,
        doc_id % 41 <> 0 AS readable FROM documents""",
    "claim_text": """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('The device of claim ', CAST(p_size AS {text}), ', wherein it is ', p_name, '.')
        WHEN 1 THEN concat('A ', p_name, ' according to claim ', CAST(p_size AS {text}), '.') WHEN 2 THEN concat('A ', p_name, ' comprising parts.') ELSE concat('See claim 0 and ', p_name) END AS text, CAST(p_partkey % 60 AS int) AS n FROM part""",
    "runs": "SELECT 'main' AS target, 'runs.jsonl' AS file, CAST(r_regionkey + 1 AS int) AS line, concat('2024010', CAST(r_regionkey % 4 AS {text}), '-0001') AS run_id, concat('2024-01-0', CAST(5 - r_regionkey % 3 AS {text}), 'T00:00:00+00:00') AS started_at, CASE WHEN r_regionkey % 2 = 0 THEN 'standard' ELSE 'degraded' END AS mode FROM region",
    "features": "SELECT 'main' AS target, 'features.jsonl' AS file, CAST(n_nationkey + 1 AS int) AS line, concat('F', CAST(n_nationkey % 20 AS {text})) AS id, CASE n_regionkey WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'other' END AS priority, CASE WHEN n_nationkey % 6 = 0 THEN 'excluded' ELSE 'active' END AS status FROM nation",
    "queries_": "SELECT 'main' AS target, 'queries.jsonl' AS file, CAST(c_custkey AS int) AS line, concat(CASE WHEN c_custkey % 9 = 0 THEN 'q' ELSE 'Q' END, CAST(c_custkey AS {text})) AS id, concat('F', CAST(c_nationkey AS {text})) AS feature, concat('2024010', CAST(c_custkey % 6 AS {text}), '-0001') AS run, CASE WHEN c_custkey % 7 = 0 THEN 'ta=x and PD within 1' ELSE c_mktsegment END AS cql, c_mktsegment AS segment, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'rejected' WHEN c_custkey % 10 = 2 THEN 'kept' ELSE 'adopted' END AS status, CASE WHEN c_custkey % 8 = 0 THEN '2024' ELSE 'all' END AS win FROM customer",
    "families": "SELECT 'main' AS target, 'families.jsonl' AS file, CAST(p_partkey AS int) AS line, CAST(p_partkey AS {text}) AS family_id, CASE p_partkey % 11 WHEN 0 THEN concat('EP', CAST(p_partkey AS {text}), 'A1') WHEN 1 THEN 'not a number' ELSE concat('EP.', CAST(p_partkey AS {text}), '.A1') END AS pub, CASE WHEN p_partkey % 9 = 0 THEN 'D' ELSE 'A' END AS stage1 FROM part",
    "watch_lines": "SELECT 'main' AS target, 'watch.jsonl' AS file, CAST(o_orderkey AS int) AS line, CASE WHEN o_orderkey % 15 = 0 THEN concat('EP.', CAST(o_orderkey AS {text})) ELSE concat('EP.', CAST(o_orderkey AS {text}), '.A1') END AS pub, CAST(o_orderkey % 3000 AS {text}) AS family_id, concat('2024010', CAST(1 + o_orderkey % 2 AS {text}), '-0001') AS run, CASE WHEN o_orderkey % 12 = 0 THEN '2024-13-01' ELSE {iso} END AS next_check, CASE WHEN o_orderstatus = 'F' THEN '20240100-0001' END AS closed_run, CASE WHEN o_orderkey % 6 = 0 THEN 'provisional' ELSE 'in-force' END AS reason, o_orderkey % 7 = 0 AS shotless, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 7 = 0 THEN 'timeout' END AS shot_error FROM orders",
    "nation_targets": "SELECT CASE WHEN n_nationkey % 7 = 0 THEN n_name ELSE concat('t', CAST(n_nationkey AS {text})) END AS target, n_nationkey AS k, n_nationkey % 7 = 0 AS bad FROM nation",
    "arrivals": """SELECT event_type AS service, event_id AS seq, {micros} AS at_us, CASE WHEN event_id % 10 = 0 THEN 4000000000 ELSE 1000000000 END AS interval_us, CASE WHEN event_id % 25 = 0 THEN {micros} + 1500000000 END AS floor_us,
        CASE WHEN event_id % 40 = 0 THEN {micros} + 900000000 WHEN event_id % 41 = 0 THEN {micros} + 9000000000 END AS cool_down_us, CASE WHEN event_id % 16 = 0 THEN 2000000000 END AS tight_us FROM events""",
}
SPARK = {"text": "string", "country": f"element_at(array({_LIST}), CAST(o_orderkey % 10 + 1 AS int))", "ymd": "date_format(o_orderdate, 'yyyyMMdd')", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "event_ymd": "CASE WHEN event_id % 43 = 0 THEN 'n/a' ELSE date_format(ts, 'yyyyMMdd') END", "micros": "unix_micros(CAST(ts AS timestamp))"}
DUCK = {"text": "VARCHAR", "country": f"list_extract([{_LIST}], CAST(o_orderkey % 10 + 1 AS int))", "ymd": "strftime(o_orderdate, '%Y%m%d')", "iso": "strftime(o_orderdate, '%Y-%m-%d')", "event_ymd": "CASE WHEN event_id % 43 = 0 THEN 'n/a' ELSE strftime(ts, '%Y%m%d') END", "micros": "epoch_us(ts)"}
#: Tables and views that each view reads.
READS = {"pub_strings": ("orders",), "hits": ("pub_strings",), "known": ("customer",), "verify_in": ("orders",), "verify_out": ("lineitem",), "request_log": ("events",), "legal_events": ("events",), "family_members": ("customer",), "cache_meta": ("documents",), "claim_text": ("part",), "runs": ("region",), "features": ("nation",), "queries_": ("customer",), "families": ("part",), "nation_targets": ("nation",), "watch_lines": ("orders",), "arrivals": ("events",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy view, or one of the driver's tables."""
    if name not in SHARED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: view(spark, sf_dir, n) for n in READS[name]}
    query = SHARED[name].format(**SPARK)
    for n in READS[name]:
        query = query.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(query, **inputs)


def duck(*names: str) -> str:
    """A WITH clause that defines the views for DuckDB."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for inner in READS.get(name, ()):
            add(inner)
        if name in SHARED and name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SHARED[n].format(**DUCK)})" for n in wanted) + " "


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "legal_events").select("pub", "pos", "gazette_date", "code", F.col("descr").alias("desc"), F.array("pre").alias("pre_lines"), "ts")
