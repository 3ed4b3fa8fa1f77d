"""Registered queries of the record operators over proxy views, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import claims as claim_functions
from docketry.functions import pubnum, records
from docketry.operators import cache_views, hits, pacing, snapshots, usage
from docketry.plans.proxies import duck, legal, view
from docketry.sources import xml
from docketry.sources.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def parsed_sql(source: str, column: str = "pub") -> str:
    """CTEs ``m`` and ``p``: the view's rows with ``country, number, kind, docdb``, null where a number doesn't parse."""
    groups = "['country', 'sep', 'num', 'lead', 'kind']"
    return f"""m AS (SELECT *, regexp_extract(upper(trim({column})), '{pubnum.PATTERN}', {groups}) AS g FROM {source}),
        n AS (SELECT *, replace(g.num, '/', '') AS num0, g.country <> '' AND length(replace(g.num, '/', '')) <= 12 AND (g.lead = '' OR g.sep <> '' OR g.country IN ('JP', 'TW', 'HU', 'BR')) AS ok FROM m),
        p AS (SELECT * EXCLUDE (g, num0, ok), CASE WHEN ok THEN g.country END AS country, CASE WHEN ok THEN g.kind END AS kind,
              CASE WHEN ok THEN CASE WHEN g.country = 'US' AND g.kind LIKE 'A%' AND regexp_full_match(num0, '(19|20)[0-9][0-9]0[0-9]{{6}}') AND num0[1:4] < '2026' THEN num0[1:4] || num0[6:] ELSE num0 END END AS number FROM n) """


DOCDB = "country || '.' || number || CASE WHEN kind <> '' THEN '.' || kind ELSE '' END"
KEYED_HITS = duck("hits") + ", " + parsed_sql("hits") + """, r AS (SELECT *, CASE WHEN family_id <> '' THEN family_id ELSE pub END AS family_key, row_number() OVER (
    PARTITION BY CASE WHEN family_id <> '' THEN family_id ELSE pub END ORDER BY CASE WHEN abstract <> '' THEN 0 ELSE 1 END,
    coalesce(nullif(list_position(['US', 'EP', 'WO', 'GB', 'CA', 'AU', 'KR', 'CN', 'JP'], country), 0), 10), -CAST(publication_date AS BIGINT), idx) AS rank FROM p) """


@query(duck("pub_strings") + ", " + parsed_sql("pub_strings") + f"""SELECT idx, pub, country, number, kind, {DOCDB} AS docdb, country || number || kind AS epodoc,
    CASE WHEN country = 'US' AND regexp_full_match(number, '(19|20)[0-9]{{8}}') THEN country || number[1:4] || '0' || number[5:] || kind ELSE country || number || kind END AS google FROM p""")
def pubnum_normalize(spark, sf_dir):
    return pubnum.normalize(view(spark, sf_dir, "pub_strings").select("idx", "pub"), "pub").drop("alternate")


@query(duck("pub_strings") + ", " + parsed_sql("pub_strings") + """SELECT idx, CASE WHEN country = 'US' AND regexp_full_match(number, '(19|20)[0-9]{8}') THEN 'US.' || number[1:4] || '0' || number[5:] WHEN country = 'US' AND regexp_full_match(number, '(19|20)[0-9][0-9]0[0-9]{6}')
    THEN 'US.' || number[1:4] || number[6:] END || CASE WHEN kind <> '' THEN '.' || kind ELSE '' END AS alternate FROM p""")
def pubnum_alternate(spark, sf_dir):
    return view(spark, sf_dir, "pub_strings").select("idx", pubnum.alternate_docdb(pubnum.parse(F.col("pub"))).alias("alternate"))


@query(duck("pub_strings") + ", " + parsed_sql("pub_strings") + "SELECT idx, pub FROM p WHERE number IS NULL")
def pubnum_unparseable(spark, sf_dir):
    return view(spark, sf_dir, "pub_strings").select("idx", "pub").where(pubnum.parse(F.col("pub")).isNull())


@query(KEYED_HITS + "SELECT family_key, min(idx) AS first_idx, count(*) AS n_members FROM r GROUP BY family_key")
def family_dedup(spark, sf_dir):
    return hits.dedup_families(view(spark, sf_dir, "hits")).select("family_key", "first_idx", F.size("members").cast("long").alias("n_members"))


@query(KEYED_HITS + "SELECT family_key, idx, pub, abstract, publication_date, query_id FROM r WHERE rank = 1")
def family_representative(spark, sf_dir):
    return hits.representatives(view(spark, sf_dir, "hits"))


@query(KEYED_HITS + "SELECT family_key, string_agg(pub, '|' ORDER BY idx) AS members FROM r GROUP BY family_key")
def family_members_ordered(spark, sf_dir):
    return hits.dedup_families(view(spark, sf_dir, "hits")).select("family_key", F.array_join("members", "|").alias("members"))


@query(KEYED_HITS + ", q AS (SELECT family_key, query_id, min(idx) AS i FROM r GROUP BY ALL) SELECT family_key, string_agg(query_id, '|' ORDER BY i) AS query_ids FROM q GROUP BY family_key")
def family_query_ids(spark, sf_dir):
    return hits.dedup_families(view(spark, sf_dir, "hits")).select("family_key", F.array_join("query_ids", "|").alias("query_ids"))


@query(duck("hits", "known") + ", f AS (SELECT CASE WHEN family_id <> '' THEN family_id ELSE pub END AS family_key, arg_min(family_id, idx) AS family_id FROM hits GROUP BY 1) SELECT family_key, family_id <> '' AND family_id IN (SELECT family_id FROM known) AS known FROM f")
def family_known_split(spark, sf_dir):
    return hits.dedup_families(view(spark, sf_dir, "hits"), view(spark, sf_dir, "known")).select("family_key", "known")


@query(duck("hits", "known") + ", f AS (SELECT CASE WHEN family_id <> '' THEN family_id ELSE pub END AS family_key, arg_min(family_id, idx) AS family_id FROM hits GROUP BY 1), k AS (SELECT family_id <> '' AND family_id IN (SELECT family_id FROM known) AS known FROM f) SELECT count(*) AS n, count(*) FILTER (NOT known) AS new_count, count(*) FILTER (known) AS known_count FROM k")
def family_counts(spark, sf_dir):
    return hits.family_counts(view(spark, sf_dir, "hits"), view(spark, sf_dir, "known"))


@query(duck("hits") + "SELECT idx, pub FROM hits ORDER BY idx LIMIT 100 OFFSET 100")
def paging_window(spark, sf_dir):
    return hits.page(view(spark, sf_dir, "hits").select("idx", "pub"), 101, 200)


VERIFY = duck("verify_in", "verify_out") + ", i AS (SELECT idx, 'EP.' || pub[3:-3] || '.A1' AS key FROM verify_in), o AS (SELECT idx, CASE WHEN pub LIKE '?%' THEN pub ELSE upper(pub) END AS key FROM verify_out) "


@query(VERIFY + "SELECT key, min(idx) AS first_idx FROM i WHERE key NOT IN (SELECT key FROM o) GROUP BY key")
def verify_missing(spark, sf_dir):
    return hits.verify_missing(view(spark, sf_dir, "verify_in"), view(spark, sf_dir, "verify_out"))


@query(VERIFY + "SELECT key, min(idx) AS first_idx FROM o WHERE key NOT IN (SELECT key FROM i) GROUP BY key")
def verify_unexpected(spark, sf_dir):
    return hits.verify_unexpected(view(spark, sf_dir, "verify_in"), view(spark, sf_dir, "verify_out"))


@query(VERIFY + "SELECT key, min(idx) AS first_idx, count(*) AS n FROM o GROUP BY key HAVING count(*) > 1")
def verify_duplicates(spark, sf_dir):
    return hits.verify_duplicates(view(spark, sf_dir, "verify_out"))


@query(VERIFY + "SELECT key, 1 AS side, min(idx) AS idx FROM o WHERE key LIKE '?%' GROUP BY key")
def verify_unparseable(spark, sf_dir):
    return hits.verify_unparseable(view(spark, sf_dir, "verify_in"), view(spark, sf_dir, "verify_out"))


@query(VERIFY + """, s AS (SELECT (SELECT count(*) FROM i) AS input_count, (SELECT count(*) FROM o) AS output_count, (SELECT count(DISTINCT key) FROM i WHERE key NOT IN (SELECT key FROM o)) AS missing,
    (SELECT count(DISTINCT key) FROM o WHERE key NOT IN (SELECT key FROM i)) AS unexpected, (SELECT count(*) FROM (SELECT key FROM o GROUP BY key HAVING count(*) > 1)) AS duplicates) SELECT *, missing = 0 AND unexpected = 0 AND duplicates = 0 AS ok FROM s""")
def verify_summary(spark, sf_dir):
    return hits.verify_summary(view(spark, sf_dir, "verify_in"), view(spark, sf_dir, "verify_out"))


@query(VERIFY + """SELECT 'missing' AS problem, key, min(idx) AS first_idx, CAST(NULL AS BIGINT) AS n FROM i WHERE key NOT IN (SELECT key FROM o) GROUP BY key UNION ALL SELECT 'unexpected', key, min(idx), NULL FROM o WHERE key NOT IN (SELECT key FROM i) GROUP BY key
    UNION ALL SELECT 'duplicate', key, min(idx), count(*) FROM o GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'unparseable', key, min(idx), NULL FROM o WHERE key LIKE '?%' GROUP BY key""")
def verify_batch(spark, sf_dir):
    return hits.verify_batch(view(spark, sf_dir, "verify_in"), view(spark, sf_dir, "verify_out"))


@query("SELECT 5 AS queries, 1 AS errors, CAST(count(*) FILTER (c_mktsegment <> 'BUILDING') AS BIGINT) AS total_sum, count(*) FILTER (c_mktsegment <> 'BUILDING') > 1000 AS exceeded FROM customer")
def plan_totals(spark, sf_dir):
    totals = view(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("query")).agg(F.count(F.lit(1)).alias("total"))
    return hits.plan_check(totals.withColumn("error", F.when(F.col("query") == "BUILDING", "external_api_error")), 1000)


@query("SELECT 'item_chars' AS rule, min(doc_id) AS idx FROM documents WHERE length(text) > 4096 HAVING min(doc_id) IS NOT NULL UNION ALL SELECT 'total_chars', min(doc_id) FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id) AS s FROM documents) WHERE s > 1000000 HAVING min(doc_id) IS NOT NULL")
def batch_guard(spark, sf_dir):
    items = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("item"))
    return hits.batch_violations(items, max_items=10_000_000, max_total=1_000_000)


@query(duck("pub_strings") + ", " + parsed_sql("pub_strings") + f", k AS (SELECT idx, pub, {DOCDB} AS key FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(key, pub) ORDER BY idx) AS n FROM k), x AS (SELECT idx, pub, CASE WHEN key IS NULL THEN 'unparseable' WHEN n > 1 THEN 'repeated' END AS problem FROM r UNION ALL SELECT 25, NULL, 'too many' FROM (SELECT count(*) AS c FROM k) WHERE c > 25) SELECT * FROM x WHERE problem IS NOT NULL")
def watch_list_guard(spark, sf_dir):
    return hits.watch_list_problems(view(spark, sf_dir, "pub_strings"))


LOG = duck("request_log")
GREEN = "regexp_matches(throttling, 'yellow|red|black')"


@query(LOG + "SELECT kind, count(*) AS n FROM request_log GROUP BY kind")
def usage_by_kind(spark, sf_dir):
    return usage.by_column(view(spark, sf_dir, "request_log"), "kind")


@query(LOG + "SELECT status, count(*) AS n FROM request_log GROUP BY status")
def usage_by_status(spark, sf_dir):
    return usage.by_column(view(spark, sf_dir, "request_log"), "status")


@query(LOG + f"SELECT line_no, {GREEN} AS non_green FROM request_log")
def usage_non_green(spark, sf_dir):
    return view(spark, sf_dir, "request_log").select("line_no", records.non_green(F.col("throttling")).alias("non_green"))


@query(LOG + "SELECT regexp_extract(throttling, '^(\\w+) \\(', 1) AS state, count(*) AS n FROM request_log WHERE throttling <> 'garbage' GROUP BY 1")
def usage_system_states(spark, sf_dir):
    return usage.system_states(view(spark, sf_dir, "request_log"))


@query(LOG + f"SELECT count(*) AS total_requests, count(*) FILTER ({GREEN}) AS non_green_events, strftime(arg_min(\"at\", line_no), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(arg_max(\"at\", line_no), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) FILTER (CAST(\"at\" AS DATE) = DATE '2024-01-10') AS today_requests, count(*) FILTER (\"at\" IS NULL) AS undated_lines FROM request_log")
def usage_summary(spark, sf_dir):
    out = usage.usage_totals(view(spark, sf_dir, "request_log"), F.lit("2024-01-10").cast("date"))
    return out.withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(LOG + "SELECT kind, count(*) AS n FROM request_log WHERE CAST(\"at\" AS DATE) = DATE '2024-01-10' GROUP BY kind")
def usage_today(spark, sf_dir):
    return usage.by_column(view(spark, sf_dir, "request_log").where("to_date(at) = DATE '2024-01-10'"), "kind")


@query(LOG + "SELECT kind, count(*) AS n FROM request_log WHERE \"at\" >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY kind")
def usage_since(spark, sf_dir):
    return usage.by_column(usage.since(view(spark, sf_dir, "request_log"), F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")), "kind")


@query(LOG + """, e AS (SELECT line_no, unnest(regexp_extract_all(throttling, '\\w+=\\w+:\\d+')) AS s FROM request_log)
    SELECT line_no, split_part(s, '=', 1) AS service, split_part(split_part(s, '=', 2), ':', 1) AS colour, CAST(split_part(s, ':', 2) AS INT) AS "limit" FROM e""")
def throttling_services(spark, sf_dir):
    return usage.services(view(spark, sf_dir, "request_log"))


@query(LOG + """, x AS (SELECT line_no, status, throttling <> 'garbage' AS ok, regexp_extract(throttling, 'search=(\\w+):', 1) AS c, CAST(nullif(regexp_extract(throttling, 'search=\\w+:(\\d+)', 1), '') AS DOUBLE) AS l, throttling LIKE 'overloaded%' AS over FROM request_log)
    SELECT line_no, 'search' AS service, CASE WHEN ok AND c <> 'green' THEN 60 ELSE 0 END AS rest_seconds, CASE WHEN over AND l > 0 THEN greatest(4.0::DOUBLE, 60 / l) ELSE 4.0::DOUBLE END AS interval_seconds, CASE WHEN status = '403' OR c = 'black' THEN 900 ELSE 0 END AS blocked_seconds FROM x""")
def throttling_reaction(spark, sf_dir):
    return usage.throttle_reaction(view(spark, sf_dir, "request_log").withColumn("service", F.lit("search")).withColumn("status", F.col("status").cast("int")))


@query("SELECT p_partkey, sha256(p_name || chr(10) || '1-25')[1:16] AS key FROM part")
def search_key(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", records.search_key(F.col("p_name"), F.lit(1), F.lit(25)).alias("key"))


EVENTS = duck("legal_events") + ", k AS (SELECT *, gazette_date || '|' || code || '|' || sha256(descr || chr(31) || pre)[1:8] AS key FROM legal_events) "
HALF = "TIMESTAMP '2024-01-16 00:00:00'"


def _halves(spark, sf_dir):
    e = legal(spark, sf_dir).withColumn("gazette_date", F.lit("20240101"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    return e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")


HALVES = duck("legal_events") + f", k AS (SELECT pub, pos, ts, code, '20240101|' || code || '|' || sha256(descr || chr(31) || pre)[1:8] AS key FROM legal_events), b AS (SELECT pub, key, count(*) AS nb FROM k WHERE ts < {HALF} GROUP BY ALL), a AS (SELECT pub, key, count(*) AS na FROM k WHERE ts >= {HALF} GROUP BY ALL) "


def _joined():
    return F.array_join("key", "|").alias("key")


@query(EVENTS + "SELECT pos, key FROM k")
def event_key(spark, sf_dir):
    return snapshots.keyed(legal(spark, sf_dir)).select("pos", _joined())


@query(EVENTS + "SELECT pub, string_agg(key, ',' ORDER BY key) AS events FROM k GROUP BY pub")
def snapshot_build(spark, sf_dir):
    built = snapshots.build_snapshot(_status(legal(spark, sf_dir)), _kin(legal(spark, sf_dir)))
    return built.select("pub", F.array_join(F.transform("snapshot.legal.events", lambda k: F.array_join(k, "|")), ",").alias("events"))


def _status(events, at="now"):
    return snapshots.reported(events).withColumn("fetched_at", F.lit(at))


def _kin(events, family_id="f1", members=("m1", "m2"), at="now"):
    return events.select("pub").distinct().select("pub", F.lit(at).alias("fetched_at"), F.lit(family_id).alias("family_id"), F.array(*map(F.lit, members)).alias("members"))


@query(HALVES + f", n AS (SELECT pub, key, pos, row_number() OVER (PARTITION BY pub, key ORDER BY pos) AS nth FROM k WHERE ts >= {HALF}) SELECT n.pub, n.key, n.pos FROM n LEFT JOIN b USING (pub, key) WHERE nth > coalesce(nb, 0)")
def watch_new_events(spark, sf_dir):
    return snapshots.new_events(*_halves(spark, sf_dir)).select("pub", _joined(), "pos")


@query(HALVES + "SELECT b.pub, b.key, CAST(nb - coalesce(na, 0) AS BIGINT) AS gone FROM b LEFT JOIN a USING (pub, key) WHERE nb > coalesce(na, 0)")
def watch_missing_events(spark, sf_dir):
    return snapshots.missing_events(*_halves(spark, sf_dir)).groupBy("pub", _joined()).agg(F.count(F.lit(1)).alias("gone"))


MEMBERS = duck("family_members") + ", b AS (SELECT pub, member FROM family_members WHERE k % 5 <> 0), a AS (SELECT pub, member FROM family_members WHERE k % 7 <> 0) "


def _members(spark, sf_dir):
    m = view(spark, sf_dir, "family_members")
    return m.where("k % 5 <> 0").select("pub", "member"), m.where("k % 7 <> 0").select("pub", "member")


@query(MEMBERS + "SELECT *, 'new' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'missing' FROM (FROM b EXCEPT FROM a)")
def watch_member_diff(spark, sf_dir):
    return snapshots.member_changes(*_members(spark, sf_dir))


def _changes(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    pubs = legal(spark, sf_dir).select("pub").distinct().withColumn("n", F.regexp_extract("pub", r"EP\.([0-9]+)", 1).cast("long"))
    family = lambda shift: pubs.select("pub", ((F.col("n") + shift * (F.col("n") % 10 == 0).cast("int")) % 7).cast("string").alias("family_id"))
    none = pubs.select("pub", F.col("pub").alias("member"))
    return snapshots.changes(pubs.select("pub", (F.col("n") % 4 != 0).alias("stored")), before, after, none, none, family(0), family(1))


CHANGES = HALVES + f""", n AS (SELECT pub, key, row_number() OVER (PARTITION BY pub, key ORDER BY pos) AS nth FROM k WHERE ts >= {HALF}), ne AS (SELECT n.pub, count(*) AS c FROM n LEFT JOIN b USING (pub, key) WHERE nth > coalesce(nb, 0) GROUP BY 1),
    me AS (SELECT b.pub, sum(nb - coalesce(na, 0)) AS c FROM b LEFT JOIN a USING (pub, key) WHERE nb > coalesce(na, 0) GROUP BY 1), u AS (SELECT DISTINCT pub, CAST(regexp_extract(pub, 'EP.([0-9]+)', 1) AS BIGINT) AS n FROM legal_events),
    d AS (SELECT u.pub, n % 4 = 0 AS first_snapshot, CASE WHEN n % 4 = 0 THEN 0 ELSE coalesce(ne.c, 0) END AS new_events, CASE WHEN n % 4 = 0 THEN 0 ELSE CAST(coalesce(me.c, 0) AS BIGINT) END AS missing_events, n % 4 <> 0 AND n % 10 = 0 AS family_id_changed FROM u LEFT JOIN ne USING (pub) LEFT JOIN me USING (pub)),
    f AS (SELECT *, 0 AS new_members, 0 AS missing_members, new_events + missing_events > 0 OR family_id_changed AS changed FROM d) """


@query(CHANGES + "SELECT * FROM f")
def watch_changed(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(CHANGES + "SELECT count(*) FILTER (changed) AS changed, count(*) FILTER (first_snapshot) AS first, count(*) FILTER (NOT changed AND NOT first_snapshot) AS unchanged, 0 AS error FROM f")
def watch_envelope(spark, sf_dir):
    return snapshots.envelope(_changes(spark, sf_dir), legal(spark, sf_dir).where("pub IS NULL"))


@query(duck("legal_events") + "SELECT pos FROM legal_events WHERE gazette_date <> 'n/a' AND gazette_date >= '20240120'")
def watch_events_since(spark, sf_dir):
    return snapshots.events_since(legal(spark, sf_dir), F.lit("2024-01-20").cast("date")).select("pos")


@query(duck("legal_events") + "SELECT pub, count(*) FILTER (gazette_date = 'n/a') AS undated FROM legal_events GROUP BY pub")
def watch_undated(spark, sf_dir):
    return snapshots.undated_events(legal(spark, sf_dir))


NOW = "2024-06-01T00:00:00+00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _cache(spark, sf_dir):
    at = F.timestamp_seconds(F.unix_seconds(_now()) - F.col("doc_id") * 3600)
    return view(spark, sf_dir, "cache_meta").withColumn("fetched_at", F.when(F.col("readable"), records.canonical_time(at)).otherwise("never"))


CACHE = duck("cache_meta") + """, h AS (SELECT *, CASE kind WHEN 'biblio' THEN 2160 WHEN 'legal' THEN 168 WHEN 'family' THEN 720 WHEN 'search' THEN 24 WHEN 'searchbib' THEN 24 ELSE CASE WHEN length(key) - length(replace(key, '.', '')) = 2 THEN NULL ELSE 720 END END AS hours,
    CASE WHEN readable THEN strftime(TIMESTAMP '2024-06-01 00:00:00' - to_hours(doc_id), '%Y-%m-%dT%H:%M:%S+00:00') ELSE 'never' END AS fetched_at FROM cache_meta),
    f AS (SELECT *, readable AND (hours IS NULL OR doc_id < hours) AS fresh, CASE WHEN NOT has_body AND has_meta THEN 'missing body' WHEN NOT has_body THEN 'stray tmp file' WHEN NOT has_meta THEN 'missing sidecar' WHEN NOT meta_ok THEN 'unreadable sidecar' WHEN meta_size <> size THEN 'size mismatch' END AS problem FROM h),
    e AS (SELECT *, problem IS NOT NULL AS broken, problem IS NULL AND NOT fresh AS expired FROM f) """


@query(CACHE + "SELECT doc_id, fresh FROM f")
def cache_freshness(spark, sf_dir):
    c = _cache(spark, sf_dir)
    return c.select("doc_id", cache_views.is_fresh(F.col("kind"), F.col("key"), F.col("fetched_at"), _now()).alias("fresh"))


@query(CACHE + "SELECT doc_id, CASE WHEN hours IS NULL THEN 'never' ELSE CAST(hours // 24 AS VARCHAR) || 'd' END AS lifetime FROM h")
def cache_effective_ttl(spark, sf_dir):
    return _cache(spark, sf_dir).select("doc_id", records.spell_lifetime(cache_views.effective_hours(F.col("kind"), F.col("key"))).alias("lifetime"))


@query(CACHE + """, s AS (SELECT kind, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (expired) AS expired, count(*) FILTER (broken) AS broken, min(fetched_at) AS oldest, max(fetched_at) AS newest,
    count(*) FILTER (kind NOT IN ('search', 'searchbib') AND length(key) - length(replace(key, '.', '')) <> 2) AS no_kind_code, count(*) FILTER (kind NOT IN ('search', 'searchbib') AND length(key) - length(replace(key, '.', '')) <> 2 AND expired) AS no_kind_code_expired FROM e GROUP BY kind) SELECT * FROM s""")
def cache_stats(spark, sf_dir):
    return cache_views.stats(cache_views.entries(_cache(spark, sf_dir), _now()))


@query(CACHE + "SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (expired) AS expired, count(*) FILTER (broken) AS broken FROM e")
def cache_totals(spark, sf_dir):
    return cache_views.totals(cache_views.stats(cache_views.entries(_cache(spark, sf_dir), _now())))


@query(CACHE + "SELECT doc_id, kind FROM e WHERE kind IN ('biblio', 'legal', 'search') AND readable AND doc_id >= 48 AND (expired OR broken)")
def cache_select(spark, sf_dir):
    e = cache_views.entries(_cache(spark, sf_dir), _now())
    return cache_views.select(e, _now(), kinds=["biblio", "legal", "search"], older_hours=48, expired=True, broken=True).select("doc_id", "kind")


@query(CACHE + "SELECT problem, count(*) AS n FROM e WHERE problem IS NOT NULL GROUP BY problem")
def cache_problems(spark, sf_dir):
    return cache_views.entries(_cache(spark, sf_dir), _now()).where("broken").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(duck("claim_text") + "SELECT id, CASE WHEN id % 4 < 2 AND TRY_CAST(regexp_extract(text, 'claim ([0-9]+)', 1) AS INT) NOT IN (0, n) THEN regexp_extract(text, 'claim ([0-9]+)', 1) ELSE '' END AS refs FROM claim_text")
def claim_refs(spark, sf_dir):
    return view(spark, sf_dir, "claim_text").select("id", F.array_join(claim_functions.claim_refs(F.col("text"), F.col("n")).cast("array<string>"), ",").alias("refs"))


@query(duck("claim_text") + ", r AS (SELECT id, n, TRY_CAST(regexp_extract(text, 'claim ([0-9]+)', 1) AS INT) AS c FROM claim_text WHERE id % 4 < 2) SELECT id, n AS claim, c AS refers_to FROM r WHERE c <> n AND c > 0")
def claim_dependency_edges(spark, sf_dir):
    return view(spark, sf_dir, "claim_text").select("id", F.col("n").alias("claim"), F.explode(claim_functions.claim_refs(F.col("text"), F.col("n"))).alias("refers_to"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n FROM (SELECT *, max(CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem) WHERE m IS NULL OR CAST(l_quantity AS INT) > m")
def claim_split_marks(spark, sf_dir):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("place")
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"), place)
    return claim_functions.kept_marks(rows, "l_orderkey", "place", "n").drop("place")


LEGAL_XML = '<?xml version="1.0"?><ops:world-patent-data xmlns:ops="u"><ops:patent-family legal="true"><ops:family-member><ops:legal code="{code}" desc="{code} event"><ops:pre line="1"> line {n} </ops:pre><ops:L007EP desc="Gazette DATE">{date}</ops:L007EP></ops:legal></ops:family-member></ops:patent-family></ops:world-patent-data>'


@query(duck("legal_events") + "SELECT 'E' || CAST(pos AS VARCHAR) AS pub, CAST(0 AS BIGINT) AS pos, code, code || ' event' AS \"desc\", gazette_date, ' line ' || CAST(pos % 3 AS VARCHAR) || ' ' AS pre_line FROM legal_events")
def xml_legal_parse(spark, sf_dir):
    e = spread(legal(spark, sf_dir))
    before, _, rest = LEGAL_XML.partition("{code}")
    middle, _, tail = rest.partition("{code}")
    to_line, _, tail = tail.partition("{n}")
    to_date, _, tail = tail.partition("{date}")
    body = F.concat(F.lit(before), "code", F.lit(middle), "code", F.lit(to_line), (F.col("pos") % 3).cast("string"), F.lit(to_date), "gazette_date", F.lit(tail))
    raw = e.select(F.concat(F.lit("E"), F.col("pos").cast("string")).alias("pub"), body.alias("body"))
    return xml.legal_events(raw).where("error IS NULL").select("pub", "pos", "code", "desc", "gazette_date", F.get("pre_lines", F.lit(0)).alias("pre_line"))


def _wrap(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS requested, CAST(o_custkey AS VARCHAR) AS family_id, 'EP.' || CAST(o_orderkey AS VARCHAR) || '.A1' AS pub, o_orderpriority AS title, strftime(o_orderdate, '%Y%m%d') AS publication_date FROM orders")
def xml_biblio_parse(spark, sf_dir):
    o = spread(view(spark, sf_dir, "orders")).withColumn("d", F.date_format("o_orderdate", "yyyyMMdd"))
    body = _wrap(
        '<ops:world-patent-data xmlns:ops="u"><exchange-documents><exchange-document country="EP" doc-number="', "$o_orderkey", '" kind="A1" family-id="', "$o_custkey", '"><bibliographic-data><publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>',
        "$o_orderkey", "</doc-number><kind>A1</kind><date>", "$d", '</date></document-id></publication-reference><invention-title lang="de">x</invention-title><invention-title lang="en"> ', "$o_orderpriority", " </invention-title></bibliographic-data></exchange-document></exchange-documents></ops:world-patent-data>",
    )
    return xml.biblio(o.select(F.col("o_orderkey").cast("string").alias("pub"), body.alias("body"))).select("requested", "family_id", "pub", "title", "publication_date")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS requested, CAST(o_custkey AS VARCHAR) AS family_id, 'EP.' || CAST(o_orderkey AS VARCHAR) || '.A1' AS members FROM orders")
def xml_family_parse(spark, sf_dir):
    member = ('<ops:family-member family-id="', "$o_custkey", '"><publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>', "$o_orderkey", "</doc-number><kind>A1</kind></document-id></publication-reference></ops:family-member>")
    body = _wrap('<ops:world-patent-data xmlns:ops="u"><ops:patent-family>', *member, *member, "</ops:patent-family></ops:world-patent-data>")
    return xml.family(spread(view(spark, sf_dir, "orders")).select(F.col("o_orderkey").cast("string").alias("pub"), body.alias("body"))).select("requested", "family_id", F.array_join("members", ",").alias("members"))


@query(duck("arrivals").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT service, seq, at_us, greatest(at_us, coalesce(floor_us, 0), CASE WHEN cool_down_us <= at_us + 3600000000 THEN cool_down_us ELSE 0 END) AS ready, greatest(interval_us, coalesce(tight_us, 0)) AS step, row_number() OVER (PARTITION BY service ORDER BY seq) AS n FROM arrivals),
    r AS (SELECT service, n, seq, ready AS slot_us FROM b WHERE n = 1 UNION ALL SELECT b.service, b.n, b.seq, CASE WHEN r.slot_us <= b.at_us + 3600000000 THEN greatest(b.ready, r.slot_us + b.step) ELSE b.ready END FROM r JOIN b ON b.service = r.service AND b.n = r.n + 1) SELECT service, seq, slot_us FROM r""")
def pacing_slots(spark, sf_dir):
    return pacing.pacing_slots(view(spark, sf_dir, "arrivals")).select("service", "seq", "slot_us")
