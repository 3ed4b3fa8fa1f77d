"""Registered queries of sources, guards, stored documents and fallbacks, over bodies made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import claims as claim_functions
from docketry.functions import pubnum, records
from docketry.operators import cache_views, hits, snapshots, usage
from docketry.plans.catalog import CACHE, EVENTS, HALVES, LOG, _cache, _halves, _kin, _now, _status, _wrap, query
from docketry.plans.proxies import duck, legal, view
from docketry.sources import html, jsonl, xml
from docketry.sources.spread import spread

PAGE = """<html><head><title>x</title></head><body><table><tr itemprop="backwardReferences"><td><span itemprop="publicationNumber"> US$oA </span><span itemprop="title">other</span><span itemprop="priorityDate">no</span></td></tr>
<tr itemprop="backwardReferences"><td>a book</td></tr><tr itemprop="similarDocuments"><td><span itemprop="publicationNumber">EP$oB1</span></td></tr></table><dl><dd itemprop="publicationNumber">EP$kA1</dd></dl>
<span itemprop="title"> $n </span><span itemprop="status">Active</span><time itemprop="expiration">2040-01-$d</time><time itemprop="priorityDate">2020-02-$d</time><dd itemprop="assigneeCurrent"> $b </dd><dd itemprop="assigneeOriginal">Old</dd>
<section itemprop="abstract"><div>A  $n
thing</div></section><span itemprop="Code">G06F17/$d</span><span itemprop="Code">G06F</span><span itemprop="Code">G06F17/$d</span>
<section itemprop="claims"><div class="claim" num="00001"><div>1. A $n.</div></div><div class="claim-dependent"><div class="claim" num="00002">2. As in <claim-ref idref="CLM-00001">claim 1</claim-ref>.</div></div><div class="claim" num="00003">3. As in claims 1 to 2.</div></section></body></html>"""


def _filled(template: str, **columns):
    """The template with $x replaced by columns, as one concatenation."""
    parts, rest = [], template
    while rest:
        at = rest.find("$")
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), columns[rest[at + 1]].cast("string")]
        rest = rest[at + 2 :]
    return F.concat(*parts)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS requested, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'EP' || p_partkey || 'A1' END AS pub_number, CASE WHEN p_partkey % 13 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'EP.' || p_partkey || '.A1' END AS docdb, p_name AS title,
    'A ' || p_name || ' thing' AS abstract, 'Active' AS status_display, '2040-01-' || (10 + p_size % 18) AS expiration, '2020-02-' || (10 + p_size % 18) AS priority_date, '' AS publication_date, p_brand AS assignee, 'G06F17/' || (10 + p_size % 18) AS cpc_codes,
    'US' || (p_partkey + 7) || 'A' AS backward_refs, 'EP' || (p_partkey + 7) || 'B1' AS similar, 'claim 1' AS claim_2, '|1|1,2' AS depends_on, CASE WHEN p_partkey % 13 = 0 THEN 'no publication number' END AS error FROM part""")
def patent_pages(spark, sf_dir):
    p = spread(view(spark, sf_dir, "part"))
    body = _filled(PAGE, o=F.col("p_partkey") + 7, k=F.col("p_partkey"), n=F.col("p_name"), d=F.col("p_size") % 18 + 10, b=F.col("p_brand"))
    body = F.when(F.col("p_partkey") % 13 == 0, F.replace(body, F.lit("<dd itemprop=\"publicationNumber\">"), F.lit("<dd>"))).otherwise(body)
    out = html.patent_pages(p.select(F.col("p_partkey").cast("string").alias("pub"), body.alias("body")))
    return out.select(
        "requested", "pub_number", "docdb", "title", "abstract", "status_display", "expiration", "priority_date", "publication_date", "assignee", F.array_join("cpc_codes", ",").alias("cpc_codes"), F.array_join("backward_refs", ",").alias("backward_refs"),
        F.array_join("similar", ",").alias("similar"), F.regexp_extract(F.col("claims")[1]["text"], "claim 1", 0).alias("claim_2"), F.array_join(F.transform("claims", lambda c: F.array_join(c["depends_on"].cast("array<string>"), ",")), "|").alias("depends_on"), "error",
    )


_REF = ('<ops:publication-reference family-id="', "$c_nationkey", '" system="x"><document-id document-id-type="docdb"><country>EP</country><doc-number>', "$c_custkey", "</doc-number><kind>A1</kind></document-id></ops:publication-reference>")


def _searches(spark, sf_dir):
    c = spread(view(spark, sf_dir, "customer"))
    head = _wrap('<?xml version="1.0"?><ops:world-patent-data xmlns:ops="u"><ops:biblio-search total-result-count="', "$c_custkey", '"><ops:query syntax="CQL"> ta=', "$c_mktsegment", ' &amp; x </ops:query><ops:range begin="1" end="2"/><ops:search-result>')
    found = F.concat(head, _wrap(*_REF), _wrap(*_REF), F.lit("</ops:search-result></ops:biblio-search></ops:world-patent-data>"))
    fault = F.lit('<fault xmlns="u"><code>SERVER.EntityNotFound</code><message>none</message></fault>')
    k = F.col("c_custkey")
    return c.select(k.cast("string").alias("query"), F.when(k % 10 == 0, fault).when(k % 10 == 1, F.replace(fault, F.lit("EntityNotFound"), F.lit("Other"))).when(k % 10 == 2, "<broken").otherwise(found).alias("body"))


SEARCHED = "SELECT CAST(c_custkey AS VARCHAR) AS query, c_custkey % 10 AS m, * EXCLUDE c_custkey, c_custkey FROM customer"


@query(f"WITH s AS ({SEARCHED}) SELECT query, CASE WHEN m = 0 THEN 0 WHEN m > 2 THEN c_custkey END AS total_count, CASE WHEN m > 2 THEN 'ta=' || c_mktsegment || ' & x' ELSE '' END AS searched, CASE WHEN m > 2 THEN 1 ELSE 0 END AS begin, CASE WHEN m > 2 THEN 2 ELSE 0 END AS \"end\", CASE WHEN m > 2 THEN 2 ELSE 0 END AS n_hits, CASE WHEN m IN (1, 2) THEN 'upstream_data' END AS error FROM s")
def xml_search_page(spark, sf_dir):
    return xml.search_page(_searches(spark, sf_dir)).withColumn("n_hits", F.size("hits")).drop("hits")


@query(f"WITH s AS ({SEARCHED}) SELECT query, p.pos, 'EP.' || query || '.A1' AS pub, CAST(c_nationkey AS VARCHAR) AS family_id FROM s, (VALUES (0), (1)) p(pos) WHERE m > 2")
def xml_search_hits(spark, sf_dir):
    return xml.search_hits(_searches(spark, sf_dir))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS query, s_suppkey AS total_count, 2 AS docs, 'EP.' || s_suppkey || '.A1' AS pub, s_name AS title, CAST(p.pos AS INT) AS pos FROM supplier, (VALUES (0), (1)) p(pos)")
def xml_search_biblio(spark, sf_dir):
    doc = ('<exchange-documents><exchange-document country="EP" doc-number="', "$s_suppkey", '" kind="A1" family-id="7"><bibliographic-data><invention-title lang="en">', "$s_name", "</invention-title></bibliographic-data></exchange-document></exchange-documents>")
    body = _wrap('<ops:world-patent-data xmlns:ops="u"><ops:biblio-search total-result-count="', "$s_suppkey", '"><ops:range begin="1" end="2"/><ops:search-result>', *doc, *doc, "</ops:search-result></ops:biblio-search></ops:world-patent-data>")
    raw = spread(view(spark, sf_dir, "supplier")).select(F.col("s_suppkey").cast("string").alias("query"), body.alias("body"))
    page = xml.search_biblio_page(raw).select("query", "total_count", "docs")
    return page.join(xml.search_biblio(raw).select(F.col("requested").alias("query"), "pub", "title", "pos"), "query")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pub, n AS number, CASE n WHEN 1 THEN '1. A ' || p_name || '.' WHEN 2 THEN '2. The thing of claim 1.' WHEN 3 THEN '3. A thing of claims 1 or 2.' END AS text, CASE n WHEN 1 THEN '' WHEN 2 THEN '1' WHEN 3 THEN '1,2' END AS depends_on, CASE WHEN n IS NULL THEN 'upstream_data' END AS error
    FROM part, (VALUES (1), (2), (3), (NULL)) v(n) WHERE (n IS NULL) = (p_partkey % 6 < 3)""")
def xml_claims(spark, sf_dir):
    body = _wrap('<w xmlns:f="u"><f:claims lang="DE"><claim><claim-text>1. Ein Ding</claim-text></claim></f:claims><f:claims lang="EN"><claim><claim-text>1. A ', "$p_name", ".2. The  thing\nof claim 1.</claim-text><claim-text>3. A thing of claims 1 or 2.</claim-text></claim></f:claims></w>")
    # of six bodies one has no section, one no numbers, and one isn't XML
    odd = F.when(F.col("p_partkey") % 6 == 0, "<w/>").when(F.col("p_partkey") % 6 == 1, "<w><claims><claim-text>A thing.</claim-text></claims></w>").when(F.col("p_partkey") % 6 == 2, "<w")
    out = xml.claims(spread(view(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("pub"), F.coalesce(odd, body).alias("body")))
    return out.select("pub", "number", "text", F.array_join(F.col("depends_on").cast("array<string>"), ",").alias("depends_on"), "error")


@query("""WITH s AS (SELECT *, s_suppkey % 5 AS k, ' ' || s_name || '  x ' AS t FROM supplier) SELECT CAST(s_suppkey AS VARCHAR) AS requested, CASE WHEN k <> 4 THEN 'EP.' || s_suppkey || CASE WHEN k = 1 THEN '' ELSE '.A1' END END AS pub, CAST(s_nationkey AS VARCHAR) AS family_id,
    CASE WHEN k = 4 THEN '' ELSE trim(t) END AS title, CASE WHEN k = 4 THEN '' ELSE s_name || ' works. Well.' END AS abstract, CASE k WHEN 4 THEN '' WHEN 2 THEN 'ACME [US]' ELSE 'Acme Inc.|Second' END AS applicants, CASE WHEN k = 4 THEN '' ELSE 'Ann' END AS inventors,
    CASE WHEN k = 4 THEN '' ELSE 'G06F 17/00' END AS ipc, CASE WHEN k = 4 THEN '' ELSE 'G06F17/10|H01L1/' || s_suppkey END AS cpc, CASE k WHEN 4 THEN '' WHEN 3 THEN '' ELSE '20240101' END AS publication_date, CASE WHEN k = 4 THEN '' ELSE 'US.7.A' END AS cited_patents, CAST(CASE WHEN k = 4 THEN 0 ELSE 2 END AS INT) AS npl_citation_count,
    CASE WHEN k = 4 THEN 'upstream_data' END AS error FROM s""")
def xml_biblio_fields(spark, sf_dir):
    s = spread(view(spark, sf_dir, "supplier")).withColumn("k", F.col("s_suppkey") % 5)
    # the reference names another publication than the document; one of five has no kind, one no original applicant, one no date, one no data
    s = s.withColumn("kind", F.when(F.col("k") != 1, F.lit('kind="A1"')).otherwise("")).withColumn("date", F.when(F.col("k") != 3, F.lit("<date> 20240101 </date>")).otherwise("")).withColumn("form", F.when(F.col("k") != 2, "original").otherwise("docdb"))
    cpc = lambda scheme, section, group, sub: f'<patent-classification><classification-scheme scheme="{scheme}"/>{section}<main-group>{group}</main-group><subgroup>{sub}</subgroup></patent-classification>'
    g, h = "<section>G</section><class> 06</class><subclass>F </subclass>", "<section>H</section><class>01</class><subclass>L</subclass>"
    head = ('<w xmlns:ops="u"><exchange-documents><exchange-document country="EP" doc-number="', "$s_suppkey", '" ', "$kind", ' family-id="', "$s_nationkey", '">')
    data = (
        '<bibliographic-data><publication-reference><document-id document-id-type="docdb"><country>WO</country><doc-number>9</doc-number><kind>A2</kind>', "$date", '</document-id></publication-reference><invention-title lang="de">y</invention-title><invention-title lang="EN"> ', "$s_name", "  x </invention-title>",
        "<classifications-ipcr><classification-ipcr><text> G06F   17/00 </text></classification-ipcr><classification-ipcr><text> </text></classification-ipcr></classifications-ipcr><patent-classifications>", cpc("cpci", g, "17", "10"), cpc("CPCA", g, " 17", "10"), cpc("UC", g, "1", "1"), cpc("CPCI", "<section>G</section>", "1", "1"),
        '<patent-classification><classification-scheme scheme="CPCI"/>' + h + "<main-group>1</main-group><subgroup>", "$s_suppkey", "</subgroup></patent-classification></patent-classifications>",
        '<parties><applicants><applicant data-format="epodoc"><applicant-name><name>ACME [US]</name></applicant-name></applicant><applicant data-format="', "$form", '"><applicant-name><name>', "$who", '</name></applicant-name></applicant><applicant data-format="', "$form", '"><applicant-name><name>', "$second",
        "</name></applicant-name></applicant></applicants><inventors><inventor><inventor-name><name>Ann</name></inventor-name></inventor><inventor><inventor-name><name> Ann,</name></inventor-name></inventor></inventors></parties>",
        '<references-cited><citation><patcit><document-id document-id-type="docdb"><country>US</country><doc-number>7</doc-number><kind>A</kind></document-id></patcit></citation><citation><patcit><document-id document-id-type="epodoc"><doc-number>US8</doc-number></document-id></patcit></citation><citation><nplcit><text>x</text></nplcit></citation><citation><nplcit><text>y</text></nplcit></citation></references-cited></bibliographic-data>',
    )
    tail = ('<abstract lang="de"><p>z</p></abstract><abstract lang="en"><p>', "$s_name", "  works.</p><p>Well.</p></abstract></exchange-document></exchange-documents></w>")
    s = s.withColumn("who", F.when(F.col("k") == 2, "ACME [US]").otherwise("Acme Inc., ")).withColumn("second", F.when(F.col("k") == 2, "ACME [US],").otherwise("Second"))
    body = F.concat(_wrap(*head), F.when(F.col("k") != 4, _wrap(*data)).otherwise(""), _wrap(*tail))
    out = xml.biblio(s.select(F.col("s_suppkey").cast("string").alias("requested"), body.alias("body")), "requested")
    joined = lambda c: F.array_join(c, "|").alias(c)
    blank = F.when(F.col("error").isNull(), F.col("abstract")).otherwise("")
    return out.select("requested", "pub", "family_id", "title", blank.alias("abstract"), joined("applicants"), joined("inventors"), joined("ipc"), joined("cpc"), "publication_date", joined("cited_patents"), "npl_citation_count", "error")


@query("SELECT o_orderkey AS id, CAST(v.line AS INT) AS line, CASE WHEN v.line IN (3, 4) THEN 'json' END AS problem, CASE v.line WHEN 1 THEN o_orderpriority WHEN 5 THEN 'x' END AS value FROM orders, (VALUES (1), (3), (4), (5)) v(line)")
def json_lines(spark, sf_dir):
    text = _filled('{"p": "$p"}\r\n \n[1]\nnope\n{"p": "x"}\n', p=F.col("o_orderpriority"))
    rows = jsonl.parse_lines(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t")), "t", "id")
    return rows.select("id", "line", "problem", F.try_variant_get("v", "$.p", "string").alias("value"))


def _log_lines(spark, sf_dir):
    log = view(spark, sf_dir, "request_log").withColumn("at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    text = F.when(F.col("line_no") % 17 == 0, "[broken").when(F.col("line_no") % 19 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct(F.when(F.col("line_no") % 23 == 0, "soon").otherwise(F.col("at")).alias("at"), "kind", F.col("status").cast("int").alias("status"), "throttling")))
    return jsonl.typed_log(log.select("line_no", F.try_parse_json(text).alias("v")))


@query(LOG + """, l AS (SELECT *, line_no % 17 = 0 OR line_no % 19 = 0 AS skipped, line_no % 23 = 0 AS undated FROM request_log), c AS (SELECT * FROM l WHERE NOT skipped AND NOT undated AND "at" >= TIMESTAMP '2024-01-05 00:00:00')
    SELECT count(*) AS total_requests, count(*) FILTER (regexp_matches(throttling, 'yellow|red|black')) AS non_green_events, strftime(arg_min("at", line_no), '%Y-%m-%dT%H:%M:%S+00:00') AS first_at, strftime(arg_max("at", line_no), '%Y-%m-%dT%H:%M:%S+00:00') AS last_at,
    count(*) FILTER (CAST("at" AS DATE) = DATE '2024-01-10') AS today_requests, (SELECT count(*) FROM l WHERE skipped) AS skipped_lines, (SELECT count(*) FROM l WHERE undated AND NOT skipped) AS undated_lines,
    (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM c GROUP BY kind)) AS by_kind, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM c GROUP BY status)) AS by_status,
    (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT regexp_extract(throttling, '^(\\w+) \\(', 1) AS s, count(*) AS n FROM c WHERE throttling <> 'garbage' GROUP BY 1)) AS system_states FROM c""")
def usage_report(spark, sf_dir):
    out = usage.usage_report(_log_lines(spark, sf_dir), F.lit("2024-01-10").cast("date"), F.lit("2024-01-05T00:00:00+00:00").cast("timestamp"))
    flat = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return out.select("total_requests", "non_green_events", "first_at", "last_at", "today_requests", "skipped_lines", "undated_lines", flat("by_kind"), flat("by_status"), flat("system_states"))


@query(duck("pub_strings") + "SELECT idx, CASE WHEN idx % 17 = 0 THEN 'unparseable' END AS problem FROM pub_strings WHERE idx % 17 = 0")
def pub_guard(spark, sf_dir):
    return view(spark, sf_dir, "pub_strings").select("idx", hits.pub_problem(F.col("pub")).alias("problem")).where("problem IS NOT NULL")


@query("SELECT doc_id AS idx, CASE doc_id % 5 WHEN 1 THEN CASE WHEN length(text) > 4096 THEN 'too long' END WHEN 2 THEN 'no pub' WHEN 3 THEN 'pub is no text' WHEN 4 THEN 'not a text or object' END AS problem FROM documents WHERE doc_id % 5 > 1 OR (doc_id % 5 = 1 AND length(text) > 4096)")
def item_guard(spark, sf_dir):
    k = F.col("doc_id") % 5
    d = view(spark, sf_dir, "documents")
    text = F.when(k == 1, F.to_json(F.struct(F.array("text").alias("t")))).when(k == 2, '{"x": 1}').when(k == 3, '{"pub": 5}').when(k == 4, "[1]").otherwise('{"pub": "EP1A1"}')
    v = F.when(k == 1, F.try_variant_get(F.parse_json(text), "$.t[0]", "variant")).otherwise(F.parse_json(text))
    return hits.item_problems(d.select(F.col("doc_id").alias("idx"), v.alias("v")))


@query("SELECT p_partkey AS idx, CASE p_partkey % 4 WHEN 1 THEN 'blank' WHEN 2 THEN 'too long' ELSE 'control character' END AS problem FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT NULL, 'too many' FROM (SELECT count(*) AS n FROM part) WHERE n > 50")
def query_guard(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 1, "  \t").when(k == 2, F.repeat(F.lit("x"), 4001)).when(k == 3, "ta=a\x07b").otherwise(F.col("p_name"))
    return hits.query_list_problems(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), text.alias("query")))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'blank' WHEN 2 THEN 'no date or time' WHEN 3 THEN 'control character' END AS problem FROM events")
def since_guard(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 1, " ").when(k == 2, "2024-13-01").when(k == 3, "2024-01-01\n").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return view(spark, sf_dir, "events").select("event_id", records.since_problem(text).alias("problem"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 60.0::DOUBLE WHEN 1 THEN CAST(1 + event_id % 300 AS DOUBLE) WHEN 2 THEN 60.0::DOUBLE WHEN 3 THEN 60.0::DOUBLE ELSE 0.5::DOUBLE END AS seconds FROM events")
def retry_after(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "Wed, 21 Oct 2015 07:28:00 GMT").when(k == 1, F.concat(F.lit(" "), (F.col("event_id") % 300 + 1).cast("string"))).when(k == 2, "301").when(k == 3, "-4").otherwise("0.5")
    return view(spark, sf_dir, "events").select("event_id", records.retry_seconds(text).alias("seconds"))


@query("SELECT o_orderkey, '(ta=' || o_orderpriority || ') and pd within \"' || strftime(o_orderdate - INTERVAL 90 DAY, '%Y%m%d') || ' 20240601\"' AS cql, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS spelled FROM orders")
def windowed_query(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    cql = records.windowed_query(F.concat(F.lit("ta="), "o_orderpriority"), F.to_date("o_orderdate"), F.lit("2024-06-01").cast("date"))
    return view(spark, sf_dir, "orders").select("o_orderkey", cql.alias("cql"), records.spell_epoch(F.unix_micros(at) / 1_000_000).alias("spelled"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'an object' WHEN 1 THEN 'an array' WHEN 2 THEN 'null' WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE CAST(to_json(CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END) AS VARCHAR) END AS shown, CASE WHEN doc_id % 3 = 0 THEN 'EP.' || doc_id || '.A1' END AS final_name, doc_id % 4 <> 0 AS valid FROM documents")
def shown_and_names(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("EP."), k, F.lit(".A1.tmp"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("EP."), k, F.lit(".A1.123.0af9.tmp"))).otherwise(k)
    value = F.element_at(F.array(F.lit('{"a": 1}'), F.lit("[1]"), F.lit("null"), k, records.quoted(F.col("text"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "documents").select("doc_id", records.shown(F.parse_json(value)).alias("shown"), records.tmp_target(name).alias("final_name"), records.valid_key(F.when(F.col("doc_id") % 4 == 0, F.concat(k, F.lit("/x"))).otherwise(k)).alias("valid"))


@query(CACHE + "SELECT doc_id FROM f WHERE kind NOT IN ('search', 'searchbib') OR fresh")
def cache_evict(spark, sf_dir):
    return cache_views.evict(_cache(spark, sf_dir), _now()).select("doc_id")


@query(CACHE + ", l AS (SELECT kind, doc_id // 50 AS grp, max(doc_id) AS seq FROM h GROUP BY ALL) SELECT kind, CAST(grp AS VARCHAR) AS key, CAST(seq AS VARCHAR) AS body FROM l")
def cache_latest(spark, sf_dir):
    rows = _cache(spark, sf_dir).select("kind", F.floor(F.col("doc_id") / 50).cast("string").alias("key"), "fetched_at", F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("body"))
    return cache_views.latest(rows).select("kind", "key", "body")


@query(CACHE + "SELECT kind, key, CASE WHEN has_body THEN size ELSE 0 END AS size, has_body, has_meta, has_meta AND meta_ok AS meta_ok FROM h WHERE has_body OR has_meta OR doc_id % 2 = 0")
def cache_listings(spark, sf_dir):
    c = _cache(spark, sf_dir)
    return cache_views.join_listings(c.where("has_body").select("kind", "key", "size"), c.where("has_meta").select("kind", "key", "fetched_at", "meta_size", "meta_ok"), c.where("doc_id % 2 = 0").select("kind", "key")).select("kind", "key", "size", "has_body", "has_meta", "meta_ok")


@query("""WITH s AS (SELECT o_orderkey AS k, 'US.' || (2000 + o_orderkey % 20) || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '.A1' AS d10, 'US.' || (2000 + o_orderkey % 20) || '0' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '.A1' AS d11 FROM orders)
    SELECT d10 AS docdb, CASE WHEN k % 3 < 2 THEN CAST(k AS VARCHAR) END AS body, CASE k % 3 WHEN 0 THEN d10 WHEN 1 THEN d11 END AS found_as FROM s""")
def cache_lookup(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("US."), (F.col("o_orderkey") % 20 + 2000).cast("string"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit(".A1")).alias("docdb"))
    pubs = o.withColumn("alternate", pubnum.alternate_docdb(pubnum.parse(F.col("docdb"))))
    # the number holds six digits of the key: every million of keys is a store of its own
    pubs = pubs.withColumn("store", F.floor(F.col("k") / 1_000_000))
    stored = pubs.where("k % 3 < 2").select("store", F.when(F.col("k") % 3 == 0, F.col("docdb")).otherwise(F.col("alternate")).alias("key"), F.col("k").cast("string").alias("body"))
    return cache_views.lookup(pubs.select("store", "docdb", "alternate"), stored, ("store",)).select("docdb", "body", "found_as")


@query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'GB' ELSE 'EP' END AS c FROM orders) SELECT c || '.' || k || '.A' AS pub, CASE WHEN k % 2 = 0 THEN 'a' WHEN c = 'GB' AND k % 5 <> 0 THEN 'b' ELSE '' END AS events, c = 'GB' AND k % 2 = 1 AND k % 5 <> 0 AS from_b FROM s""")
def legal_fallback(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "GB.").otherwise("EP."), F.col("o_orderkey").cast("string")).alias("n"))
    none = F.array().cast("array<string>")
    a = o.select(F.concat("n", F.lit(".A")).alias("pub"), F.when(F.col("k") % 2 == 0, F.array(F.lit("a"))).otherwise(none).alias("events"))
    b = o.where("k % 5 <> 0").select(F.concat("n", F.lit(".B")).alias("pub"), F.array(F.lit("b")).alias("events"))
    out = cache_views.legal_with_fallback(a.unionByName(b), a.select("pub"))
    return out.select("pub", F.array_join("events", ",").alias("events"), "from_b")


@query("SELECT o_orderkey AS pub, CASE WHEN o_orderkey % 3 = 0 THEN 'page' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'full text' ELSE 'unavailable' END AS source FROM orders")
def claims_fallback(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pub"), F.when(F.col("o_orderkey") % 2 == 0, "WO").otherwise("US").alias("country"))
    some = F.array(F.lit("c")).alias("claims")
    return cache_views.claims_with_fallback(o, o.where("pub % 3 = 0").select("pub", some), o.where("pub % 3 = 1").select("pub", some)).select("pub", "source")


@query("SELECT p_partkey AS id, 1 AS number, '1. A ' || p_name || ', fast.' AS text FROM part UNION ALL SELECT p_partkey, 2, '2. As in claim 1, see 1. that.' FROM part UNION ALL SELECT p_partkey, 4, '4. Last.' FROM part")
def claim_split(spark, sf_dir):
    text = _filled("1. A $n, fast.2. As in claim 1, see\n1. that.\n4. Last. ", n=F.col("p_name"))
    return claim_functions.split_claims(view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("t")), "id", "t").select("id", "number", "text")


@query(HALVES + """, n AS (SELECT pub, key, row_number() OVER (PARTITION BY pub, key ORDER BY pos) AS nth FROM k WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'), ne AS (SELECT n.pub, count(*) AS c FROM n LEFT JOIN b USING (pub, key) WHERE nth > coalesce(nb, 0) GROUP BY 1),
    me AS (SELECT b.pub, sum(nb - coalesce(na, 0)) AS c FROM b LEFT JOIN a USING (pub, key) WHERE nb > coalesce(na, 0) GROUP BY 1) SELECT a.pub, max(sb.pub) IS NULL AS first_snapshot, CASE WHEN max(sb.pub) IS NULL THEN 0 ELSE coalesce(max(ne.c), 0) END AS new_events, CAST(coalesce(max(me.c), 0) AS BIGINT) AS missing_events,
    CASE WHEN max(sb.pub) IS NULL THEN '' ELSE 'm2' END AS new_members, CASE WHEN max(sb.pub) IS NULL THEN '' ELSE 'm0' END AS missing_members, CASE WHEN max(sb.pub) IS NOT NULL THEN 'f0' END AS moved_from FROM (SELECT DISTINCT pub FROM a) a LEFT JOIN (SELECT DISTINCT pub FROM b) sb USING (pub) LEFT JOIN ne USING (pub) LEFT JOIN me USING (pub) GROUP BY a.pub""")
def watch_report(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    out = snapshots.diff_snapshots(_status(after), _kin(after), _stored(before))
    size = lambda c: F.size(f"legal.{c}").cast("long").alias(c)
    joined = lambda c: F.array_join(f"family.{c}", ",").alias(c)
    return out.select("pub", "first_snapshot", size("new_events"), size("missing_events"), joined("new_members"), joined("missing_members"), F.col("family.family_id_changed.from").alias("moved_from"))


def _stored(before):
    """Snapshots of ``before`` as a ledger gives them back: JSON text, parsed."""
    built = snapshots.build_snapshot(_status(before, "then"), _kin(before, "f0", ("m0", "m1"), "then"))
    return built.select(F.col("pub").alias("idx"), F.parse_json(F.to_json("snapshot")).alias("v"))


@query(EVENTS + "SELECT pub, count(*) AS event_count, true AS unchanged, true AS same FROM k GROUP BY pub")
def snapshot_round_trip(spark, sf_dir):
    status, kin = _status(legal(spark, sf_dir)), _kin(legal(spark, sf_dir))
    # every publication's events come back in another order, as an office may report them
    turned = status.withColumn("events", F.reverse("events"))
    stored = snapshots.build_snapshot(status, kin).select(F.col("pub").alias("idx"), F.parse_json(F.to_json("snapshot")).alias("v"))
    out = snapshots.diff_snapshots(turned, kin, stored).join(stored.select(F.col("idx").alias("pub"), "v"), "pub")
    same = F.to_json("snapshot") == F.to_json(F.from_json(F.to_json("v"), out.schema["snapshot"].dataType))
    return out.select("pub", F.col("snapshot.legal.event_count").cast("long").alias("event_count"), (~F.col("changed") & ~F.col("first_snapshot")).alias("unchanged"), same.alias("same"))


@query(HALVES + """, n AS (SELECT pub, key, pos, row_number() OVER (PARTITION BY pub, key ORDER BY pos) AS nth FROM k WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')
    SELECT n.pub, string_agg(CAST(n.pos AS VARCHAR), ',' ORDER BY n.pos) AS new_pos FROM n LEFT JOIN b USING (pub, key) WHERE nth > coalesce(nb, 0) AND n.pub IN (SELECT pub FROM b) GROUP BY n.pub""")
def watch_new_in_order(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    # an event's text is no longer than its place, so the place rides in a field that isn't part of its key
    status = after.groupBy("pub").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "desc", "gazette_date", "pre_lines"))).alias("events")).withColumn("fetched_at", F.lit("now"))
    out = snapshots.diff_snapshots(status, _kin(after), _stored(before)).where("size(legal.new_events) > 0")
    return out.select("pub", F.array_join(F.transform("legal.new_events", lambda e: e["pos"].cast("string")), ",").alias("new_pos"))


@query("""SELECT o_orderkey AS idx, CASE WHEN k IN (0, 1, 2, 3) THEN NULL ELSE 'EP.' || (o_orderkey - o_orderkey % 2) || '.A1' END AS key,
    CASE k WHEN 0 THEN 'no object' WHEN 1 THEN 'pub missing' WHEN 2 THEN 'pub is no text' WHEN 3 THEN 'pub unparseable' WHEN 4 THEN 'format' WHEN 5 THEN 'legal' WHEN 6 THEN 'family' ELSE CASE WHEN o_orderkey % 2 = 1 AND row_number() OVER (PARTITION BY o_orderkey // 2, k > 6 ORDER BY o_orderkey) > 1 THEN 'repeated' END END AS problem,
    CASE WHEN k > 3 AND k <> 5 THEN 'a||1-b||2' ELSE '' END AS keys FROM (SELECT *, o_orderkey % 13 AS k FROM orders)""")
def previous_index(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 13).alias("k"))
    pub = F.concat(F.lit('"pub": "ep-'), (F.col("idx") - F.col("idx") % 2).cast("string"), F.lit(' a1"'))
    legal_part = F.lit('"legal": {"events": [["a", 5, "1"], [], "x", ["b", null, "2"]]}')
    whole = F.concat_ws(", ", F.when(F.col("k") == 1, None).when(F.col("k") == 2, F.lit('"pub": 5')).when(F.col("k") == 3, F.lit('"pub": "?"')).otherwise(pub), F.when(F.col("k") == 4, F.lit('"snapshot_format": "1"')).otherwise(F.lit('"snapshot_format": 1')), F.when(F.col("k") == 5, F.lit('"legal": []')).otherwise(legal_part), F.when(F.col("k") != 6, F.lit('"family": {}')))
    rows = o.select("idx", F.parse_json(F.when(F.col("k") == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), whole, F.lit("}")))).alias("v"))
    out = snapshots.index_previous(rows)
    return out.select("idx", "key", "problem", F.when(F.col("problem").isin("no object", "pub missing", "pub is no text", "pub unparseable"), "").otherwise(F.array_join(F.transform("keys", lambda k: F.array_join(k, "|")), "-")).alias("keys"))
