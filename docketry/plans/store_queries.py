"""Registered queries of stored documents as files and as a versioned table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import cache_views
from docketry.plans.catalog import NOW, _now, query
from docketry.plans.scratch import scratch_folder
from docketry.plans.proxies import duck, view
from docketry.sources import folders
from docketry.sources.versions import Versioned

#: One entry for each document: which of its files are there and what its sidecar says, by id.
ENTRIES = duck("cache_meta") + """, h AS (SELECT kind, key, doc_id, text, strlen(text) AS bytes, doc_id % 29 <> 0 AS body, doc_id % 31 <> 0 AS meta, doc_id % 37 = 0 AS torn, doc_id % 41 = 0 AS undated, doc_id % 23 = 0 AS off, doc_id % 43 = 0 AS unsized,
        CASE kind WHEN 'biblio' THEN 2160 WHEN 'legal' THEN 168 WHEN 'family' THEN 720 WHEN 'search' THEN 24 WHEN 'searchbib' THEN 24 ELSE CASE WHEN length(key) - length(replace(key, '.', '')) = 2 THEN NULL ELSE 720 END END AS hours FROM cache_meta JOIN documents USING (doc_id)),
    e AS (SELECT *, CASE WHEN NOT body AND meta THEN 'missing body' WHEN NOT body THEN 'stray tmp file' WHEN NOT meta THEN 'missing sidecar' WHEN torn THEN 'unreadable sidecar' WHEN off AND NOT unsized THEN 'size mismatch' END AS problem, NOT undated AND (hours IS NULL OR doc_id < hours) AS fresh FROM h) """


def _written(spark, sf_dir):
    """The documents as entries on disk, with faults in known places; the folder."""
    path = scratch_folder(spark, "store")
    # sidecars need a text's size alone: taken before the join, it spares them a shuffle of the texts
    texts = view(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("n_bytes"))
    d = view(spark, sf_dir, "cache_meta").select("kind", "key", "doc_id").join(texts, "doc_id")
    folder = F.concat(folders.kind_folder(F.col("kind")), F.lit("/"))
    body = F.concat(folder, folders.body_name(F.col("kind"), F.col("key")))
    at = F.when(F.col("doc_id") % 41 == 0, "never").otherwise(F.date_format(F.timestamp_seconds(F.unix_seconds(_now()) - F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    size = F.when(F.col("doc_id") % 43 != 0, F.col("n_bytes") + (F.col("doc_id") % 23 == 0).cast("int"))
    told = F.to_json(F.struct("kind", "key", F.col("key").alias("ident"), at.alias("fetched_at"), size.alias("size")))
    bodies = d.where("doc_id % 29 <> 0").select(body.alias("place"), F.col("text").alias("content"))
    metas = d.where("doc_id % 31 <> 0").select(F.concat(folder, "key", F.lit(folders.SIDECAR)).alias("place"), F.when(F.col("doc_id") % 37 == 0, "{").otherwise(told).alias("content"))
    # what broken writes leave, and files that are no entries
    left = d.where("doc_id % 29 = 0").select(F.concat(body, F.lit(".12.0af9.tmp")).alias("place"), F.lit("half").alias("content"))
    other = d.where("doc_id % 50 = 0").select(F.concat(folder, F.lit("note-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("place"), F.lit("x").alias("content"))
    deep = d.where("doc_id % 50 = 1").select(F.concat(F.lit("old/"), body).alias("place"), F.lit("x").alias("content"))
    folders.write_files(bodies.unionByName(metas).unionByName(left).unionByName(other).unionByName(deep), path)
    return path


@query(ENTRIES + "SELECT kind, key, CASE WHEN kind IN ('search', 'searchbib') THEN 'local' ELSE 'shared' END AS root, CAST(CASE WHEN body THEN bytes ELSE 0 END AS BIGINT) AS size, problem, problem IS NULL AND NOT fresh AS expired FROM e")
def store_inventory(spark, sf_dir):
    return folders.inventory(spark, _written(spark, sf_dir), None, _now()).select("kind", "key", "root", "size", "problem", "expired")


@query(ENTRIES + "SELECT kind, count(*) FILTER (meta) AS n FROM e GROUP BY kind")
def store_quick_counts(spark, sf_dir):
    return folders.quick_counts(spark, _written(spark, sf_dir))


@query(ENTRIES + """SELECT kind, key, CASE WHEN problem IS NULL AND fresh THEN md5(text) END AS content_md5, CASE WHEN problem IS NOT NULL THEN problem WHEN undated THEN 'unreadable time' WHEN NOT fresh THEN 'expired' END AS miss FROM e
    UNION ALL SELECT 'other', 'a', NULL, 'unknown kind' UNION ALL SELECT 'gp', '..', NULL, 'invalid key' UNION ALL SELECT 'gp', 'EP.0.X', NULL, 'absent'""")
def store_reads(spark, sf_dir):
    wanted = view(spark, sf_dir, "cache_meta").select("kind", "key").unionByName(spark.createDataFrame([("other", "a"), ("gp", ".."), ("gp", "EP.0.X")], "kind string, key string"))
    out = folders.read_store(spark, _written(spark, sf_dir), None, wanted, _now())
    return out.select("kind", "key", F.md5("content").alias("content_md5"), "miss")


@query(duck("cache_meta") + """, r AS (SELECT kind, key, doc_id, doc_id % 3 AS part, text FROM cache_meta JOIN documents USING (doc_id))
    SELECT kind, key, 'v' || CASE WHEN part = 0 THEN 2 ELSE 1 END AS ident, md5(CASE WHEN part = 0 THEN 'again ' || text ELSE text END) AS body_md5 FROM r""")
def store_replaced(spark, sf_dir):
    table = Versioned(spark, scratch_folder(spark, "versions"), buckets=8)
    rows = view(spark, sf_dir, "cache_meta").select("kind", "key", "doc_id").join(view(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    made = lambda df, ident, body: df.select("kind", "key", F.lit(ident).alias("ident"), F.lit(NOW).alias("fetched_at"), body.alias("body"))
    table.replace(made(rows, "v1", F.col("text")))
    table.replace(made(rows.where("doc_id % 3 = 0"), "v2", F.concat(F.lit("again "), "text")))
    return table.read().select("kind", "key", "ident", F.md5("body").alias("body_md5"))


@query(duck("cache_meta") + """, r AS (SELECT kind, key, doc_id, CASE kind WHEN 'search' THEN 24 WHEN 'searchbib' THEN 24 END AS hours FROM cache_meta) SELECT kind, count(*) AS n FROM r WHERE hours IS NULL OR doc_id < hours GROUP BY kind""")
def store_replaced_and_evicted(spark, sf_dir):
    table = Versioned(spark, scratch_folder(spark, "versions"), buckets=8)
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(_now()) - F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    rows = view(spark, sf_dir, "cache_meta").select("kind", "key", F.col("key").alias("ident"), at.alias("fetched_at"), F.col("key").cast("binary").alias("body"))
    table.replace(rows)
    table.replace(rows, _now())
    return cache_views.latest(table.read().withColumn("seq", F.lit(1))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
