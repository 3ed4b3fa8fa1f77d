"""Stored documents as files: a body and a JSON sidecar for each kind and key, under two roots.

``<root>/ops/<kind>/<key>.xml`` and ``<root>/gp/<key>.html`` lie beside ``<key>.meta.json``.  Publication kinds belong
to the shared root, search kinds to the local one.  Listings read no bodies; sidecars alone are opened.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from docketry.functions.records import LIFETIMES, PUB_KINDS, instant, tmp_target, valid_key
from docketry.operators import cache_views
from docketry.sources.jsonl import is_object
from docketry.sources.spread import spread

# The layout and the fields that a sidecar must have.
SIDECAR = ".meta.json"
FIELDS = ("kind", "key", "ident", "fetched_at")
PAGES = "gp"
#: Files that are opened by name for one batch of rows at most, and the bytes after which a batch ends before that.
BY_NAME = 1000
BATCH_BYTES = 16 << 20


def kind_folder(kind: Column) -> Column:
    """Where a kind's files lie under its root."""
    return F.when(kind == PAGES, PAGES).otherwise(F.concat(F.lit("ops/"), kind))


def body_name(kind: Column, key: Column) -> Column:
    return F.concat(key, F.when(kind == PAGES, ".html").otherwise(".xml"))


def root_of(kind: Column) -> Column:
    """``shared`` for kinds keyed by publication, ``local`` for those keyed by search, null for no kind."""
    return F.when(kind.isin(*PUB_KINDS), "shared").when(kind.isin(*LIFETIMES), "local")


def _base(spark: SparkSession, root: str) -> str | None:
    """The root as Spark spells paths under it, None if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString() if system.exists(path) else None


def _roots(shared: str, local: str | None) -> dict[str, str]:
    return {"shared": shared, "local": shared if local is None else local}


def open_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all tasks reach, and the folder's path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", root))


def _names(spark: SparkSession, shared: str, local: str | None) -> DataFrame:
    """``kind, root, name, path, length`` of all files in the kinds' folders, empty ones too; each folder is listed in a task of its own."""
    roots = _roots(shared, local)
    base = {r: _base(spark, p) for r, p in roots.items()}
    folders = [(k, r, f"{base[r].rstrip('/')}/{PAGES if k == PAGES else 'ops/' + k}") for k in LIFETIMES for r in ("shared" if k in PUB_KINDS else "local",) if base[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, root, folder in zip(*(batch.column(c).to_pylist() for c in ("kind", "root", "path")), strict=True):
                system, place = open_system(folder)
                found = [i for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if i.type == fs.FileType.File]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(part)), pa.array([root] * len(part)), pa.array([i.base_name for i in part]), pa.array([f"{folder}/{i.base_name}" for i in part]), pa.array([i.size for i in part], pa.int64())],
                        names=["kind", "root", "name", "path", "length"],
                    )

    rows = spark.createDataFrame(folders, "kind string, root string, path string")
    return rows.repartition(max(1, len(folders)), "kind").mapInArrow(run, "kind string, root string, name string, path string, length long")


def _opened(rows: DataFrame, place: str) -> DataFrame:
    """``rows`` with ``content``: the file that the column ``place`` names, null where it names none or none is there.

    Tasks open the files themselves, so no list of them is made on the driver.
    """
    most = BY_NAME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple[fs.FileSystem, str]] = {}

        def read(path: str | None) -> bytes | None:
            if path is None:
                return None
            folder, _, name = path.rpartition("/")
            if folder not in systems:
                systems[folder] = open_system(folder)
            system, base = systems[folder]
            try:
                with system.open_input_stream(f"{base}/{name}") as file:
                    return file.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            told = lambda start, held: pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])  # noqa: B023, E731
            start, size, held = 0, 0, []
            for path in batch.column(place).to_pylist():
                held.append(read(path))
                size += len(held[-1] or b"")
                if len(held) >= most or size >= BATCH_BYTES:
                    yield told(start, held)
                    start, size, held = start + len(held), 0, []
            if held:
                yield told(start, held)

    return spread(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def listing(spark: SparkSession, shared: str, local: str | None = None) -> DataFrame:
    """``kind, key, root, has_body, has_meta, size, path``: what each kind's folder holds, one row for each key.

    Bodies, sidecars and temporary files (counted for the file they were written for) are one pass over names and
    sizes: no file is opened.  Names of another suffix are left out; a folder that isn't there has no entries.
    """
    return _entries(spark, shared, local).drop("meta_path")


def _entries(spark: SparkSession, shared: str, local: str | None) -> DataFrame:
    """``listing`` with ``meta_path``, where the sidecar lies."""
    files = _names(spark, shared, local)
    suffix = F.when(F.col("kind") == PAGES, ".html").otherwise(".xml")
    final = F.coalesce(tmp_target(F.col("name")), F.col("name"))
    key = F.when(final.endswith(SIDECAR), F.substr(final, F.lit(1), F.length(final) - len(SIDECAR))).when(F.endswith(final, suffix), F.substr(final, F.lit(1), F.length(final) - F.length(suffix)))
    rows = files.withColumn("key", key).where("key IS NOT NULL").withColumn("tmp", tmp_target(F.col("name")).isNotNull()).withColumn("meta", final.endswith(SIDECAR))
    body = ~F.col("tmp") & ~F.col("meta")
    return rows.groupBy("kind", "key", "root").agg(
        F.max(body).alias("has_body"), F.max(~F.col("tmp") & F.col("meta")).alias("has_meta"),
        F.coalesce(F.max(F.when(body, F.col("length"))), F.lit(0)).alias("size"), F.max(F.when(body, F.col("path"))).alias("path"),
        F.max(F.when(~F.col("tmp") & F.col("meta"), F.col("path"))).alias("meta_path"),
    )


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` with what their sidecar's ``content`` says in place of it: ``meta_ok, ident, fetched_at, meta_size``; one without a needed field isn't ok."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    v = F.col("v")
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    ok = F.coalesce(is_object(v) & reduce(lambda a, b: a & b, map(has, FIELDS)), F.lit(False))
    read = rows.withColumn("v", F.try_parse_json(text)).withColumn("meta_ok", ok)
    told = lambda k, t: F.when(F.col("meta_ok"), F.try_variant_get(v, f"$.{k}", t)).alias(k)
    # a size that is no number fits no body
    kind = F.schema_of_variant(F.try_variant_get(v, "$.size", "variant"))
    whole = F.coalesce(F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$.size", "bigint")), F.lit(-1))
    size = F.when(F.col("meta_ok") & has("size") & (kind != "VOID"), whole)
    return read.select(*[c for c in rows.columns if c != "content"], "meta_ok", told("ident", "string"), told("fetched_at", "string"), size.alias("meta_size"))


def sidecars(spark: SparkSession, shared: str, local: str | None = None) -> DataFrame:
    """``kind, key, meta_ok, ident, fetched_at, meta_size``: what the sidecars say."""
    files = _names(spark, shared, local).where(F.col("name").endswith(SIDECAR))
    return _told(_opened(files.select("kind", F.substr("name", F.lit(1), F.length("name") - len(SIDECAR)).alias("key"), "path"), "path").drop("path"))


def inventory(spark: SparkSession, shared: str, local: str | None, now: Column, lifetimes: dict[str, int | None] = LIFETIMES) -> DataFrame:
    """Every entry or fragment of one: ``listing`` and ``sidecars`` with ``problem, broken, expired`` (see ``cache_views.entries``)."""
    rows = _told(_opened(_entries(spark, shared, local), "meta_path").drop("meta_path"))
    return cache_views.entries(rows, now, lifetimes)


def quick_counts(spark: SparkSession, shared: str, local: str | None = None) -> DataFrame:
    """``kind, n``: sidecars of every kind, zero where there are none; names alone are read."""
    names = _names(spark, shared, local).where(F.col("name").endswith(SIDECAR)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = spark.createDataFrame([(k,) for k in LIFETIMES], "kind string")
    return kinds.join(names, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def read_store(spark: SparkSession, shared: str, local: str | None, wanted: DataFrame, now: Column, lifetimes: dict[str, int | None] = LIFETIMES) -> DataFrame:
    """``kind, key, content, ident, fetched_at, miss`` for every distinct ``wanted(kind, key)``.

    An entry is served only if kind and key are valid, its sidecar has all fields and a readable time, it is fresh, and
    its body has the size the sidecar says (older sidecars say none).  Otherwise ``miss`` says why and there is no
    content.  Only bodies that pass all other checks are opened.
    """
    asked = wanted.select("kind", "key").distinct()
    bad = F.when(~F.coalesce(F.col("kind").isin(*LIFETIMES), F.lit(False)), "unknown kind").when(~F.coalesce(valid_key(F.col("key")), F.lit(False)), "invalid key")
    held = inventory(spark, shared, local, now, lifetimes).select("kind", "key", "path", "size", "ident", "fetched_at", "problem", "expired")
    why = F.coalesce(bad, F.when(F.col("path").isNull() & F.col("problem").isNull(), "absent"), F.col("problem"), F.when(instant(F.col("fetched_at")).isNull(), "unreadable time"), F.when(F.col("expired"), "expired"))
    # a listing begins with a few folders' rows, by which Spark would take it for small and broadcast it by way of the driver
    rows = asked.join(held.hint("merge"), ["kind", "key"], "left").withColumn("miss", why)
    out = _opened(rows.select("kind", "key", "size", "ident", "fetched_at", "miss", F.when(F.col("miss").isNull(), F.col("path")).alias("open")), "open")
    # the body may have been replaced since it was listed
    whole = F.coalesce(F.length("content") == F.col("size"), F.lit(False))
    miss = F.coalesce("miss", F.when(~whole, "size mismatch"))
    served = lambda c: F.when(miss.isNull(), F.col(c)).alias(c)
    return out.select("kind", "key", served("content"), served("ident"), served("fetched_at"), miss.alias("miss"))


def _put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file beside its place and move it there, so that a reader sees the old one or the new one whole."""
    tmp = f"{path}.{os.getpid()}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(tmp) as out:
        out.write(content)
    system.move(tmp, path)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``files(place, content)`` under a root that all tasks reach, one file a row; how many were written.

    A task that runs again replaces its own files by the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_system(root)
        made: set[str] = set()
        for batch in batches:
            for place, content in zip(batch.column("place").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{base}/{place}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                _put(system, path, content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("place", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def store_documents(rows: DataFrame, shared: str, local: str | None = None) -> int:
    """Write ``rows(kind, key, ident, fetched_at, content)`` as entries, replacing those of the same key; how many.

    Bodies are written before sidecars, so a sidecar never tells of a body that isn't there.  An unknown kind or an
    invalid key is an error and nothing is written; of rows of one key the one fetched last stays.
    """
    bad = rows.where(~F.coalesce(F.col("kind").isin(*LIFETIMES), F.lit(False)) | ~F.coalesce(valid_key(F.col("key")), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"unknown kind or invalid key: {bad[0]['kind']!r} {bad[0]['key']!r}")
    last = rows.groupBy("kind", "key").agg(F.max_by(F.struct("ident", "fetched_at", F.col("content").cast("binary").alias("content")), F.struct("fetched_at", "content")).alias("r")).select("kind", "key", "r.*")
    written = 0
    for root, path in _roots(shared, local).items():
        own = last.where(root_of(F.col("kind")) == root)
        folder = F.concat(kind_folder(F.col("kind")), F.lit("/"))
        written += write_files(own.select(F.concat(folder, body_name(F.col("kind"), F.col("key"))).alias("place"), "content"), path)
        meta = F.to_json(F.struct("kind", "key", "ident", "fetched_at", F.length("content").alias("size")))
        write_files(own.select(F.concat(folder, "key", F.lit(SIDECAR)).alias("place"), meta.alias("content")), path)
    return written
