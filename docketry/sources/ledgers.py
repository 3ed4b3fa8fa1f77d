"""Ledgers read from a project's folder: ``ledger/<target>/`` with its files, and reports by relative path."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import ledger
from docketry.sources.folders import open_system
from docketry.sources.jsonl import file_problem, is_object, parse_lines

FOLDER = "ledger"
NAMES = (ledger.MANIFEST, *ledger.FILES, ledger.TRANSLATION)


class Ledgers(NamedTuple):
    """What ``ledger.check`` takes: ``targets(target)``, ``files(target, file, problem)``, ``lines(target, file, line, v)``, ``manifests(target, v)``, ``paths(path)``."""

    targets: DataFrame
    files: DataFrame
    lines: DataFrame
    manifests: DataFrame
    paths: DataFrame


def _contents(base: str, target: str | None):
    """``target, file, content`` of the known files of each target's folder, and a row without a file for each folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, place = open_system(batch.column("base")[0].as_py())
            found = system.get_file_info(fs.FileSelector(f"{place}/{FOLDER}", allow_not_found=True))
            for folder in sorted(i.base_name for i in found if i.type == fs.FileType.Directory and target in (None, i.base_name)):
                infos = system.get_file_info([f"{place}/{FOLDER}/{folder}/{name}" for name in NAMES])
                rows = [(folder, None, None)]
                for name, info in zip(NAMES, infos, strict=True):
                    if info.type == fs.FileType.File:
                        with system.open_input_stream(info.path) as stream:
                            rows.append((folder, name, stream.read()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["target", "file", "content"])

    return run


def _there(base: str):
    """Those of ``path`` that are files below the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_system(base)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            infos = system.get_file_info([f"{place}/{p}" for p in paths])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, i in zip(paths, infos, strict=True) if i.type == fs.FileType.File], pa.string())], names=["path"])

    return run


def read_ledgers(spark: SparkSession, base: str, target: str | None = None) -> Ledgers:
    """All ledgers under ``base``, or one target's.  Every folder counts as a target, whatever it holds.

    A folder's files are read once, empty ones too, which Spark's own file source would leave out, and stay in Spark's
    cache; reports are looked up one by one, as a base may hold many other files.
    """
    held = spark.createDataFrame([(base,)], "base string").mapInArrow(_contents(base, target), "target string, file string, content binary").persist()
    problem = file_problem(F.col("content"))
    files = held.where("file IS NOT NULL").select("target", "file", problem.alias("problem"), F.col("content").cast("string").alias("text"))
    good = files.where("problem IS NULL")
    lines = parse_lines(good.where(F.col("file").isin(*ledger.FILES)), "text", "target", "file").select("target", "file", "line", "v")
    manifest = F.try_parse_json("text")
    manifests = good.where(F.col("file") == ledger.MANIFEST).select("target", F.when(is_object(manifest), manifest).alias("v"))
    n = ledger.Node(F.col("v"))
    named = lines.where((F.col("file") == "runs.jsonl") & F.col("v").isNotNull()).select(n.text("report").alias("path")).where("path <> ''").distinct()
    named = named.where(~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"))
    return Ledgers(held.where("file IS NULL").select("target"), files.select("target", "file", "problem"), lines, manifests, named.mapInArrow(_there(base), "path string"))


def ledger_check(spark: SparkSession, base: str, target: str | None = None) -> DataFrame:
    """One row for each target: ``target, ok, errors, warnings, counts``, findings in file order and line order.

    A target asked for that has no folder, or a project without any, is one row with a ``missing-ledger`` error.
    Warnings don't decide ``ok``.
    """
    read = read_ledgers(spark, base, target)
    found = ledger.check(*read)
    if read.targets.isEmpty():
        lost = spark.createDataFrame([(target or "",)], "target string")
        found, targets = ledger.missing_ledgers(lost, read.targets), lost
    else:
        targets = read.targets
    file = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ledger.FILE_ORDER)), F.col("file")), F.lit(0)), F.lit(len(ledger.FILE_ORDER) + 1))
    one = F.struct(file.alias("place"), F.coalesce("line", F.lit(-1)).alias("at"), "rule", "key", F.struct("file", "line", "rule", "key").alias("finding"))
    of = lambda severity: F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == severity, one))), lambda x: x["finding"])
    by = found.groupBy("target").agg(of("error").alias("errors"), of("warning").alias("warnings"))
    counts = read.lines.where("v IS NOT NULL").groupBy("target").agg(*[F.count_if(F.col("file") == f).alias(f.removesuffix(".jsonl")) for f in ledger.FILES])
    none = F.array().cast("array<struct<file: string, line: int, rule: string, key: string>>")
    out = targets.join(by, "target", "left").join(counts, "target", "left")
    names = [f.removesuffix(".jsonl") for f in ledger.FILES]
    return out.select("target", (F.size(F.coalesce("errors", none)) == 0).alias("ok"), F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"), F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in names]).alias("counts"))
