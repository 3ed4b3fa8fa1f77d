"""JSON Lines and other text files read as numbered lines, with problems as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from docketry.functions.text import strip

BOM = b"\xef\xbb\xbf"


def file_problem(content: Column) -> Column:
    """``encoding`` for a byte order mark or for bytes that aren't UTF-8."""
    bad = F.substring(content, 1, 3).eqNullSafe(F.lit(bytearray(BOM))) | F.try_validate_utf8(content.cast("string")).isNull()
    return F.when(bad, "encoding")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).like("OBJECT%"), F.lit(False))


def parse_lines(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, line, v, problem``: lines count from 1 with blank ones, which are left out; only LF ends a line."""
    rows = texts.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw"))
    rows = rows.select(*keys, (F.col("n") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw")).where(F.col("raw").rlike(r"(?U)\S"))
    parsed = rows.withColumn("v", F.try_parse_json("raw"))
    return parsed.select(*keys, "line", F.when(is_object(F.col("v")), F.col("v")).alias("v"), F.when(~is_object(F.col("v")), "json").alias("problem"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, v, problem`` of the files under ``path``; a file that can't be read as text has one row without a line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("problem", file_problem(F.col("content")))
    good = parse_lines(files.where("problem IS NULL").select("path", F.col("content").cast("string").alias("text")), "text", "path")
    bad = files.where("problem IS NOT NULL").select("path", F.lit(None).cast("int").alias("line"), F.lit(None).cast(T.VariantType()).alias("v"), "problem")
    return good.unionByName(bad)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, value``: every line of the files under ``path``, counted from 1 in its file, blank ones too.

    Files are split, so a line's number is its place in its split, plus the lines of the splits before it in the file:
    one pass counts the lines of each split, prefix sums by file give where each begins, and a second pass adds them.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # one relation for both passes: its files are listed once, so both are split alike
    lines = spark.read.option("lineSep", "\n").text(path).select("value", place.alias("split"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("split.file").orderBy("split.start").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, "split").select(F.col("file").alias("path"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Request log lines ``path, line_no, skipped, at, kind, url, status, throttling``; what isn't an object counts as skipped.

    Numbers are those of ``numbered_lines``; blank lines count and are left out.
    """
    lines = numbered_lines(spark, path).where(F.col("value").rlike(r"(?U)\S"))
    return typed_log(lines.withColumn("v", F.try_parse_json("value")), "path")


def typed_log(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, line_no, skipped, at, kind, url, status, throttling`` from ``keys, line_no, v``; throttling of another type is empty."""
    v = F.col("v")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.throttling", "variant")) == "STRING", F.lit(False))
    return lines.select(
        *keys, "line_no", (~is_object(v)).alias("skipped"), F.coalesce(text("at"), F.lit("")).alias("at"), F.coalesce(text("kind"), F.lit("")).alias("kind"), text("url").alias("url"),
        F.coalesce(text("status"), F.lit("")).alias("status"), F.when(is_text, text("throttling")).otherwise("").alias("throttling"),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, query``: one query a line, white space of any kind taken off its ends; blank lines and those that begin with # are left out."""
    rows = numbered_lines(spark, path).select("path", "line_no", strip(F.col("value")).alias("query"))
    return rows.where("query <> '' AND NOT startswith(query, '#')")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """``path, idx, v, problem``: the elements of the JSON array in each file, in order.

    A file that isn't UTF-8, isn't JSON or holds something else than an array is one row with a ``problem``; an element
    that is no object is a row with one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", file_problem(F.col("content")).alias("problem"), F.col("content").cast("string").alias("text"))
    read = files.select("path", "problem", F.when(F.col("problem").isNull(), F.try_parse_json("text")).alias("v"))
    list_ = F.coalesce(F.schema_of_variant("v").like("ARRAY%"), F.lit(False))
    told = F.coalesce("problem", F.when(F.col("v").isNull(), "json").when(~list_, "no array"))
    rows = read.withColumn("problem", told)
    items = rows.where("problem IS NULL").select("path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("idx", "v"))
    items = items.select("path", "idx", F.when(is_object(F.col("v")), F.col("v")).alias("v"), F.when(~is_object(F.col("v")), "no object").alias("problem"))
    return items.unionByName(rows.where("problem IS NOT NULL").select("path", F.lit(None).cast("int").alias("idx"), F.lit(None).cast(T.VariantType()).alias("v"), "problem"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def count_by_kind(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """Files by the folder they lie in; nothing is opened, since the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.element_at(F.split("path", "/"), -depth).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
