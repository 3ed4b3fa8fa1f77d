"""What a clean-up would cover, as a table: items without those inside others, and totals.  Nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def plain_path(path: Column) -> Column:
    """The parts of an absolute path as an array, ``.`` and ``..`` taken out by the text alone; null for a relative path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda way, p: F.when(p == "..", F.slice(way, 1, F.greatest(F.size(way) - 1, F.lit(0)))).otherwise(F.concat(way, F.array(p))))
    return F.when(path.startswith("/"), walked)


def drop_covered(items: DataFrame) -> DataFrame:
    """``items(idx, path, ...)`` without those that lie inside another or repeat one with a smaller ``idx``.

    An item is looked up by each of its ancestors, so no two items are compared that don't share a path; work grows
    with the depth of paths.  Items whose path can't be read stay.
    """
    rows = items.withColumn("_parts", plain_path(F.col("path")))
    first = F.row_number().over(W.partitionBy("_parts").orderBy("idx"))
    once = rows.where("_parts IS NOT NULL").withColumn("_nth", first).where("_nth = 1").drop("_nth")
    above = once.select("idx", F.explode(F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda n: F.struct(n.alias("n"), F.slice("_parts", 1, n).alias("up")))).alias("a"), F.size("_parts").alias("depth"))
    above = above.where("a.n < depth").select("idx", F.col("a.up").alias("_parts"))
    inside = above.join(once.select("_parts"), "_parts", "left_semi").select("idx").distinct()
    kept = once.join(inside, "idx", "left_anti")
    return kept.unionByName(rows.where("_parts IS NULL")).drop("_parts")


def rollup(items: DataFrame, by: str) -> DataFrame:
    """``by, n, bytes`` of items with ``bytes``, and a row of all where ``by`` is null; items are those ``drop_covered`` leaves."""
    return drop_covered(items).rollup(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
