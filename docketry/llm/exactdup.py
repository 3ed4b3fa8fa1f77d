"""Exact duplicates, white space aside: combine locally, merge salted groups, combine the winners of all salts.

Every stage groups by digest *and* normalised text, so Spark compares the full content wherever two rows meet; the
digest only decides where they meet.  A group's copies are combined in the task that reads them, then by salt, then
over all salts: a text that makes up a third of the table sends one row for each task and salt, never all its copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.llm.common import join_hot, materialise, only, text_or_empty

#: White space that doesn't count.
BLANK = r"[\x20\x09-\x0D]"
#: Copies of one row that one task writes out again.
BLOCK = 10_000


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, BLANK + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best(chars: Column, id_: Column) -> Column:
    """Least for the longest text; of these the smallest id, ids before null."""
    return F.struct((-chars).alias("shorter"), id_.isNull().alias("none"), id_.alias("id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_digest, n_chars``.

    Rows are of one group if their texts are equal once white space is deleted; null counts as empty, so null, empty
    and blank texts are one group.  The row with the most code points in its whole text stays, then that of the
    smallest id, ids before null.  Of rows alike in id, length and group exactly one is ``kept``.  ``digest`` may
    collide: groups are told apart by their content.  Extra columns are ignored; an empty table gives no rows.
    """
    text = text_or_empty("text")
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.char_length(text).cast("long").alias("n_chars"), normalised(text).alias("content"))
    rows = rows.withColumn("text_digest", digest(F.col("content")))
    # salts follow reading tasks, so that the copies of one task are one row before any shuffle
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = local.groupBy("text_digest", "content", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(_best(F.col("n_chars"), F.col("doc_id"))).alias("best"))
    groups = merged.repartition("text_digest").groupBy("text_digest", "content").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    # the content travels on only where two contents share a digest
    several = F.count(F.lit(1)).over(W.partitionBy("text_digest")) > 1
    groups = materialise(groups.withColumn("content", F.when(several, F.col("content"))), "exact-groups")
    counted = materialise(rows.groupBy("doc_id", "text_digest", "n_chars").agg(F.count(F.lit(1)).alias("copies")), "exact-rows")
    collided = groups.where("content IS NOT NULL").select("text_digest").distinct()
    if not collided.isEmpty():
        same = rows.join(collided, "text_digest", "left_semi").groupBy("doc_id", "text_digest", "n_chars", "content").agg(F.count(F.lit(1)).alias("copies"))
        rest = counted.join(collided, "text_digest", "left_anti")
        unlike = same.join(groups.where("content IS NOT NULL"), ["text_digest", "content"]).drop("content")
        found = join_hot(rest, groups.where("content IS NULL").drop("content"), "text_digest").unionByName(unlike)
    else:
        found = join_hot(counted, groups.drop("content"), "text_digest")
    wins = F.expr("doc_id <=> best.id AND n_chars = -best.shorter")
    out = [F.col("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), F.col("text_digest"), F.col("n_chars")]
    single = found.where("copies = 1").select(*out, wins.alias("kept"))
    runs = found.where("copies > 1").withColumn("wins", wins).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    runs = runs.repartition("text_digest", "doc_id", "start").withColumn("at", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + BLOCK, F.col("copies")) - 1)))
    return single.unionByName(runs.select(*out, (F.col("wins") & (F.col("at") == 0)).alias("kept")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one for each text, white space aside (see ``exact_groups``).

    Of rows alike in id, length and group any one stays, whatever its other columns hold.
    """
    kept = exact_groups(docs, id_col, text_col, salts=salts).where("kept").select(F.struct("doc_id", "n_chars", "text_digest").alias("key"))
    text = F.coalesce(F.col(f"r.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("r"))
    key = F.struct(F.col(f"r.`{id_col}`").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), sha256(normalised(text)).alias("text_digest"))
    return rows.withColumn("key", key).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("r.*")
