"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless row numbers from their contents alone (not from files, partitions or tasks), a keyed
permutation of ``0 .. n - 1`` shuffles the numbers, and shard and slot follow from the shuffled position by
division.  Both ways are closed formulas: from a row number to (shard, slot), and back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.llm.common import materialise, only, text_or_empty

ROUNDS = 6
#: Steps of the cycle walk that the expression unrolls.  The domain exceeds n by less than its square root, so
#: longer walks have a probability below n ** -32; they raise an error, and another seed avoids them.
WALK = 64
#: Copies of one row that one task numbers at a time.
BLOCK = 10_000


def _domain(n: int) -> tuple[int, int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(WALK, a * b - n)


def _network(x: Column, a: int, b: int, seed: int, inverse: bool) -> Column:
    """One pass of the Feistel network over a * b values, as a fold over rounds, so that no expression doubles."""
    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
    sign = -1 if inverse else 1

    def step(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, F.pmod(s["l"] + sign * F.pmod(F.xxhash64(s["r"], r, F.lit(seed)), F.lit(a)), F.lit(a))).otherwise(s["l"])
        right = F.when(r % 2 == 1, F.pmod(s["r"] + sign * F.pmod(F.xxhash64(s["l"], r, F.lit(seed)), F.lit(b)), F.lit(b))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    # 53 bits hold x / b exactly only below 2 ** 53 rows, far above any table
    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of row number ``x`` among ``n`` shuffled rows (``inverse``: the row number at place ``x``)."""
    a, b, walk = _domain(n)
    out = _network(x.cast("long"), a, b, seed, inverse)
    if walk:
        again = F.array(*[F.lit(i) for i in range(walk)])
        out = F.aggregate(again, out, lambda y, _: F.when(y >= F.lit(n), _network(y, a, b, seed, inverse)).otherwise(y))
        if walk == WALK:
            out = F.transform(F.array(out), lambda y: F.when(y < F.lit(n), y).otherwise(F.raise_error(F.lit("cycle walk too long: take another seed")).cast("long")))[0]
    return out


def locate(row_number: Column, n: int, n_shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number, without any data."""
    place = permuted(row_number, n, seed)
    return F.pmod(place, F.lit(n_shards)).cast("int"), F.floor(place / F.lit(n_shards)).cast("long")


def row_at(shard: Column, slot: Column, n: int, n_shards: int, seed: int) -> Column:
    """The row number that lies in ``slot`` of ``shard``: the inverse of ``locate``."""
    return permuted(slot.cast("long") * F.lit(n_shards) + shard.cast("long"), n, seed, inverse=True)


def feistel_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, seed: int = 20240229, overhead: int = 16, buckets: int = 4096) -> DataFrame:
    """Put every row into one of ``n_shards`` shards: ``doc_id, size, text_crc32, law, row_number, position, shard, slot, grown_shard``.

    The law is ``rows``: counts of shards differ by one at most, slots of a shard are gapless from 0, and
    ``grown_shard`` is null.  ``size`` is the text's UTF-8 length plus ``overhead``; null text counts as empty.
    Row numbers follow (bucket, id, size, checksum), where the bucket is a hash of those three, so a table
    gives the same shards however its files are cut.  Rows alike in all three are one key with a count: they
    are counted before the shuffle and numbered in blocks, so copies of one row don't meet in a task.  Null
    ids are a value like any other; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    keys = only(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + overhead).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
    )
    counts = materialise(keys.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")), "shard-keys")
    # at most `buckets` rows come to the driver
    totals = sorted((r["bucket"], r["n"]) for r in counts.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())
    start, offsets = 0, []
    for bucket, n in totals:
        offsets.append((bucket, start))
        start += n
    n = start
    before = W.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.join(F.broadcast(spark.createDataFrame(offsets, "bucket int, offset long")), "bucket").withColumn("first", F.col("offset") + F.sum("copies").over(before) - F.col("copies"))
    single = placed.where("copies = 1").select("doc_id", "size", "text_crc32", F.col("first").alias("row_number"))
    runs = placed.where("copies > 1").select("doc_id", "size", "text_crc32", "first", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    many = runs.repartition("first", "block").select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("first") + F.col("block"), F.col("first") + F.least(F.col("block") + BLOCK, F.col("copies")) - 1)).alias("row_number"))
    place = permuted(F.col("row_number"), max(n, 1), seed)
    return single.unionByName(many).withColumn("position", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number", "position",
        F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(n_shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the texts as Parquet folders ``shard=N``, each file ordered by slot.

    Rows alike in id, size and checksum are one text in several places, so one copy is joined to all places.
    """
    key = ["doc_id", "size", "text_crc32"]
    texts = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("bytes"), F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"), "text")
    texts = texts.groupBy("doc_id", "bytes", "text_crc32").agg(F.first("text").alias("text"))
    match = F.expr("a.doc_id <=> t.doc_id AND a.text_crc32 = t.text_crc32")
    rows = assigned.select(*key, "shard", "slot").alias("a").join(texts.alias("t"), match).select("a.doc_id", "t.text", "a.shard", "a.slot")
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
