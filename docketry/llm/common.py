"""Helpers that several operators share: tables, shared storage, byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch.  Rows of long text make batches of some megabytes at this number.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark; Arrow batches stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master."""
    path, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not path and context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="docketry-"))
    return path or context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/docketry/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one computation, written to the shared folder; ``drop`` removes those that nothing will read again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it again, as ``materialise`` does."""
        self.paths.append(new_path(self.spark, label))
        return _written(df, self.paths[-1])

    def drop(self, but: int = 0) -> None:
        """Remove the tables, all but the last ``but``; what was made from them has been written by then."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and gives the optimizer the true size."""
    return _written(df, new_path(df.sparkSession, label))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle whatever its size: nothing of it is broadcast, so nothing passes the driver.

    Spark takes a file's bytes, as compressed, for the size of a table, and an array for one element, so that what it
    broadcasts can be many times its limit.
    """
    return df.hint("merge")


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Named columns alone, so that extra columns of any name can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


#: Shares of a table from which on a key counts as hot: at most so many keys reach one in so many rows.
HOT = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, size: str = "n") -> DataFrame:
    """``rows`` joined to the one row of ``values`` for their key, which holds in ``size`` how many rows have it.

    Keys of at least one in ``HOT`` rows, no more than ``HOT`` by count, are broadcast: their rows aren't shuffled, so
    none of them fills a task.  All other keys are joined by a shuffle.  Null keys match each other.
    """
    total = values.agg(F.sum(size).alias("n")).first()["n"] or 0
    is_hot = F.col(size) * HOT >= total
    side = values.withColumnRenamed(key, "hot_key")
    match = F.col(key).eqNullSafe(F.col("hot_key"))
    hot = F.broadcast(side.where(is_hot))
    few = rows.join(hot, match).drop("hot_key")
    rest = rows.join(hot.select("hot_key"), match, "left_anti").join(side.where(~is_hot), match).drop("hot_key")
    return few.unionByName(rest)


#: Odd multiplier of the polynomial word hash, modulo 2**64.
WORD_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``is_word`` holds."""
    inside = is_word[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """WORD_BASE to the powers 0 .. n - 1 at least."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(WORD_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend, don't overlap, and aren't empty."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    length = ends - starts
    at = np.arange(int(length.sum()), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    offset = at - np.repeat(first, length)
    spread = (data[offset + np.repeat(starts, length)].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()) + 1)[offset]
    return mix64(np.add.reduceat(spread, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a line feed after each, and the offset at which each one ends."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, dtype=np.int64)
    return np.frombuffer(b"".join(r + b"\n" for r in raw), dtype=np.uint8), ends


def blocks(rows, size_of, limit: int):
    """Lists of rows whose sizes add up to about ``limit``; a larger row makes a list of its own."""
    held, total = [], 0
    for row in rows:
        n = size_of(row)
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
