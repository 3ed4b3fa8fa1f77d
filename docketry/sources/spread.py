"""Rows dealt over tasks, for steps whose work on a row is much larger than the row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as a shuffle has, no fewer than there are cores.

    Spark sizes tasks by bytes: a small file, or what is left of a table after a filter, is one task however long its
    rows take.  The number is given, so that adaptive plans don't join these partitions again by their bytes.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
