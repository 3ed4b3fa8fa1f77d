"""Integer vectors: what the compression and the whitening of embeddings read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(vectors: DataFrame, scale: int, offset: int, limit: int, vector_col: str = "embedding", **columns: str) -> tuple[DataFrame, int]:
    """The given columns (new name = old name) and ``v array<long>``, floor(scale * c) + offset for every component c; and the length.

    Rows whose vector is null or empty, or holds null, NaN or infinite components, are dropped; so are those of another
    length than the most frequent one (of lengths equally frequent, the longer).  A component beyond ``limit`` once
    scaled is an error, as sums over it wouldn't fit.  Without rows the length is 0.
    """
    rows = vectors.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()], F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double")).alias("x"))
    finite = rows.where("x IS NOT NULL AND size(x) > 0").where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # distinct lengths are few: one row for each
    sizes = finite.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    fits = lambda c: F.when(F.abs(c * scale) < limit, F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("vector component out of range")).cast("long"))
    return finite.where(F.size("x") == d).select(*columns, F.transform("x", fits).alias("v")), d


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column whose rows are equally long, as one array with a row for each."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The inverse of ``matrix``."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))
