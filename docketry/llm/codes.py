"""Compressed vector codes: Lloyd's rounds for each part of the vectors, with adaptive distance bounds.

Drake and Hamerly's bounds: of every part of every vector the ``b`` closest entries are persisted with a lower bound
on the distance to each, in order, and one outer bound for all other entries.  When entries move, bounds fall by how
far; entries whose bound stays above the exact distance to the current entry can't win.  The others are compared in
integers, so results, ties included, are those of a full search.  ``b`` follows the depth that was needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import Scratch, join_hot, materialise
from docketry.llm.vectors import integer_vectors, lists, matrix

#: Share of the parts whose depth decides how many entries stay tracked.
COVERED = 0.99
#: Relative slack of bounds: what lies within it is compared in integers.
SLACK = 1e-9


@dataclass
class Bounds:
    """Of one part position: closest entries, lower bounds on the distances to them, and on that to any other entry."""

    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    def cut(self, b: int) -> Bounds:
        """The first ``b`` entries; the bounds of those cut off join the outer one."""
        if b >= self.near.shape[1]:
            return self
        return Bounds(self.near[:, :b], self.lower[:, :b], np.minimum(self.outer, self.lower[:, b:].min(axis=1)))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries) ** 2).sum(axis=-1)


def _down(x: np.ndarray) -> np.ndarray:
    """Single precision, never above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def full_search(x: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds of the ``b`` closest entries, lower index first among equals, and the least squared distance."""
    d = _distances(x, book[None])
    order = np.argsort(d, axis=1, kind="stable")
    ranked = np.take_along_axis(d, order, axis=1)
    outer = _down(np.sqrt(ranked[:, b])) if b < len(book) else np.full(len(x), np.inf, dtype=np.float32)
    return Bounds(order[:, :b], _down(np.sqrt(ranked[:, :b])), outer), ranked[:, 0]


def bounded_search(x: np.ndarray, book: np.ndarray, held: Bounds, moved: np.ndarray) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """Bounds after entries moved by ``moved`` at most, least squared distances, and how deep each row had to look.

    Depth 0: the entry can't have changed.  Depth m < b: the m tracked entries after the first were compared too.
    Depth b: the outer bound was passed and all entries were compared.
    """
    b = held.near.shape[1]
    near, best = held.near.copy(), _distances(x, book[held.near[:, :1]])[:, 0]
    bounds = np.concatenate([held.lower[:, 1:].astype(np.float64) - moved[near[:, 1:]], held.outer[:, None].astype(np.float64) - moved.max()], axis=1)
    bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    depth = (bounds <= (np.sqrt(best) * (1 + SLACK) + SLACK)[:, None]).sum(axis=1)
    lower, outer = np.concatenate([_down(np.sqrt(best))[:, None], _down(bounds[:, :-1])], axis=1), _down(bounds[:, -1])
    some = np.flatnonzero((depth > 0) & (depth < b))
    if len(some):
        width = int(depth[some].max()) + 1
        looked, untouched = near[some, :width], np.arange(width) > depth[some, None]
        d = _distances(x[some], book[looked])
        # those not looked at keep their places behind the others
        order = np.lexsort((np.where(untouched, np.arange(width), looked), np.where(untouched, np.iinfo(np.int64).max, d)), axis=-1)
        new = np.where(untouched, lower[some, :width], _down(np.sqrt(d)))
        near[some, :width], lower[some, :width] = np.take_along_axis(looked, order, axis=1), np.take_along_axis(new, order, axis=1)
        best[some] = np.take_along_axis(d, order[:, :1], axis=1)[:, 0]
    every = np.flatnonzero(depth == b)
    if len(every):
        again, best[every] = full_search(x[every], book, b)
        near[every], lower[every], outer[every] = again.near, again.lower, again.outer
    return Bounds(near, lower, outer), best, depth


@dataclass
class Codebooks:
    """Entries by part, index and position, as integers of the scaled vectors."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers in order, decimal and joined by commas."""
        return hashlib.sha256(",".join(str(x) for x in self.entries.reshape(-1).tolist()).encode()).hexdigest()


def _assigner(parts: int, book: np.ndarray, moved: np.ndarray | None, tracked: list[int], final: bool):
    """One round of assignment for Arrow batches; ``moved`` is None in the first round, when nothing is persisted."""
    width = book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch, "v")
            near, lower, outer, best, depth = [], [], [], [], []
            if moved is not None:
                stored = matrix(batch, "near").astype(np.int64), matrix(batch, "lower"), matrix(batch, "outer")
                ends = np.cumsum(batch.column("widths")[0].as_py())
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width]
                if moved is None:
                    now, d = full_search(x, book[p], tracked[p])
                    deep = np.full(len(x), tracked[p])
                else:
                    at = slice(ends[p - 1] if p else 0, ends[p])
                    now, d, deep = bounded_search(x, book[p], Bounds(stored[0][:, at], stored[1][:, at], stored[2][:, p]).cut(tracked[p]), moved[p])
                near.append(now.near)
                lower.append(now.lower)
                outer.append(now.outer)
                best.append(d)
                depth.append(deep)
            code = np.stack([a[:, 0] for a in near], axis=1)
            out = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
            if final:
                out |= {"code": pa.array([row.tobytes().hex() for row in code.astype(np.uint8)], pa.string()), "error": pa.array(np.stack(best, axis=1).sum(axis=1), pa.int64())}
            else:
                out |= {
                    "v": batch.column("v"),
                    "near": lists(np.concatenate(near, axis=1).astype(np.int16), pa.int16()),
                    "lower": lists(np.concatenate(lower, axis=1), pa.float32()),
                    "outer": lists(np.stack(outer, axis=1), pa.float32()),
                    "widths": lists(np.tile(np.array(tracked, dtype=np.int32), (len(v), 1)), pa.int32()),
                    "code": lists(code.astype(np.int16), pa.int16()),
                    "depth": lists(np.stack(depth, axis=1).astype(np.int16), pa.int16()),
                }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _sums(parts: int, k: int):
    """Of a task: counts and sums by part, entry and position, and counts by part and depth, as ``what, part, slot, total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        depths = np.zeros((parts, k + 1), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, code, depth = matrix(batch, "v"), matrix(batch, "code").astype(np.int64), matrix(batch, "depth").astype(np.int64)
            width = v.shape[1] // parts
            sums = np.zeros((width + 1, parts * k), dtype=np.int64) if sums is None else sums
            slot = (code + np.arange(parts) * k).reshape(-1)
            np.add.at(sums[0], slot, 1)
            for c in range(width):
                np.add.at(sums[c + 1], slot, v[:, c::width].reshape(-1))
            np.add.at(depths, (np.broadcast_to(np.arange(parts), depth.shape), depth), 1)
        if sums is not None:
            what = np.concatenate([np.repeat(np.arange(len(sums)), parts * k), np.full(depths.size, -1)])
            slot = np.concatenate([np.tile(np.arange(parts * k), len(sums)), np.arange(depths.size)])
            total = np.concatenate([sums.reshape(-1), depths.reshape(-1)])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(a[some], pa.int64()) for a in (what, slot, total)], names=["what", "slot", "total"])

    return run


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up."""
    return np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=-1)) * (1 + SLACK)


def _needed(depths: dict[int, int], b: int, k: int) -> int:
    """How many entries to track: as deep as nearly all parts looked, never more than now, an eighth of all at least."""
    total, seen = sum(depths.values()), 0
    for depth in sorted(depths):
        seen += depths[depth]
        if seen >= COVERED * total:
            return max(1, k // 8, min(b, depth + 1))
    return b


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error, label_error`` for every finite vector, and the codebooks the codes refer to.

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts (another number of components is an
    error).  Codebooks start with the vectors of the ``entries`` smallest ids (ids before null, equal ids by vector),
    are moved ``rounds`` times to the floored mean of what they are nearest to (ties to the lower index, unused entries
    stay), and every part is assigned once more.  ``code`` has two hex digits a part, ``error`` the squared distances,
    ``label_error`` their sum over rows of the same label, nulls together.  Dropped rows: see ``integer_vectors``.
    Repeated rows are coded each; a table with fewer rows than entries has as many entries as rows; an empty table
    gives no rows; extra columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows, d = integer_vectors(vectors, scale, 0, 1 << 28, vector_col, vec_id=id_col, label=label_col)
    if d % parts or d // parts > 64:
        raise ValueError(f"{d} components don't make {parts} parts of 64 components at most")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return spark.createDataFrame([], f"{key}, code string, error bigint, label_error bigint"), Codebooks(np.zeros((parts, 0, 0), dtype=np.int64))
    k = len(first)
    book = np.array([r["v"] for r in first], dtype=np.int64).reshape(k, parts, d // parts).transpose(1, 0, 2)
    state = f"{key}, v array<bigint>, near array<smallint>, lower array<float>, outer array<float>, widths array<int>, code array<smallint>, depth array<smallint>"
    tracked, moved, scratch = [max(1, k // 4)] * parts, None, Scratch(spark)
    for _ in range(rounds):
        rows = scratch.write(rows.mapInArrow(_assigner(parts, book, moved, tracked, False), state), "codes-state")
        scratch.drop(but=1)
        # parts * entries * (components + 1) sums and parts * entries depths at most
        totals = rows.select("v", "code", "depth").mapInArrow(_sums(parts, k), "what bigint, slot bigint, total bigint").groupBy("what", "slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        sums = {(r["what"], r["slot"]): int(r["total"]) for r in totals}
        new = book.copy()
        for p in range(parts):
            for e in range(k):
                n = sums.get((0, p * k + e), 0)
                if n:
                    new[p, e] = [sums.get((c + 1, p * k + e), 0) // n for c in range(d // parts)]
            if moved is not None:
                tracked[p] = _needed({s: sums[(-1, p * (k + 1) + s)] for s in range(k + 1) if (-1, p * (k + 1) + s) in sums}, tracked[p], k)
        book, moved = new, np.stack([_moved(book[p], new[p]) for p in range(parts)])
    coded = materialise(rows.mapInArrow(_assigner(parts, book, moved, tracked, True), f"{key}, code string, error bigint"), "codes")
    scratch.drop()
    by_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    return join_hot(coded, by_label, "label").drop("n"), Codebooks(book)


def reconstruct(coded: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """``coded`` with ``approximation array<double>``: the middle of the cell of each coded component, unscaled."""
    book = books.entries
    flat = F.array(*[F.array(*[F.array(*[F.lit((float(c) + 0.5) / scale) for c in e]) for e in part]) for part in book])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approximation", F.concat(*[flat[p][index(p)] for p in range(len(book))]))
