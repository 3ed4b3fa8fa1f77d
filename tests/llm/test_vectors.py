import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import codes, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def clashing(df):
    return df.select("*", *[F.lit(1).alias(c) for c in ("v", "x", "near", "code", "error", "n", "d", "size", "hot_key", "whitened", "deviation", "component")])


def odd_rows(n, d, seed=1):
    """Random vectors with ties, copies, a hot label, and rows that don't count."""
    random = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in random.integers(-40, 40, d) / 64], None if i % 11 == 0 else 5 if i % 3 else int(i % 4)) for i in random.permutation(n)]
    rows += rows[: n // 10]
    rows += [(n + i, rows[0][1], 9) for i in range(n // 3)]
    bad = [None, [], [0.5] * (d - 1) + [None], [0.5] * (d - 1) + [math.nan], [0.5] * (d - 1) + [-math.inf], [0.5] * (d + 1), [None] * d]
    return rows + [(-1 - i, v, 1) for i, v in enumerate(bad)] + [(None, rows[1][1], 3)]


def kept(rows, d):
    return [r for r in rows if r[1] and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]


# vector codes


def brute_codes(rows, d, parts, entries, rounds, scale=256):
    rows = sorted(kept(rows, d), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * x) for x in r[1]]))
    width = d // parts
    cut = [[[math.floor(scale * x) for x in r[1]][p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda j: (distance(v[p], books[p][j]), j))
    for _ in range(rounds):
        at = [[nearest(v, p) for p in range(parts)] for v in cut]
        books = [[[sum(c) // len(c) for c in zip(*m)] if (m := [v[p] for v, a in zip(cut, at) if a[p] == j]) else old for j, old in enumerate(books[p])] for p in range(parts)]
    out, by_label = [], {}
    for r, v in zip(rows, cut):
        a = [nearest(v, p) for p in range(parts)]
        error = sum(distance(v[p], books[p][a[p]]) for p in range(parts))
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{j:02x}" for j in a), error, r[2]))
    return [(i, c, e, by_label[label]) for i, c, e, label in out], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n, d, parts, entries, rounds", [(400, 8, 4, 64, 2), (300, 6, 2, 40, 4), (150, 4, 4, 7, 3), (20, 4, 2, 64, 2), (90, 5, 5, 33, 0)])
def test_codes_equal_a_full_search(spark, n, d, parts, entries, rounds):
    rows = odd_rows(n, d)
    coded, books = codes.compress_vectors(clashing(spark.createDataFrame(rows, VECTORS).repartition(7)), parts, entries, rounds)
    want, digest = brute_codes(rows, d, parts, entries, rounds)
    got = [tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert books.digest() == digest


def test_bounds_hold_and_spare_comparisons():
    """Over rounds of moves, bounds never exceed a distance, results are a full search's, and few rows look at all entries."""
    random = np.random.default_rng(3)
    x = random.integers(-200, 200, (3000, 4))
    book, b, held, seen = random.integers(-200, 200, (64, 4)), 16, None, []
    for step in (40, 12, 4, 1, 0):
        if held is None:
            held, best = codes.full_search(x, book, b)
        else:
            new = book + random.integers(-step, step + 1, book.shape)
            moved = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + codes.SLACK)
            book = new
            b = max(8, b - 2)
            held, best, depth = codes.bounded_search(x, book, held.cut(b), moved)
            seen.append((depth == b).mean())
        d = ((x[:, None] - book) ** 2).sum(axis=-1)
        assert (held.near[:, 0] == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert (held.lower.astype(float) ** 2 <= np.take_along_axis(d, held.near, axis=1) + 1e-9).all()
        rest = d.copy()
        np.put_along_axis(rest, held.near, np.iinfo(np.int64).max, axis=1)
        assert (held.outer.astype(float) ** 2 <= rest.min(axis=1)).all()
    assert seen[1] < 0.5 and seen[-1] == 0.0 and (depth > 0).mean() < 0.2


def test_tracked_entries_follow_the_depth_needed():
    assert codes._needed({0: 95, 1: 3, 2: 2}, 16, 64) == 8
    assert codes._needed({0: 50, 12: 50}, 16, 64) == 13
    assert codes._needed({16: 100}, 16, 64) == 16
    assert codes._needed({0: 5}, 2, 7) == 1


def test_codes_of_odd_tables(spark):
    none = clashing(spark.createDataFrame([], VECTORS))
    assert codes.compress_vectors(none)[0].collect() == []
    bad = clashing(spark.createDataFrame([(1, None, 1), (2, [None], None)], VECTORS))
    assert codes.compress_vectors(bad)[0].collect() == []
    with pytest.raises(ValueError):
        codes.compress_vectors(spark.createDataFrame([(1, [0.5] * 6, 1)], VECTORS))


def test_vectors_are_reconstructed(spark):
    rows = odd_rows(60, 4)
    coded, books = codes.compress_vectors(spark.createDataFrame(rows, VECTORS), 2, 16)
    for r in codes.reconstruct(coded, books).collect():
        want = [(c + 0.5) / 256 for p in range(2) for c in books.entries[p, int(r["code"][2 * p : 2 * p + 2], 16)]]
        assert r["approximation"] == pytest.approx(want)


# whitening


def brute_whitening(rows, d, components):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in kept(rows, d)])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-11 * e.sum()).sum()))
    out = {}
    for r, row, c in zip(kept(rows, d), x, centred):
        out.setdefault(r[0], []).append((sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), c @ u[:, :k] / np.sqrt(e[:k])))
    return n, e[:k] / e.sum(), u[:, :k], out


@pytest.mark.parametrize("n, d, components", [(500, 12, 8), (300, 5, 8), (4, 9, 8), (40, 1, 8), (700, 64, 20)])
def test_whitening_equals_dense_eigenvectors(spark, n, d, components):
    rows = odd_rows(n, d)
    white, m, c, error = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS).repartition(7)), components)
    total, explained, vectors, want = brute_whitening(rows, d, components)
    assert m.n == total and len(c.values) == len(explained)
    assert c.values / c.trace == pytest.approx(explained, rel=1e-10) and error < 1e-9
    signs = np.sign((c.vectors * vectors).sum(axis=0))
    assert np.abs(c.vectors * signs - vectors).max() < 1e-8
    got = {}
    for r in white.collect():
        got.setdefault(r["vec_id"], []).append((int(r["deviation"]), np.array(r["whitened"]) * signs))
    assert got.keys() == want.keys()
    for key in want:
        a, b = sorted(got[key], key=lambda t: (t[0], t[1][0])), sorted(want[key], key=lambda t: (t[0], t[1][0]))
        assert [t[0] for t in a] == [t[0] for t in b]
        assert np.abs(np.array([t[1] for t in a]) - np.array([t[1] for t in b])).max() < 1e-6


def test_inertia_counts():
    random = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 40):
        a = random.standard_normal((d, d))
        v = a @ a.T
        tri, e = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
        for shift in [-1.0, 0.0, *(e[:-1] + e[1:]) / 2, e[-1] + 1]:
            assert whitening.count_above(tri, shift) == (e > shift).sum()


@pytest.mark.parametrize("values", [[9.0] * 6 + [1.0] * 4, [5, 5 - 1e-9, 4, 1e-3, 1e-3, 1e-9, 0, 0, 0], [1e12, 1, 1e-2], [3.0] * 12, [8, 7, 6, 5, 4, 3, 2, 1, 1, 1]])
def test_close_and_equal_eigenvalues_are_all_found(spark, values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    c = whitening.leading_components(spark, v, 8)
    want = [e for e in sorted(values, reverse=True) if e > 8 * d * np.finfo(float).eps * sum(values)][:8]
    assert c.values == pytest.approx(want, rel=1e-7, abs=1e-14 * max(values))
    assert np.abs(c.vectors.T @ c.vectors - np.eye(len(want))).max() < 1e-9
    assert np.abs(v @ c.vectors - c.vectors * c.values).max() < 1e-11 * max(values)


def test_exact_sums_of_large_components(spark):
    rows = [(i, [float((-1) ** i * (i + 1) * 2.0**30), 2.0**31 - i], 1) for i in range(30)]
    m = whitening.whiten(spark.createDataFrame(rows, VECTORS), 2)[1]
    x = [[math.floor(1024 * c) + 100_000 for c in np.float32(r[1]).astype(float)] for r in rows]
    n, s = 30, [sum(c) for c in zip(*x)]
    for i in range(2):
        for j in range(2):
            assert m.covariance[i, j] == sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3


def test_nothing_to_whiten(spark):
    none = clashing(spark.createDataFrame([], VECTORS))
    assert whitening.whiten(none)[0].collect() == []
    one = whitening.whiten(spark.createDataFrame([(4, [0.5, 0.25], 1)], VECTORS))
    assert [tuple(r) for r in one[0].collect()] == [(4, 0, [])] and one[3] == 0.0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(9)], VECTORS))
    assert len(same[2].values) == 0 and same[0].count() == 9


def test_registered_whitening(spark):
    rows = queries.op12_whitening(spark, SF).collect()
    source = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, explained, _, want = brute_whitening(source, 64, 8)
    assert len(rows) == 8 * len(source) and {r["n"] for r in rows} == {n} and {r["identity_error"] for r in rows}.pop() < 1e-4
    for r in rows:
        deviation, white = want[r["vec_id"]][0]
        assert r["deviation"] == deviation and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(white[r["component"] - 1]), abs=1e-7)
