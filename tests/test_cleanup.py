"""Items inside others are dropped."""

import random
from pathlib import PurePosixPath

from docketry.operators.cleanup import drop_covered, rollup


def test_covered_items(spark):
    rng = random.Random(4)
    rows = [(i, "/" + "/".join(rng.choice("abc") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 6))), "k", 1) for i in range(300)]
    rows += [(300, "/a/b/../b/./x//", "k", 5), (301, None, "k", 7), (302, "rel/path", "q", 9)]
    items = spark.createDataFrame(rows[:303], "idx int, path string, kind string, bytes long")
    paths = [None if p is None or not p.startswith("/") else PurePosixPath(p.replace("/a/b/../b/./x//", "/a/b/x")) for _, p, _, _ in rows[:303]]
    want = {i for i, p in enumerate(paths) if p is None or not any(q is not None and j != i and ((p == q and j < i) or (p != q and p.is_relative_to(q))) for j, q in enumerate(paths))}
    assert {r.idx for r in drop_covered(items).collect()} == want
    sums = {r.kind: (r.n, r.bytes) for r in rollup(items, "kind").collect()}
    assert sums["q"] == (1, 9) and sums[None][0] == len(want)


def test_the_root_covers_all(spark):
    items = spark.createDataFrame([(0, "/a"), (1, "/../.."), (2, None), (3, "/")], "idx int, path string")
    assert {r.idx for r in drop_covered(items).collect()} == {1, 2}
    assert drop_covered(items.limit(0)).collect() == []
