import random
import re

import pytest

from docketry.llm.neardup import near_duplicates


def brute(docs, words):
    """Components over all pairs of exact shingle sets."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def noisy(words, edits, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("words", [2, 5])
def test_groups_match_brute_force(spark, words):
    rng = random.Random(words)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = [(i, noisy(base, rng.randrange(0, 30), rng)) for i in range(120)]
    docs += [(200 + i, docs[5][1].upper()) for i in range(5)]
    docs += [(300 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    docs += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "One"), (405, "two words"), (406, "é É x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "x")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, words=words).collect()}
    want = brute(docs, words)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u"), (3, "k l"), (3, "m n o")]
    frame = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, text string, component long, id string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (3, 3, True), (3, 3, True)], key=str)


@pytest.mark.parametrize("ids", [1, 3])
def test_ids_on_many_different_texts(spark, ids, monkeypatch):
    """Ids repeat over different texts, in more blocks of text than one: a class and its rows are still told apart by text."""
    from docketry.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_CHARS", 2000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [noisy(base, rng.randrange(0, 20), rng) for _ in range(60)] + [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(40)]
    frame = spark.createDataFrame([(i % ids, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = near_duplicates(frame, words=2).collect()
    want = brute(list(enumerate(texts)), 2)
    # the smallest id that a row's group reaches
    low = {}
    for i, (_, c) in want.items():
        low[c] = min(low.get(c, ids), i % ids)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i % ids, want[i][0], low[want[i][1]]) for i in want)


def test_nothing_is_broadcast(spark):
    """Minima are an array, which Spark takes for one element, and files are compressed: no table may go through the driver."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    # a large bucket of many components, small ones, and copies
    docs = [(i, noisy(base, rng.randrange(0, 25), rng)) for i in range(100)] + [(200 + i, noisy(base[:40], 3, rng)) for i in range(10)] + [(300 + i, "a b c") for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert len(near_duplicates(frame, words=2).collect()) == len(docs)
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(k).physicalPlanDescription() for k in range(before, ran.size())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
