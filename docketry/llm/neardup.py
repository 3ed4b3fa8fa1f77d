"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of ``SUB`` sub-keys, each of ``PER`` minima, are combined pair by pair: SUB * SUB table
keys from 2 * SUB * PER minima, where plain banding would need SUB * SUB * 2 * PER.  At similarity 0.8 a pair
shares no table with probability 2 * (1 - 0.8**PER)**SUB, below 0.0001 here.  Documents with equal shingle sets
are one class.  Candidates are confirmed on full sets, and links are closed to components.

Within a table's bucket not all pairs are formed: members are compared with the bucket's smallest, components are
found, and only buckets whose members still lie in different components are looked at again.  There, small buckets
form their pairs; members of large ones are searched in blocks: those outside the largest component are the queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORD_BASE, Scratch, blocks, by_shuffle, hash_words, joined, materialise, mix64, only, word_spans

SUB, PER = 10, 2
MINIMA = 2 * SUB * PER
#: Of the minima so many must agree before full sets are compared; at similarity 0.8 a pair misses this with probability 0.0001.
AGREE = 22
BLOCK_CHARS = 1_000_000
#: Members of a bucket up to which its pairs are formed, AGREE first; larger ones are searched in blocks, on full sets alone.
SMALL = 32
#: Shingles of one block.
BLOCK_SHINGLES = 400_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_RNG = np.random.default_rng(1)
_MULT = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one text after another, and how many each text has.

    A to Z are lower-cased; words are runs of bytes other than space and U+0009 to U+000D.  A text of fewer
    words than a shingle takes has them all as its one shingle; one without words has none.
    """
    data, ends = joined(texts)
    data = _LOWER[data]
    starts, stops = word_spans(data, _IS_WORD)
    hashed = hash_words(data, starts, stops)
    doc = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    total = np.zeros(len(hashed), dtype=np.uint64)
    for t in range(words):
        # words beyond the text's end count nothing: this is what a text of too few words needs
        at = np.arange(len(hashed)) + t
        inside = at < (first + n_words)[doc]
        total[inside] += hashed[at[inside]] * np.uint64(pow(WORD_BASE, t, 1 << 64))
    size = np.minimum(n_words, words)
    total = mix64(total + size[doc].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    n_raw = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    keep = np.arange(len(hashed)) - first[doc] < n_raw[doc]
    total, doc = total[keep], doc[keep]
    edge = np.concatenate([[0], np.cumsum(n_raw)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        total[a:b].sort()
    fresh = np.ones(len(total), dtype=bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[fresh], np.bincount(doc[fresh], minlength=len(texts))


def minima(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MINIMA hash minima of each set that isn't empty, 32 bits each."""
    start = np.concatenate([[0], np.cumsum(count)[:-1]])[count > 0]
    out = np.empty((int((count > 0).sum()), MINIMA), dtype=np.uint32)
    if len(start):
        for k in range(MINIMA):
            out[:, k] = np.minimum.reduceat((sets * _MULT[k] + _ADD[k]) >> np.uint64(32), start)
    return out.view(np.int32)


def _texts(batch: pd.DataFrame) -> Iterator[list[tuple]]:
    rows = ((i, t if isinstance(t, str) else "") for i, t in zip(batch["id"], batch["text"], strict=True))
    return blocks(rows, lambda r: len(r[1]), BLOCK_CHARS)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """``id, n, set_key, minima``; the key digests the full set and is null for an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _texts(batch):
                sets, count = shingle_sets([t for _, t in rows], words)
                low, full, edge = minima(sets, count), iter(range(len(rows))), np.concatenate([[0], np.cumsum(count)])
                keys = [_digest(sets[a:b]) if b > a else None for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pd.DataFrame({"id": pd.array([i for i, _ in rows], dtype="Int64"), "n": count.astype(np.int64), "set_key": keys, "minima": [low[next(full)] if n else None for n in count]})

    return docs.mapInPandas(run, "id long, n long, set_key binary, minima array<int>")


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _full_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, members`` from ``node, set_key, text``; a text of another set than its class has is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["node"], batch["set_key"], batch["text"], strict=True)
            for some in blocks(((n, bytes(k), t or "") for n, k, t in rows), lambda r: len(r[2]), BLOCK_CHARS):
                sets, count = shingle_sets([t for _, _, t in some], words)
                made = [(n, m) for (n, k, _), m in zip(some, np.split(sets, np.cumsum(count)[:-1]), strict=True) if _digest(m) == k]
                if made:  # a frame without rows has no type of list
                    yield pd.DataFrame({"node": [n for n, _ in made], "members": [m.view(np.int64) for _, m in made]})

    return texts.select("node", "set_key", "text").mapInPandas(run, "node long, members array<long>")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``id, component``: the smallest id each node can reach over ``edges(a, b)``.

    Nodes take the smallest label among their neighbours, then the label that the round before gave to that label;
    every round is one table in the shared folder, and its predecessor is removed.  Rounds end when no label falls.
    """
    edge, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    both = edge.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = rounds.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), label)
    while True:
        heard = both.join(by_shuffle(labels.select(F.col("id").alias("b"), "component")), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(by_shuffle(heard), "id", "left").select("id", "component", F.least("component", F.coalesce("heard", "component")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = rounds.write(lower.join(by_shuffle(jump), "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("now"), "component"), label)
        rounds.drop(but=1)
        labels = new.select("id", F.col("now").alias("component"))
        if new.where("now < component").isEmpty():
            edge.drop()
            return labels


def _searched(large: DataFrame, sets_of, classes: DataFrame, percent: int) -> DataFrame:
    """Links across components among members of large buckets, ``a, b``.

    Buckets that share members make a cluster.  Its queries are the members outside its largest component; they are
    held against all its members, block by block, with exact intersections.  Blocks hold BLOCK_SHINGLES.
    """
    scratch = Scratch(large.sparkSession)
    # a node lies in one bucket of each table at most, so its set of first members is no longer than there are tables
    nodes = large.groupBy("node").agg(F.min("component").alias("component"), F.collect_set("first").alias("firsts")).withColumn("low", F.array_min("firsts"))
    nodes = scratch.write(nodes, "neardup-large")
    meet = nodes.select(F.col("low").alias("a"), F.explode("firsts").alias("b")).where("a < b").distinct()
    clusters = components(meet, "neardup-clusters").select(F.col("id").alias("low"), F.col("component").alias("cluster"))
    placed = nodes.select("node", "component", "low").join(by_shuffle(clusters), "low", "left").select("node", "component", F.coalesce("cluster", "low").alias("cluster"))
    placed = scratch.write(placed.join(by_shuffle(classes.select("node", "n")), "node"), "neardup-placed")
    sizes = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    whole = sizes.groupBy("cluster").agg(F.max_by(F.struct("component", "n"), "m").alias("most"), F.sum("n").alias("all"))
    parts = whole.select("cluster", F.col("most.component").alias("main"), "all", (F.col("all") - F.col("most.n")).alias("asked"))
    count = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int").alias(f"{c}_blocks")
    parts = scratch.write(parts.where("asked > 0").select("cluster", "main", count("all"), count("asked")), "neardup-parts")
    rows = placed.join(by_shuffle(parts), "cluster")
    sets = sets_of(rows.select("node")).dropDuplicates(["node"])
    rows = scratch.write(rows.join(by_shuffle(sets), "node"), "neardup-rows")
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(f"{c}_blocks")).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1))
    held = rows.select("cluster", "node", "component", "members", F.lit(False).alias("asks"), own("all").alias("x"), each("asked").alias("y"))
    asking = rows.where("component <> main").select("cluster", "node", "component", "members", F.lit(True).alias("asks"), each("all").alias("x"), own("asked").alias("y"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        queries, rows = block[block["asks"]], block[~block["asks"]]
        out = []
        if len(queries) and len(rows):
            size = rows["members"].map(len).to_numpy()
            flat = np.concatenate(rows["members"].to_list())
            owner = np.repeat(np.arange(len(rows)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            component, node = rows["component"].to_numpy(), rows["node"].to_numpy()
            for q, c, members in zip(queries["node"], queries["component"], queries["members"], strict=True):
                lo, hi = np.searchsorted(flat, members, side="left"), np.searchsorted(flat, members, side="right")
                n = hi - lo
                at = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                both = np.bincount(owner[at], minlength=len(rows))
                hit = np.flatnonzero((100 * both >= percent * (size + len(members) - both)) & (component != c))
                # one link to each component is enough
                for other in np.unique(component[hit]):
                    out.append((q, node[hit[component[hit] == other][0]]))
        return pd.DataFrame([(min(p), max(p)) for p in out], columns=["a", "b"]).astype("int64")

    found = materialise(held.unionByName(asking).groupBy("cluster", "x", "y").applyInPandas(search, "a long, b long"), "neardup-found")
    scratch.drop()
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: groups of documents linked by shingle sets alike in ``percent`` or more.

    Two documents are linked when 100 * intersection >= percent * union; ``component_id`` is the smallest id
    reachable over links, ``kept`` says that it is the row's own.  Null and empty texts, and texts without words,
    have no shingles and no links.  Rows of one id and text are alike in everything, so all or none are kept; an
    id on different texts stands for each of them.  Rows without an id have links only to texts of the same set,
    and are kept where no such text has an id.  An empty table gives no rows; other columns are ignored.
    """
    docs = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = materialise(_signatures(docs, words), "neardup-signed")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.first("minima").alias("minima"))
    # numbered as written: the file fixes the numbers
    classes = materialise(classes.where("id IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    repeated = not signed.groupBy("id").count().where("count > 1").isEmpty()

    def sub_key(collection: int):
        start = collection * SUB * PER
        return F.array(*[F.xxhash64(F.lit(start + i), *[F.col("minima")[start + i * PER + t] for t in range(PER)]) for i in range(SUB)])

    # few small files hold the classes: dealt anew, so that all tasks share the keys
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = classes.select("node", sub_key(0).alias("xs"), sub_key(1).alias("ys")).repartition(tasks, "node")
    halves = dealt.select("node", F.posexplode("xs").alias("i", "x"), "ys").select("node", "i", "x", F.posexplode("ys").alias("j", "y"))
    rows = halves.select("node", F.xxhash64("i", "x", "j", "y").alias("key"))
    buckets = Scratch(spark)
    shared = buckets.write(rows.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"), "neardup-keys")
    members = buckets.write(rows.join(by_shuffle(shared), "key"), "neardup-members")
    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()

    agree = "size(filter(zip_with(x.minima, y.minima, (p, q) -> p = q), s -> s))"
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs those whose full sets are alike: sketches first, then sets."""
        scratch = Scratch(spark)
        sketch = classes.select("node", "n", "minima")
        near = pairs.alias("p").join(by_shuffle(sketch).alias("x"), F.expr("p.a = x.node")).join(by_shuffle(sketch).alias("y"), F.expr(f"p.b = y.node AND {fits}"))
        near = scratch.write(near.where(f"{agree} >= {AGREE}").select("p.a", "p.b"), "neardup-near")
        wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        sets = _full_sets(classes.select("node", "id", "set_key").join(by_shuffle(wanted), "node").join(by_shuffle(docs), "id"), words)
        sets = scratch.write(sets.groupBy("node").agg(F.first("members").alias("members")) if repeated else sets, "neardup-sets")
        full = near.alias("p").join(by_shuffle(sets).alias("x"), F.expr("p.a = x.node")).join(by_shuffle(sets).alias("y"), F.expr("p.b = y.node"))
        full = full.select("p.a", "p.b", F.size("x.members").alias("nx"), F.size("y.members").alias("ny"), F.size(F.array_intersect("x.members", "y.members")).alias("both"))
        found = materialise(full.where(f"100L * both >= {percent}L * (nx + ny - both)").select("a", "b"), "neardup-linked")
        scratch.drop()
        return found

    edges = linked(pairs)
    labels = components(edges).withColumnRenamed("id", "node")
    # buckets of two have been compared in full; of the others those count that reach over several components
    open_ = members.where("size > 2").join(by_shuffle(labels), "node", "left").select("key", "first", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = materialise(open_.join(by_shuffle(buckets.write(mixed, "neardup-mixed")), "key"), "neardup-open")
    buckets.drop()
    more = []
    few = open_.where(f"size <= {SMALL} AND node <> first")
    new = few.alias("x").join(by_shuffle(few).alias("y"), F.expr("x.key = y.key AND x.component < y.component")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    new = materialise(new, "neardup-pairs")
    if not new.isEmpty():
        more.append(linked(new))
    large = open_.where(f"size > {SMALL}")
    if not large.isEmpty():
        more.append(_searched(large, lambda nodes: _full_sets(classes.select("node", "id", "set_key").join(by_shuffle(nodes), "node").join(by_shuffle(docs), "id"), words), classes, percent))
    if more:
        for found in more:
            edges = edges.unionByName(found)
        labels = components(edges).withColumnRenamed("id", "node")

    # classes of one document without links need no row here: their documents are their own component
    groups = classes.join(by_shuffle(labels), "node", "left").where("copies > 1 OR component IS NOT NULL").select("set_key", "id", F.coalesce("component", "node").alias("component"))
    lowest = materialise(groups.groupBy("component").agg(F.min("id").alias("component_id")), "neardup-lowest")
    groups = materialise(groups.join(by_shuffle(lowest), "component").select("set_key", "component_id"), "neardup-groups")
    out = signed.where("set_key IS NOT NULL").select("id", "n", "set_key").join(by_shuffle(groups), "set_key", "left").select("id", "n", "component_id").unionByName(signed.where("set_key IS NULL").select("id", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
