"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

Impacts are divided by the score that an item's own text gets, so one threshold holds for all items.  Terms
whose impacts together stay small are non-essential: a passage must collect the rest from the others.  A batch
of passages is first held against the block maxima of the essential terms at once; where a block can reach the
threshold, WAND runs over its postings.  Hits are verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORD_BASE, blocks, hash_words, joined, materialise, only, word_spans

K1, B = 1.2, 0.75
#: Score, as a share of an item's own, from which a passage is a hit.
THRESHOLD = 0.5
#: What the non-essential terms of an item may add up to.
SPARE = 0.25
#: Items of one index block.
BLOCK_ITEMS = 4
#: Passages have twice as many words as the longest item, this at least, and each begins in the middle of the one before.
LEAST_WORDS = 32
#: Word triples of question and answer that a leaked item has in the passage.
QUESTION, ANSWER = 0.6, 0.5
#: UTF-8 bytes of item text that one index, which goes to every task, may hold; more items take more passes over the documents.
INDEX_BYTES = 16_000_000
BLOCK_CHARS = 1_000_000

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LAST_SENTENCE = re.compile(r"^(.*\w.*[.?!:])\s+(\S*\w.*?)$", re.DOTALL)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and characters beyond ASCII, in lower case) and the text of each."""
    data, ends = joined([t.lower() for t in texts])
    starts, stops = word_spans(data, _IS_WORD)
    return hash_words(data, starts, stops), np.searchsorted(ends, starts, side="right")


def triples(words: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row; of fewer words, of them all."""
    if len(words) < 3:
        return words.sum(keepdims=True) if len(words) else words
    step = [np.uint64(pow(WORD_BASE, k, 1 << 64)) for k in range(3)]
    return words[:-2] * step[0] + words[1:-1] * step[1] + words[2:] * step[2]


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; an item of one sentence is halved."""
    if m := _LAST_SENTENCE.match(text.strip()):
        return m[1], m[2]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def wand(lists: list[tuple[list[tuple[int, float]], float]], threshold: float) -> list[tuple[int, float]]:
    """Items whose impacts reach the threshold, document at a time: postings sorted by item, each with its maximum."""
    cursors = [[postings, best, 0] for postings, best in lists]
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[0][c[2]][0])
        total, pivot = 0.0, None
        for c in cursors:
            total += c[1]
            if total >= threshold - 1e-9:
                pivot = c[0][c[2]][0]
                break
        if pivot is None:
            break
        if cursors[0][0][cursors[0][2]][0] == pivot:
            score = 0.0
            for c in cursors:
                item, impact = c[0][c[2]]
                if item != pivot:
                    break
                score += impact
                c[2] += 1
            if score >= threshold - 1e-9:
                out.append((pivot, score))
        else:
            for c in cursors:
                while c[2] < len(c[0]) and c[0][c[2]][0] < pivot:
                    c[2] += 1
        cursors = [c for c in cursors if c[2] < len(c[0])]
    return out


@dataclass
class Statistics:
    """BM25's figures over all items, however many indexes hold them; ``df`` may be that of an index's own terms alone."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        words, item = terms(texts)
        length = np.bincount(item, minlength=len(texts))
        return Statistics(len(texts), float(length.mean()) if len(texts) else 0.0, int(length.max(initial=0)), Counter(t for t, _ in set(zip(words.tolist(), item.tolist(), strict=True))))


_HELD: dict[str, Index] = {}


def _index(name: str, ids: list, texts: list[str], statistics: Statistics) -> Index:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Index(ids, texts, statistics, name)
    return _HELD[name]


class Index:
    """Postings with impacts relative to each item's own score, in blocks of items."""

    def __init__(self, ids: list, texts: list[str], statistics: Statistics | None = None, name: str | None = None):
        self.ids, self.texts, self.name = list(ids), list(texts), name or uuid.uuid4().hex
        self.statistics = statistics or Statistics.of(self.texts)

    def __reduce__(self):
        # tasks build the index anew from the texts, which are smaller; a worker keeps the one it built last
        return _index, (self.name, self.ids, self.texts, self.statistics)

    @property
    def width(self) -> int:
        return max(LEAST_WORDS, self.statistics.longest)

    @cached_property
    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [tuple(np.unique(triples(terms([p])[0])) for p in question_and_answer(t)) for t in self.texts]

    @cached_property
    def built(self) -> tuple:
        words, item = terms(self.texts)
        n, length = len(self.texts), np.bincount(item, minlength=len(self.texts))
        mean, df, all_ = max(self.statistics.mean, 1), self.statistics.df, self.statistics.n
        tf = Counter(zip(words.tolist(), item.tolist(), strict=True))
        impact, own = {}, defaultdict(float)
        for (t, i), k in tf.items():
            impact[t, i] = math.log(1 + (all_ - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * length[i] / mean))
            own[i] += impact[t, i]
        postings: dict[int, list] = defaultdict(list)
        for (t, i), v in sorted(impact.items(), key=lambda x: x[0][1]):
            postings[t].append((i, v / own[i]))
        # the most frequent terms are non-essential, as long as no item collects more than SPARE from them
        spent, spare = np.zeros(n), set()
        for t in sorted(postings, key=lambda t: (-df[t], t)):
            after = spent.copy()
            for i, v in postings[t]:
                after[i] += v
            if after.max() > SPARE:
                break
            spent, spare = after, spare | {t}
        n_blocks = -(-n // BLOCK_ITEMS)
        left = np.zeros(n_blocks)
        np.maximum.at(left, np.arange(n) // BLOCK_ITEMS, spent)
        by_block: list[dict[int, tuple[list, float]]] = [{} for _ in range(n_blocks)]
        for t, p in postings.items():
            for i, v in p:
                held, best = by_block[i // BLOCK_ITEMS].get(t, ([], 0.0))
                by_block[i // BLOCK_ITEMS][t] = (held + [(i, v)], max(best, v))
        essential = np.array(sorted(set(postings) - spare), dtype=np.uint64)
        rows = [sorted({(i // BLOCK_ITEMS) for i, _ in postings[int(t)]}) for t in essential]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        block = np.array([b for r in rows for b in r], dtype=np.int64)
        best = np.array([by_block[b][int(t)][1] for t, r in zip(essential, rows, strict=True) for b in r], dtype=float)
        return essential, first, block, best, left, by_block

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """Number of the text, item, score, and overlaps of question and answer, for all verified hits; whole texts are read."""
        essential, first, block, best, left, by_block = self.built
        words, doc = terms(texts)
        if not len(words) or not len(essential):
            return
        half = self.width
        n_words = np.bincount(doc, minlength=len(texts))
        begin = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        n_pass = np.where(n_words > 0, np.maximum(1, -(-n_words // half) - 1), 0)
        pass_first = np.concatenate([[0], np.cumsum(n_pass)])
        at = np.minimum(np.searchsorted(essential, words), len(essential) - 1)
        here = np.flatnonzero(essential[at] == words)
        place = (here - begin[doc[here]]) // half
        key = []
        for back in (0, 1):
            p = place - back
            ok = (p >= 0) & (p < n_pass[doc[here]])
            key.append((pass_first[doc[here[ok]]] + p[ok]) * len(essential) + at[here[ok]])
        key = np.unique(np.concatenate(key))
        passage, term = key // len(essential), key % len(essential)
        count = first[term + 1] - first[term]
        total = int(count.sum())
        if not total:
            return
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        entry = np.arange(total) - np.repeat(start - first[term], count)
        cell, where = np.unique(np.repeat(passage, count) * len(left) + block[entry], return_inverse=True)
        bound = np.bincount(where, weights=best[entry]) + left[cell % len(left)]
        last, seen = -1, []
        for p, b in zip(*(x.tolist() for x in np.divmod(cell[bound >= THRESHOLD - 1e-9], len(left))), strict=True):
            if p != last:
                d = int(np.searchsorted(pass_first, p, side="right")) - 1
                lo = int(begin[d]) + (p - int(pass_first[d])) * half
                span = words[lo : min(lo + 2 * half, int(begin[d] + n_words[d]))]
                last, seen, grams = p, np.unique(span).tolist(), None
            held = by_block[b]
            for item, score in wand([held[t] for t in seen if t in held], THRESHOLD):
                grams = np.unique(triples(span)) if grams is None else grams
                # an item or part of fewer than three words needs its words alone
                share = [float(np.isin(x, grams if self._is_long(item, k) else self._short(span, self.texts[item], k)).mean()) if len(x) else 1.0 for k, x in enumerate(self.parts[item])]
                if share[0] >= QUESTION and share[1] >= ANSWER:
                    yield d, item, score, share[0], share[1]

    def _is_long(self, item: int, part: int) -> bool:
        return len(terms([question_and_answer(self.texts[item])[part]])[0]) >= 3

    @staticmethod
    def _short(span: np.ndarray, text: str, part: int) -> np.ndarray:
        n = len(terms([question_and_answer(text)[part]])[0])
        return np.unique(span if n < 2 else span[:-1] + span[1:])


def _item_terms(rows: DataFrame) -> DataFrame:
    """``part, item, text, length, term``: each distinct term of every item with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, text in zip(batch["part"], batch["text"], strict=True):
                words = terms([text])[0]
                out += [(part, len(words), t) for t in np.unique(words).view(np.int64).tolist()]
            yield pd.DataFrame(out, columns=["part", "length", "term"]).astype("int64")

    return rows.select("part", "text").mapInPandas(run, "part long, length long, term long")


def indexes(items: DataFrame, index_bytes: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The items as indexes of about ``index_bytes`` each, one after another, by a hash of id and text.

    Items without words can't leak.  The statistics are those of all items: frequencies come from a grouped
    aggregation, of which an index takes those of its own terms.
    """
    rows = only(items, item=id_col, text=text_col).select(F.col("item").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // index_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"length": np.bincount(terms(batch["text"].tolist())[1], minlength=len(batch)).astype(np.int64)})

    n, mean, longest = rows.select("text").mapInPandas(lengths, "length long").where("length > 0").agg(F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    if not n:
        return
    spread = materialise(_item_terms(rows).groupBy("part", "term").agg(F.count(F.lit(1)).alias("n")), "decontam-terms")
    df = materialise(spread.groupBy("term").agg(F.sum("n").alias("df")), "decontam-df")
    for k in range(parts):
        own = [r for r in rows.where(F.col("part") == k).select("item", "text").orderBy("item", "text").collect() if len(terms([r["text"]])[0])]
        if own:
            counts = spread.where(F.col("part") == k).join(df, "term").select("term", "df").toPandas()
            frequency = dict(zip(counts["term"].to_numpy(dtype=np.int64).view(np.uint64).tolist(), counts["df"].tolist(), strict=True))
            yield Index([r["item"] for r in own], [r["text"] for r in own], Statistics(n, float(mean), int(longest), frequency))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: one row for each document and item that leaked into it.

    Every passage of every whole text is a query and all items above the threshold are retrieved; clean documents
    give no rows, nor do null and empty texts.  Repeated rows give repeated results; items of equal text are found
    alike; an empty table on either side gives no rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = zip(batch["doc_id"], [t if isinstance(t, str) else "" for t in batch["text"]], strict=True)
                for some in blocks(texts, lambda r: len(r[1]), BLOCK_CHARS):
                    most: dict[tuple[int, int], tuple] = {}
                    for d, item, *values in index.search([t for _, t in some]):
                        most[d, item] = max(most.get((d, item), (0.0,)), tuple(values))
                    out = [(None if pd.isna(some[d][0]) else int(some[d][0]), index.ids[item], *v) for (d, item), v in most.items()]
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return rows.mapInPandas(run, schema)

    found, before = None, None
    for index in indexes(items, index_bytes):
        if before is not None:
            # another pass follows: this one's hits are written, and its index can go
            written = materialise(searched(before), "decontam-found")
            found = written if found is None else found.unionByName(written)
        before = index
    if before is None:
        return docs.sparkSession.createDataFrame([], schema)
    last = searched(before)
    return last if found is None else found.unionByName(last)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text no item leaked into; no shuffle, one pass for each index."""

    def kept(docs: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                keep, begin = np.ones(len(texts), dtype=bool), 0
                for some in blocks(texts, len, BLOCK_CHARS):
                    for d, *_ in index.search(some):
                        keep[begin + d] = False
                    begin += len(some)
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    before = None
    for index in indexes(items, index_bytes):
        if before is not None:
            docs = materialise(kept(docs, before), "decontam-kept")
        before = index
    return docs if before is None else kept(docs, before)
