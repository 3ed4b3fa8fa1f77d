"""Quality scores learnt from preference pairs (Bradley-Terry).

A labelled good document is preferred to a labelled bad one; the logistic loss on the difference of their
features gives each document a utility, and the utility's quantile at the labelled share of bad documents
becomes the decision threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import blocks, hash_words, joined, only, word_spans

BLOCK_CHARS = 1_000_000
#: Score at which a document counts as good.
CUT = 0.3

_BYTES = np.arange(256)


def _table(chars: str) -> np.ndarray:
    return np.isin(_BYTES, [ord(c) for c in chars])


_SPACE = _table(" \t\n\v\f\r")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_CLASSES = {"bang": _table("!"), "bar": _table("|"), "mark": _table("*#$%&@^~_=+<>{}[]\\/`")}
#: A byte from 0xC3 on begins a letter beyond ASCII in the texts at hand; the second byte of a capital of Latin-1 lies below 0xA0.
_LEAD = _BYTES >= 0xC3
#: Bins of hashed words and of hashed byte trigrams, and the weight of their standardised shares beside NAMES: the less, the more the ridge holds them back.
WORD_BINS, GRAM_BINS, GRAM_WEIGHT = 128, 128, 0.2
NAMES = ["empty", "long_word", "upper", "caps_words", *_CLASSES, "symbols", "repeats", "top_word", "same_again", "junk_words", "junk_half", "few_distinct", "upper_half"]


def features(texts: list[str]) -> np.ndarray:
    """One row of NAMES and of hashed n-gram shares for each whole text; an empty text has its own feature and zeros."""
    out = {n: np.zeros(len(texts)) for n in NAMES}
    data, ends = joined(texts)
    if not len(texts):
        return np.zeros((0, len(NAMES) + WORD_BINS + GRAM_BINS))
    begin = np.concatenate([[0], ends[:-1]])
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), begin)
    size = np.maximum(ends - begin - 1, 0)
    chars = np.maximum(per_text((data & 0xC0) != 0x80) - 1, 1)
    capital = _UPPER[data]
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0xA0)
    small = _LOWER[data] | _LEAD[data]
    small[:-1] &= ~capital[1:]
    n_upper, n_lower = per_text(capital), per_text(small)
    out["upper"] = n_upper / np.maximum(n_upper + n_lower, 1)
    for name, members in _CLASSES.items():
        out[name] = per_text(members[data]) / chars
    out["symbols"] = out["bang"] + out["bar"] + out["mark"]
    starts, stops = word_spans(data, ~_SPACE)
    doc = np.searchsorted(ends, starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    some = np.maximum(n, 1)
    by_doc = lambda values: np.bincount(doc, weights=values, minlength=len(texts))
    length = stops - starts
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags.astype(np.int64))])
    caps, lows, odd = upto(capital), upto(small), upto(_CLASSES["bang"][data] | _CLASSES["bar"][data] | _CLASSES["mark"][data])
    in_word = lambda c: c[stops] - c[starts]
    shouted = (in_word(caps) >= 2) & (in_word(lows) == 0)
    junk = in_word(odd) > 0
    out["caps_words"] = by_doc(shouted) / some
    out["long_word"] = by_doc(length > 20) / some
    if len(starts):
        hashed = hash_words(data, starts, stops)
        again = np.zeros(len(hashed), dtype=bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
        out["same_again"] = by_doc(again) / some
        order = np.lexsort((hashed, doc))
        h, d = hashed[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(h)))
        distinct = np.bincount(d[at], minlength=len(texts)) / some
        top = np.zeros(len(texts))
        np.maximum.at(top, d[at], runs)
        out["top_word"] = top / some * (n > 20)
        out["repeats"] = 1 - distinct
        out["few_distinct"] = np.maximum(0, 0.4 - distinct) * (n > 20)
        out["junk_words"] = by_doc(junk | shouted) / some
    out["junk_half"] = (out["junk_words"] > 0.5).astype(float)
    out["upper_half"] = (out["upper"] > 0.5).astype(float)
    out["empty"] = (size == 0).astype(float)
    # shares in a few words say little: they shrink towards none
    sure = n / (n + 5)
    words = np.bincount(doc * WORD_BINS + (hashed >> np.uint64(57)).astype(np.int64), minlength=len(texts) * WORD_BINS) if len(starts) else np.zeros(len(texts) * WORD_BINS)
    gram = (data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(25)
    whole = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))[: max(len(data) - 2, 0)]
    grams = np.bincount(whole * GRAM_BINS + gram, minlength=len(texts) * GRAM_BINS)
    shares = [np.sqrt(c.reshape(len(texts), -1) / np.maximum(t, 1)[:, None]) * sure[:, None] for c, t in ((words, n), (grams, size))]
    return np.column_stack([*[out[k] if k == "empty" else out[k] * sure for k in NAMES], *shares])


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in units of their deviation, those of n-grams held back by GRAM_WEIGHT."""
    z = ((x - mean) / scale).clip(-8, 8)
    z[:, len(NAMES) :] *= GRAM_WEIGHT
    return z


@dataclass
class Ranking:
    """A linear utility over standardised features; scores rise with it and pass CUT at the learnt quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        u = self.utility(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-u.clip(-50, 50)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry by Newton steps on ``pairs`` random pairs of a good and a bad row.

    Rows of one label only, or none at all, prefer nothing: the utility is then constant, and every score lies
    just above the cut unless all rows are bad.
    """
    width = x.shape[1]
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    yes, no = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(yes) or not len(no):
        return Ranking(mean, scale, np.zeros(width), 1.0 if len(no) else -1.0)
    z = standard(x, mean, scale)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(yes, pairs), rng.choice(no, pairs)
    w = np.zeros(width)
    for _ in range(25):
        curve, slope = ridge * np.eye(width), -ridge * w
        for some in np.array_split(np.arange(pairs), -(-pairs // 10_000)):
            diff = z[better[some]] - z[worse[some]]
            p = 1 / (1 + np.exp((diff @ w).clip(-50, 50)))
            curve += (diff * (p * (1 - p))[:, None]).T @ diff / pairs
            slope += diff.T @ p / pairs
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    # midway between the utilities a hundredth of the rows below and above the share of bad ones
    share = len(no) / (len(no) + len(yes))
    near = np.quantile(z @ w, np.clip([share - 0.01, share + 0.01], 0, 1))
    return Ranking(mean, scale, w, float(near.mean()))


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["doc_id"], [t if isinstance(t, str) else "" for t in batch["text"]], strict=True)
            for some in blocks(rows, lambda r: len(r[1]), BLOCK_CHARS):
                yield pd.DataFrame({"doc_id": [i for i, _ in some], "x": [x.tobytes() for x in features([t for _, t in some]).astype(np.float32)]})

    return docs.mapInPandas(run, "doc_id long, x binary")


def held_out(column: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Ranking:
    """Learn from labelled documents that aren't held out.

    At most ``max_rows`` documents, those with the smallest hash of their id, come to the driver as features:
    this bound is a parameter, and everything else covers all rows.  A document with labels of both kinds is
    left out of training; of several texts under one labelled id that of the smallest bytes of features trains.
    """
    marks = only(labels, doc_id="doc_id", quality="quality").where("quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = marks.where("quality = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "quality")
    texts = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    rows = _featured(texts).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), dtype=np.float32).reshape(len(rows), len(NAMES) + WORD_BINS + GRAM_BINS).astype(float)
    return fit_pairs(x, rows["quality"].to_numpy())


def score_quality(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; whole texts are read, null counts as empty.

    Rows are independent: repeated rows get equal scores, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["doc_id"], [t if isinstance(t, str) else "" for t in batch["text"]], strict=True)
            for some in blocks(rows, lambda r: len(r[1]), BLOCK_CHARS):
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i, _ in some], dtype="Int64"), "score": model.score(features([t for _, t in some]))})

    scored = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def only_good(docs: DataFrame, model: Ranking, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``cut`` or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            scores = [model.score(features(some)) for some in blocks(texts, len, BLOCK_CHARS)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= cut))

    return docs.mapInArrow(run, docs.schema)
