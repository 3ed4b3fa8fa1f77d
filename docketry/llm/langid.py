"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language (hashed character trigrams, counted over all training rows) is
combined with the declared markup language, the language suffix of the address, and a prior for the host that
is smoothed towards its registered domain and towards the whole table.  All tables of counts come from grouped
aggregation; only the trigram table, of a fixed size, goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import blocks, joined, materialise, only, text_or_empty

#: The languages told apart.
LANGUAGES = ("de", "en", "es", "fr")
BINS = 1 << 16
BLOCK_CHARS = 1_000_000
#: A text speaks with the weight of so many letters at most: neighbouring trigrams aren't independent.
WEIGHT = 60.0
#: How often a declared language or an address suffix is right, where it names one of LANGUAGES.
DECLARED, SUFFIX = 0.9, 0.8
#: Rows that the coarser prior counts for.
HOST_ROWS, DOMAIN_ROWS = 5.0, 20.0
#: Share of the uniform choice in each language's trigrams, so that an unseen one costs the same however large the table.
UNSEEN = 0.05
#: Below this mean log-odds against the uniform choice a text isn't in any of the languages, unless it is short.
ALIEN = -1.0
SURE = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the letter trigrams (bytes, word edges as blanks) of all texts, and the text each belongs to."""
    data, ends = joined([t.lower() for t in texts])
    data = np.where(_LETTER[_FOLD[data]], _FOLD[data], 32).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gram = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    # a trigram with a blank in its middle says nothing, nor does one that leaves its text
    use = data[1:-1] != 32
    at = np.flatnonzero(use)
    return ((gram[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), np.searchsorted(ends, at + 1, side="right")


def _rows(batch: pd.DataFrame, *columns: str):
    rows = zip(*[batch[c] for c in columns], [t if isinstance(t, str) else "" for t in batch["text"]], strict=True)
    return blocks(rows, lambda r: len(r[-1]), BLOCK_CHARS)


def count_trigrams(training: DataFrame) -> DataFrame:
    """``lang, bin, n`` over all rows of ``training(lang, text)`` with a language of LANGUAGES.

    Each task adds up its rows first, so at most languages * BINS rows leave a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(LANGUAGES), BINS), dtype=np.int64)
        for batch in batches:
            for some in _rows(batch, "lang"):
                bins, doc = trigrams([t for _, t in some])
                code = np.array([LANGUAGES.index(lang) for lang, _ in some], dtype=np.int64)
                total += np.bincount(code[doc] * BINS + bins, minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        yield pd.DataFrame({"lang": np.array(LANGUAGES)[lang], "bin": cell, "n": total[lang, cell]})

    rows = training.where(F.col("lang").isin(*LANGUAGES)).select("lang", F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def likelihoods(counts: DataFrame) -> np.ndarray:
    """Log-odds of each bin against a uniform choice, one column per language; at most languages * BINS rows are read."""
    table = np.zeros((BINS, len(LANGUAGES)))
    rows = counts.toPandas()
    for k, lang in enumerate(LANGUAGES):
        own = rows[rows["lang"] == lang]
        table[own["bin"].to_numpy(dtype=np.int64), k] += own["n"].to_numpy(dtype=float)
    return np.log((1 - UNSEEN) * table / np.maximum(table.sum(0), 1) * BINS + UNSEEN).astype(np.float32)


def text_evidence(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods by language, weighted; letters counted; and the mean for the best language."""
    bins, doc = trigrams(texts)
    n = np.bincount(doc, minlength=len(texts))
    total = np.column_stack([np.bincount(doc, weights=table[bins, k], minlength=len(texts)) for k in range(len(LANGUAGES))])
    mean = total / np.maximum(n, 1)[:, None]
    return mean * np.minimum(n, WEIGHT)[:, None], n, mean.max(1)


def pages_as_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, declared, suffix, text`` of raw pages.

    The declared language is that of the html element; the suffix is the first folder of the address where it has
    two letters, else a host's two-letter ending; the text is what tags, scripts and styles leave.
    """
    rows = only(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)))
    folder = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return rows.select(
        "id", "host",
        F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})\b", 1)).alias("declared"),
        F.when(folder != "", folder).otherwise(F.regexp_extract("host", r"\.([a-z]{2})$", 1)).alias("suffix"),
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ").alias("text"),
    )


def documents_as_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str | None = None) -> DataFrame:
    """``id, host, declared, suffix, text`` of documents: the source stands for the host, and there is no address.

    A declared language (``lang_col``) is evidence only where it hasn't trained the trigram table; by default there is none.
    """
    rows = only(docs, id=id_col, text=text_col, source=source_col, **({"lang": lang_col} if lang_col else {}))
    declared = F.lower(F.substring(F.trim(text_or_empty("lang")), 1, 2)) if lang_col else F.lit("")
    return rows.select(F.col("id").cast("long").alias("id"), F.lower(text_or_empty("source")).alias("host"), declared.alias("declared"), F.lit("").alias("suffix"), text_or_empty("text").alias("text"))


def _evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Log-evidence of text, declared language and suffix for each language of LANGUAGES."""
    k = len(LANGUAGES)
    said = {p: {lang: np.log(np.where(np.arange(k) == i, p, (1 - p) / (k - 1))) for i, lang in enumerate(LANGUAGES)} for p in (DECLARED, SUFFIX)}
    nothing = np.zeros(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in _rows(batch, "id", "host", "declared", "suffix"):
                log, letters, best = text_evidence([r[-1] for r in some], table)
                log = log + np.array([said[DECLARED].get(r[2], nothing) + said[SUFFIX].get(r[3], nothing) for r in some])
                share = np.exp(log - log.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                yield pd.DataFrame({"id": pd.array([None if pd.isna(r[0]) else int(r[0]) for r in some], dtype="Int64"), "host": [r[1] or "" for r in some], "evidence": list(log), "share": list(share), "letters": letters, "fit": best})

    return rows.select("id", "host", "declared", "suffix", "text").mapInPandas(run, "id long, host string, evidence array<double>, share array<double>, letters long, fit double")


def host_priors(evidence: DataFrame) -> DataFrame:
    """``host, host_n, host_counts, domain_prior``: soft counts by host, and the prior of its registered domain.

    Counts are added before the shuffle, so a host of a third of all rows costs a row per task.  The domain is the
    host's last two labels; its prior is smoothed towards that of the whole table, the latter towards uniform.
    """
    k = len(LANGUAGES)
    sums = [F.sum(F.col("share")[i]).alias(f"c{i}") for i in range(k)]
    by_host = materialise(evidence.groupBy("host").agg(F.count(F.lit(1)).alias("host_n"), *sums), "langid-hosts")
    by_host = by_host.withColumn("domain", F.substring_index("host", ".", -2))
    whole = by_host.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
    total = sum(whole[f"c{i}"] or 0.0 for i in range(k))
    top = [((whole[f"c{i}"] or 0.0) + 1.0) / (total + k) for i in range(k)]
    by_domain = by_host.groupBy("domain").agg(F.sum("host_n").alias("n"), *[F.sum(f"c{i}").alias(f"d{i}") for i in range(k)])
    prior = F.array(*[(F.col(f"d{i}") + DOMAIN_ROWS * top[i]) / (F.col("n") + DOMAIN_ROWS) for i in range(k)])
    joined_up = by_host.join(by_domain.select("domain", prior.alias("domain_prior")), "domain")
    return materialise(joined_up.select("host", "host_n", F.array(*[f"c{i}" for i in range(k)]).alias("host_counts"), "domain_prior"), "langid-priors")


def identify(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``id, lang, probability, accepted, letters, fit`` for every row of ``id, host, declared, suffix, text``.

    The prior of a row's host leaves the row itself out.  A row is rejected when no language reaches SURE, or when
    its text of 30 letters or more is unlike all of them.  Null and empty fields are no evidence: a row without any
    takes the prior; ties go to the first of LANGUAGES.  Repeated rows get one answer; an empty table gives none.
    """
    k = len(LANGUAGES)
    evidence = materialise(_evidence(rows, table), "langid-evidence")
    known = evidence.join(host_priors(evidence), "host", "left")
    score = F.array(*[
        F.col("evidence")[i] + F.log((F.greatest(F.col("host_counts")[i] - F.col("share")[i], F.lit(0.0)) + HOST_ROWS * F.col("domain_prior")[i]) / (F.col("host_n") - 1 + HOST_ROWS))
        for i in range(k)
    ])
    best = known.withColumn("score", score).withColumn("top", F.array_max("score"))
    best = best.withColumn("probability", 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position("score", F.col("top")).cast("int"))
    alien = (F.col("letters") >= 30) & (F.col("fit") < ALIEN)
    return best.select("id", lang.alias("lang"), "probability", ((F.col("probability") >= SURE) & ~alien).alias("accepted"), "letters", "fit")


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> np.ndarray:
    """The trigram table from all documents that declare one of LANGUAGES."""
    return likelihoods(count_trigrams(only(docs, lang=lang_col, text=text_col).select(F.lower(F.substring(F.trim(text_or_empty("lang")), 1, 2)).alias("lang"), "text")))
