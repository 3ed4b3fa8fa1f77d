import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import exactdup

DOCS = "doc_id long, text string, lang string"


def clashing(df):
    return df.select("*", *[F.lit(1).alias(c) for c in ("n", "best", "content", "salt", "kept", "n_chars", "text_digest", "hot_key", "copies", "key", "r")])


def brute(rows):
    """Groups by content; of each the place of the row that stays."""
    groups = {}
    for i, (id_, text, *_) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append(i)
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            out.append((rows[i][0], rows[keep][0], len(members), i == keep, hashlib.sha256(content.encode()).hexdigest(), len(rows[i][1] or "")))
    return sorted(out, key=str)


ROWS = (
    [(i, f"the text {i % 7}" + " " * (i % 3) + "\n", "en") for i in range(60)]
    + [(100, None, "en"), (101, "", "en"), (102, " \t\r\n\x0b\x0c", None), (103, " ", "en"), (104, "é" * 300_000, "fr"), (105, "é" * 300_000 + " ", "fr")]
    + [(None, "the text 3", "de"), (None, "alone", "de"), (7, "the text 0  \n", "en"), (7, "the text 0  \n", "en"), (200, "x y", "en"), (200, "xy ", "en"), (201, "😀 a", "en"), (202, "😀a", "en")]
)


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_groups_equal_brute_force(spark, bits):
    """With digests of four bits almost all groups share one, and content alone tells them apart."""
    df = clashing(spark.createDataFrame(ROWS, DOCS).repartition(5))
    got = exactdup.exact_groups(df, digest=lambda c: F.substring(exactdup.sha256(c), 1, bits // 4), salts=3)
    got = got.select("doc_id", "keep_id", "group_size", "kept", "text_digest", "n_chars")
    want = [(a, b, c, d, e[: bits // 4], f) for a, b, c, d, e, f in brute(ROWS)]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)


def test_rows_that_stay(spark):
    df = clashing(spark.createDataFrame(ROWS, DOCS))
    got = exactdup.exact_dedup(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], len(r["text"] or "")) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(r[0], r[5]) for r in brute(ROWS) if r[3]], key=str)


def test_no_rows(spark):
    none = clashing(spark.createDataFrame([], DOCS))
    assert exactdup.exact_groups(none).collect() == []
    assert exactdup.exact_dedup(none).collect() == []


def test_many_copies(spark):
    """A third of all rows are one text under one id and one text under many ids; each row comes back."""
    df = spark.range(0, 90_000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS doc_id", "CASE WHEN id % 3 = 2 THEN concat('t', id) ELSE 'same' END AS text")
    got = exactdup.exact_groups(df)
    by = {r["group_size"]: (r["rows"], r["kept"], r["keep"]) for r in got.groupBy("group_size").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"), F.min("keep_id").alias("keep")).collect()}
    assert by == {60_000: (60_000, 1, 1), 1: (30_000, 30_000, 2)}
