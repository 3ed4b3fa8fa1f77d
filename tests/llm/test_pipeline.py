from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm.decontam import find_leaks
from docketry.llm.neardup import shingle_sets

DOCS = "doc_id long, text string, lang string, source string"
WORDS = [f"w{i}" for i in range(400)]
A, B, C = " ".join(WORDS[:100]), " ".join(WORDS[100:200]), " ".join(WORDS[200:300])
ROWS = [(1, A), (1, B), (2, A + " end"), (None, A), (None, C), (None, C), (3, B), (3, B), (4, ""), (4, ""), (5, None), (None, "")]


def brute(rows):
    """What stays of (id, text): rows linked at 0.8 are grouped, one of each group is kept."""
    sets = [set(shingle_sets([t or ""], 5)[0].tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            alike = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) if sets[i] and sets[j] else rows[i][0] is not None and (rows[i][0], rows[i][1] or "") == (rows[j][0], rows[j][1] or "")
            if alike:
                group = [group[j] if g == group[i] else g for g in group]
    kept = [min((r for r, g in zip(rows, group, strict=True) if g == one), key=lambda r: (r[0] is None, r[0] or 0)) for one in set(group)]
    return sorted(kept, key=str)


def test_near_dedup_decides_on_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == brute(ROWS)


def test_language_rejects_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    good = docs.where("n_chars > 200" if "n_chars" in docs.columns else "length(text) > 200").first()
    greek = "Ελληνικά " * 60
    odd = spark.createDataFrame([(-1, good.text, good.lang, good.source), (-1, greek, None, "s"), (None, greek, None, "s")], DOCS)
    got = corpus_pipeline.language_id(spark, docs.unionByName(odd), "").where("doc_id = -1 OR doc_id IS NULL").collect()
    assert [(r.doc_id, r.text) for r in got] == [(-1, good.text)]


def test_tokens_are_decoded(spark):
    docs = spark.createDataFrame([(1, A, "en", "s")], DOCS)
    # this vocabulary's decoder sets words apart by their end marks
    (row,) = corpus_pipeline.tokens(spark, docs, "").collect()
    assert row.doc_id == 1 and row.ids and "".join(row.decoded.split()).replace("</w>", "") == A.replace(" ", "")


def test_run_keeps_clean_rows(spark, tmp_path):
    """All stages over a small folder with nulls, repeated ids and extra columns, and over an empty table."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = spark.createDataFrame([(-1, A, "en", "s"), (-1, None, None, None), (None, "", "en", "s"), (-1, "Ελληνικά " * 60, "en", "s")], DOCS)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    both = docs.select("doc_id", "text", "lang", "source").unionByName(odd)
    # columns named like those that stages add, all with few values
    for name in ("row_key", "ROW_KEY_", "row", "id", "component", "n", "key", "rank", "group"):
        both = both.withColumn(name, F.coalesce(both["doc_id"], F.lit(0)) % 7)
    both.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(r.doc_id in texts or r.doc_id in (-1, None) for r in rows)
    kept = {r.doc_id for r in rows if r.doc_id in texts}
    assert len(kept) == len([r for r in rows if r.doc_id in texts])
    # brute force: of what quality and language keep, one of each group stays, and none that holds a benchmark item
    stage = both
    for step in (corpus_pipeline.quality_classifier, corpus_pipeline.language_id):
        stage = step(spark, stage, str(tmp_path))
    left = [(r.doc_id, r.text) for r in stage.collect() if r.doc_id in texts]
    alike = {i for i, _ in brute(left)}
    items = [r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in find_leaks(stage, spark.read.parquet(f"{source}/benchmark.parquet")).collect()}
    assert all(not any(x in (texts[i] or "") for x in items) for i in kept)
    assert {i for i in alike if any(x in (texts[i] or "") for x in items)} <= leaked
    assert kept == {i for i in alike if i not in leaked}
    empty = tmp_path / "none"
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
