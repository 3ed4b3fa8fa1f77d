"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, tokens.

Each stage takes what its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import bpe_encode
from docketry.llm.common import materialise, table
from docketry.llm.decontam import without_leaks
from docketry.llm.langid import documents_as_rows, identify, learn
from docketry.llm.neardup import near_duplicates
from docketry.llm.quality import only_good, train_quality

#: SQL can't express learnt scores, hashed trigrams or BPE.
ORACLE_SQL = None


#: Marks, in a column's metadata, the row number that the first stage gave.
MARK = {"docketry.pipeline_row": True}


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and its column's name, one that no other column has.

    Numbers are written, so that the files fix them; later stages find them by their mark, whatever columns there are.
    """
    held = [f.name for f in docs.schema.fields if f.metadata == MARK]
    if held:
        return docs, held[0]
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id().alias(name, metadata=MARK)), "pipeline-numbered"), name


def unmarked(docs: DataFrame) -> DataFrame:
    """Documents whose columns have no mark of an earlier run, which numbered other rows."""
    return docs.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={}) if f.metadata == MARK else F.col(f"`{f.name}`") for f in docs.schema.fields])


def without(docs: DataFrame, name: str, rejected: DataFrame) -> DataFrame:
    """Rows whose number isn't among ``rejected(row)``."""
    return docs.join(rejected.withColumnRenamed("row", name), name, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking predicts good."""
    docs = unmarked(docs)
    # written numbered, as later stages decide on rows: ids may repeat or be null
    return numbered(only_good(docs, train_quality(docs, table(spark, sf_dir, "labels"))))[0]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages known."""
    docs, row = numbered(docs)
    found = identify(documents_as_rows(docs, id_col=row), learn(docs))
    return without(docs, row, materialise(found.where("NOT accepted").select(F.col("id").alias("row")), "pipeline-rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words a shingle, similarity 0.8.

    That of the smallest id stays, ids before null and then the smallest digest of the text; rows of one id whose
    texts differ are apart.  Rows without words stay, but for those that repeat an id and text.
    """
    docs, row = numbered(docs)
    found = near_duplicates(docs, id_col=row).select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    number = F.col(f"`{row}`").alias("row")
    rank = docs.select(number, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", digest.alias("digest"), number).alias("rank"))
    # texts without words have no links: equal ones of one id are a group
    group = F.when(F.col("n_shingles") > 0, F.struct("component_id", F.lit(None).cast("long").alias("id"), F.lit("").alias("digest")))
    group = group.otherwise(F.struct(F.lit(None).cast("long").alias("component_id"), F.coalesce("rank.doc_id", "row").alias("id"), F.concat(F.col("rank.none").cast("string"), "rank.digest").alias("digest")))
    ranked = materialise(found.join(rank, "row").select("row", group.alias("group"), "rank"), "pipeline-ranked")
    first = ranked.groupBy("group").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialise(ranked.join(first, "group").where("row <> best.row").select("row"), "pipeline-copies")
    return without(docs, row, copies)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text decoded from them."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("ids", "decoded"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
