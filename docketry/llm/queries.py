"""One thin query for each operator, over whole tables; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import bpe_encode
from docketry.llm.chat import BREAK, CONTROLS, END, TEXT, TURN, conversation_digests
from docketry.llm.codes import compress_vectors
from docketry.llm.common import new_path, table
from docketry.llm.decontam import find_leaks
from docketry.llm.exactdup import exact_groups
from docketry.llm.images import image_copies, media_of
from docketry.llm.langid import documents_as_rows, identify, learn, pages_as_rows
from docketry.llm.mainext import extract_main_text
from docketry.llm.neardup import near_duplicates
from docketry.llm.quality import score_quality, train_quality
from docketry.llm.sharding import feistel_shards
from docketry.llm.warc import read_archives, resolve_revisits, write_archives
from docketry.llm.whitening import whiten


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards by the Feistel permutation."""
    return feistel_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that leaked into any document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back, and their revisits resolved."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=100)
    return resolve_revisits(read_archives(spark, path, keep_payload=False)).drop("url")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by 2-word shingle sets alike in 80 % or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of both."""
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{probe}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{probe}'")
    return conversation_digests(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")).drop("n_tokens", "loss_tokens")


def op8_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all embeddings and edited copies of some: which show the same."""
    return image_copies(media_of(table(spark, sf_dir, "embeddings")))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: language, probability, and whether it is accepted."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    by_doc = identify(documents_as_rows(docs), model)
    by_page = identify(pages_as_rows(table(spark, sf_dir, "pages")), model)
    none = F.lit(None).cast("long")
    return by_doc.select(F.col("id").alias("doc_id"), none.alias("page_id"), "lang", "probability", "accepted").unionByName(
        by_page.select(none.alias("doc_id"), F.col("id").alias("page_id"), "lang", "probability", "accepted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the ranking learnt from labelled pairs."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings as codes of 16 parts, with their errors."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.drop("label").withColumn("codebooks_sha256", F.lit(books.digest()))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings, whitened along eight components; a deviation too large for a long is null."""
    white, m, c, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(e) / c.trace) for e in c.values]).cast("array<double>")
    rows = white.select("vec_id", F.lit(m.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by their text without white space, and the one of each group that stays."""
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("text_digest", "text_sha256").drop("n_chars")


def _escaped_sql(column: str) -> str:
    """The template's escapes in SQL.  No control string begins inside another, so one may follow the other."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _assign_sql(r: int) -> str:
    """CTE ``a{r}``: the nearest entry of codebook ``b{r}`` for every part."""
    return f"""a{r} AS MATERIALIZED (SELECT vec_id, p, x, j, d FROM (SELECT v.vec_id, v.p, x, j, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
                row_number() OVER (PARTITION BY v.vec_id, v.p ORDER BY d, j) AS nth FROM v JOIN b{r} USING (p)) WHERE nth = 1)"""


def _lloyd_sql(r: int) -> str:
    """CTEs ``a{r}`` and ``b{r + 1}``: assignment, then entries moved to the floored mean."""
    return f"""{_assign_sql(r)},
        m{r} AS (SELECT p, j, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, j, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL),
        b{r + 1} AS MATERIALIZED (SELECT p, j, coalesce(c1, c) AS c FROM b{r} LEFT JOIN (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c1 FROM m{r} GROUP BY ALL) USING (p, j))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontam": op2_decontam,
    "op3_warc": op3_warc,
    "op4_minhash": op4_minhash,
    "op5_html": op5_html,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_images": op8_images,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
    "op11_codes": op11_codes,
    "op12_whitening": op12_whitening,
    "op13_exact": op13_exact,
}

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
                     CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op4_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
                     ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
              JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id""",
    "op7_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('{TURN}') + length(replace({_escaped_sql("role")}, chr(10), '{BREAK}')) + length('{TEXT}') + length({_escaped_sql("text")}) + length('{END}')) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op11_codes": f"""
        WITH RECURSIVE e AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        parts AS (SELECT range AS p FROM range(16)), v AS MATERIALIZED (SELECT vec_id, p, list_transform(embedding[1 + p * len(embedding) // 16 : (p + 1) * len(embedding) // 16], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e, parts),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
        {_lloyd_sql(0)}, {_lloyd_sql(1)}, {_assign_sql(2)},
        s AS (SELECT a.vec_id, label, string_agg(printf('%02x', CAST(j AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 a JOIN e ON e.vec_id = a.vec_id GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b2) AS codebooks_sha256 FROM s""",
    "op13_exact": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
        r AS (SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM r""",
}
