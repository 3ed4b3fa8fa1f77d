"""Claims of publications from raw bodies: the page, else full text, else none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.pubnum import docdb, parse
from docketry.operators.cache_views import claims_with_fallback
from docketry.sources import html, xml

CLAIMS = "array<struct<number: int, text: string, depends_on: array<int>>>"


def claims_of(pubs: DataFrame, pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``pub, claims, source, error`` of ``pubs(pub)`` from ``pages(pub, body)`` and full-text ``bodies(pub, body)``.

    Publications meet by their DOCDB spelling.  A page without a publication number or claims falls back to full text,
    which EP and WO offices alone have; ``error`` says that a body was there and couldn't be used.
    """
    key = lambda df: df.select(docdb(parse(F.col("pub"))).alias("pub"), "body").where("pub IS NOT NULL")
    page = html.patent_pages(key(pages)).select(F.col("requested").alias("pub"), F.col("claims").cast(CLAIMS).alias("claims"), "error")
    row = F.struct("number", "text", "depends_on")
    text = xml.claims(key(bodies)).groupBy("pub").agg(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), row))).cast(CLAIMS).alias("claims"), F.max("error").alias("error"))
    some = lambda df: df.where("error IS NULL AND size(claims) > 0").select("pub", "claims")
    parsed = parse(F.col("pub"))
    asked = pubs.select(docdb(parsed).alias("pub"), parsed["country"].alias("country")).where("pub IS NOT NULL").distinct()
    found = claims_with_fallback(asked, some(page), some(text))
    bad = page.where("error IS NOT NULL").select("pub", "error").unionByName(text.where("error IS NOT NULL").select("pub", "error")).groupBy("pub").agg(F.max("error").alias("error"))
    return found.join(bad, "pub", "left").select("pub", "claims", "source", F.when(F.col("source") == "unavailable", F.col("error")).alias("error"))
