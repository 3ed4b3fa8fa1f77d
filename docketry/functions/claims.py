"""Claim references and claim starts in English claim text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.functions.text import collapse

# The phrasings that count as references.
PRECEDING = r"(?i)(?U)\bany\s+(?:(?:one\s+)?of\s+)?the\s+preceding\s+claims\b|(?i)(?U)\bany\s+preceding\s+claim\b"
LISTS = r"(?i)(?U)\bclaims?\s+([0-9]+(?:\s*(?:,|or|and|to|through|[-–—])\s*[0-9]+)*)"
TO = r"(?i)(?U)\s*(?:to|through|[-–—])\s*"
#: A range of more claims than this gives its ends alone.
SPAN = 200
MARK = "\x01"


def claim_refs(text: Column, claim_number: Column) -> Column:
    """Claims that a claim refers to, each once, in order of first mention.

    "preceding claim" stands for 1 to N - 1 and comes first; the claim itself and 0 are left out.  A null number
    turns both rules off.
    """
    none = F.array().cast("array<int>")
    before = F.when(claim_number.isNotNull() & text.rlike(PRECEDING) & (claim_number > 1), F.sequence(F.lit(1), claim_number.cast("int") - 1)).otherwise(none)
    # "1 to 3 or 5" becomes ranges "1-3" and single numbers "5"; a range takes the nearest two numbers from the left
    lists = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LISTS), F.lit(1))
    linked = F.transform(lists, lambda t: F.regexp_replace(t, TO, "-"))
    parts = F.flatten(F.transform(linked, lambda t: F.regexp_extract_all(t, F.lit(r"([0-9]+-[0-9]+|[0-9]+)"), F.lit(1))))

    def numbers(part: Column) -> Column:
        first = F.coalesce(F.regexp_extract(part, r"^([0-9]+)", 1).try_cast("int"), F.lit(0))
        last = F.regexp_extract(part, r"-([0-9]+)$", 1).try_cast("int")
        return F.when(last.isNull(), F.array(first)).when(last.between(first, first + SPAN), F.sequence(first, F.greatest(last, first))).otherwise(F.array(first, last))

    named = F.flatten(F.transform(parts, numbers))
    found = F.array_distinct(F.concat(before, named))
    return F.filter(found, lambda n: (n > 0) & ~F.coalesce(n == claim_number.cast("int"), F.lit(False)))


def _candidates(body: Column) -> Column:
    """The text with a mark before every number that may start a claim."""
    line = F.regexp_replace(body, r"(?m)^([ \t]*)([0-9]{1,4})(?=\.[ \t])", f"$1{MARK}$2")
    return F.regexp_replace(line, r"(?U)((?<=[\p{L})\]])\.)([0-9]{1,4})(?=\.[ \t])", f"$1{MARK}$2")


def split_claims(df: DataFrame, key: str, body: str, unnumbered: bool = False) -> DataFrame:
    """``key, number, text`` of the claims in a text that runs on; a text keeps its printed number, white space is made one space.

    Marks count only while their numbers rise; any other belongs to the claim it stands in.  With ``unnumbered`` a text
    without any mark is one row without number and text.
    """
    cut = df.select(F.col(key), F.split(_candidates(F.coalesce(F.col(body), F.lit(""))), MARK).alias("cut"))
    pieces = cut.select(F.col(key), (F.size("cut") == 1).alias("bare"), F.posexplode("cut").alias("piece", "text"))
    number = F.when(F.col("piece") > 0, F.regexp_extract("text", r"^([0-9]{1,4})\.", 1).try_cast("int"))
    earlier = W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(key).orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = pieces.withColumn("n", number).withColumn("most", F.max("n").over(earlier))
    # a number that doesn't exceed all before it, marks or not, exceeds no accepted one either
    starts = marked.withColumn("start", F.col("n").isNotNull() & F.coalesce(F.col("n") > F.col("most"), F.lit(True)))
    claims = starts.withColumn("number", F.max(F.when(F.col("start"), F.col("n"))).over(upto)).where("number IS NOT NULL OR bare" if unnumbered else "number IS NOT NULL")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda s: s["text"]), "")
    whole = claims.groupBy(key, "number").agg(text.alias("text"))
    return whole.select(key, "number", F.when(F.col("number").isNotNull(), collapse("text")).alias("text"))


def kept_marks(df: DataFrame, key: str, position: str, number: str) -> DataFrame:
    """Rows whose number exceeds all numbers before it in its group."""
    earlier = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_most", F.max(number).over(earlier)).where(F.col("_most").isNull() | (F.col(number) > F.col("_most"))).drop("_most")
