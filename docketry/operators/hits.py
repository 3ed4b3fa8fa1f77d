"""Search hits collapsed to families, and batches reconciled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.functions import pubnum
from docketry.functions.records import date_number
from docketry.functions.text import present


def family_key() -> Column:
    """The family, or the publication where a hit has none: unrelated hits don't meet under an empty key."""
    return F.when(present(F.col("family_id")), F.col("family_id")).otherwise(F.col("pub"))


def preference() -> Column:
    """Smaller is better: an abstract, the office, a later date, the input order."""
    office = pubnum.office_rank(pubnum.parse(F.col("pub"))["country"])
    return F.struct(F.when(present(F.col("abstract")), 0).otherwise(1).alias("bare"), office.alias("office"), (-date_number(F.col("publication_date"))).alias("older"), F.col("idx").alias("idx"))


def representatives(hits: DataFrame) -> DataFrame:
    """One row for each family: the hit to read.  Partial aggregates hold one hit, so no family gathers in a task."""
    best = F.min_by(F.struct("idx", "pub", "abstract", "publication_date", "query_id"), preference()).alias("r")
    return hits.groupBy(family_key().alias("family_key")).agg(best).select("family_key", "r.*")


def dedup_families(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Families in order of first appearance: ``family_id, first_idx, representative, members, query_ids[, known]``.

    ``hits`` has ``idx, pub, family_id, abstract, publication_date, query_id`` and any other columns, which the
    representative carries along.  Members keep input order and repeats; query ids are distinct, without nulls.
    A family keyed by a publication is never known.
    """
    row = F.struct(*[F.col(c) for c in hits.columns])
    in_order = F.sort_array(F.collect_list(F.struct("idx", "pub", "query_id")))
    out = hits.groupBy(family_key().alias("family_key")).agg(
        F.min("idx").alias("first_idx"),
        F.min_by(F.coalesce("family_id", F.lit("")), "idx").alias("family_id"),
        F.min_by(row, preference()).alias("representative"),
        in_order.alias("h"),
    )
    out = out.select(
        "family_key", "family_id", "first_idx", "representative",
        F.transform("h", lambda x: x["pub"]).alias("members"),
        F.array_distinct(F.array_compact(F.transform("h", lambda x: x["query_id"]))).alias("query_ids"),
    )
    if known is None:
        return out
    marks = known.select("family_id").where("family_id IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    return out.join(marks, "family_id", "left").withColumn("known", present(F.col("family_id")) & F.coalesce("_known", F.lit(False))).drop("_known")


def family_counts(hits: DataFrame, known: DataFrame) -> DataFrame:
    """How many families there are, and how many are new and known."""
    families = hits.groupBy(family_key().alias("family_key")).agg(F.min_by(F.coalesce("family_id", F.lit("")), "idx").alias("family_id"))
    marks = known.select("family_id").where("family_id IS NOT NULL").distinct().withColumn("k", F.lit(True))
    flag = present(F.col("family_id")) & F.coalesce("k", F.lit(False))
    return families.join(marks, "family_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(~flag).alias("new_count"), F.count_if(flag).alias("known_count"))


def page(hits: DataFrame, begin: int, end: int, most: int = 100, last: int = 2000) -> DataFrame:
    """Hits ``begin`` to ``end`` by ``idx``; ``most`` at once and none beyond ``last``."""
    if not 1 <= begin <= end or end > last or end - begin + 1 > most:
        raise ValueError(f"a page is 1 <= begin <= end <= {last}, of {most} hits at most")
    return hits.orderBy("idx").offset(begin - 1).limit(end - begin + 1)


def _keyed(df: DataFrame) -> DataFrame:
    p = pubnum.docdb(pubnum.parse(F.col("pub")))
    return df.select("idx", F.coalesce(p, F.col("pub")).alias("key"), p.isNotNull().alias("parsed"))


def verify_missing(given: DataFrame, got: DataFrame) -> DataFrame:
    """Input keys that the output lacks, with the place of the first one."""
    a, b = _keyed(given), _keyed(got)
    return a.groupBy("key").agg(F.min("idx").alias("first_idx")).join(b.select("key").distinct(), "key", "left_anti")


def verify_unexpected(given: DataFrame, got: DataFrame) -> DataFrame:
    return verify_missing(got, given)


def verify_duplicates(got: DataFrame) -> DataFrame:
    """Output keys that occur more than once."""
    return _keyed(got).groupBy("key").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n")).where("n > 1")


def verify_unparseable(given: DataFrame, got: DataFrame) -> DataFrame:
    """Texts that are no publication number, input first, each once with its first place."""
    both = _keyed(given).withColumn("side", F.lit(0)).unionByName(_keyed(got).withColumn("side", F.lit(1)))
    return both.where("NOT parsed").groupBy("key").agg(F.min(F.struct("side", "idx")).alias("at")).select("key", "at.side", "at.idx")


def verify_summary(given: DataFrame, got: DataFrame) -> DataFrame:
    """One row: counts, and whether nothing is missing, unexpected or repeated."""
    a = _keyed(given).groupBy("key").agg(F.count(F.lit(1)).alias("n_in"))
    b = _keyed(got).groupBy("key").agg(F.count(F.lit(1)).alias("n_out"))
    both = a.join(b, "key", "full").select(F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    sums = both.agg(
        F.coalesce(F.sum("n_in"), F.lit(0)).alias("input_count"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("output_count"),
        F.count_if(F.expr("n_out = 0")).alias("missing"), F.count_if(F.expr("n_in = 0")).alias("unexpected"), F.count_if(F.expr("n_out > 1")).alias("duplicates"),
    )
    return sums.withColumn("ok", F.expr("missing = 0 AND unexpected = 0 AND duplicates = 0"))


def verify_batch(given: DataFrame, got: DataFrame) -> DataFrame:
    """``problem, key, first_idx, n``: all lists of a verification in one pass, a row for each key and problem it has.

    ``missing`` and ``unexpected`` keys with their first place, ``duplicate`` keys of the output with how often they
    occur, ``unparseable`` texts of either side, the input's place first.  Nothing is wrong with a batch without rows.
    """
    both = _keyed(given).withColumn("out", F.lit(False)).unionByName(_keyed(got).withColumn("out", F.lit(True)))
    of = lambda c, side: F.when(F.col("out") == side, c)
    keys = both.groupBy("key").agg(F.count_if(~F.col("out")).alias("n_in"), F.count_if("out").alias("n_out"), F.min(of(F.col("idx"), False)).alias("first_in"), F.min(of(F.col("idx"), True)).alias("first_out"), F.bool_or(~F.col("parsed")).alias("odd"))
    problem = lambda condition, name, first, n: F.when(F.expr(condition), F.struct(F.lit(name).alias("problem"), F.col(first).alias("first_idx") if isinstance(first, str) else first.alias("first_idx"), F.col(n).alias("n")))
    found = F.array_compact(F.array(problem("n_out = 0", "missing", "first_in", "n_in"), problem("n_in = 0", "unexpected", "first_out", "n_out"), problem("n_out > 1", "duplicate", "first_out", "n_out"), problem("odd", "unparseable", F.coalesce("first_in", "first_out"), "n_out")))
    return keys.select("key", F.explode(found).alias("p")).select("p.problem", "key", "p.first_idx", F.when(F.col("p.problem") == "duplicate", F.col("p.n")).alias("n"))


def plan_check(totals: DataFrame, max_total: int | None = None) -> DataFrame:
    """``queries, errors, total_sum, exceeded`` from ``query, total, error``; a query with an error adds nothing."""
    out = totals.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("total"))), F.lit(0)).alias("total_sum"))
    return out.withColumn("exceeded", F.lit(False) if max_total is None else F.col("total_sum") > max_total)


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, with the place of its first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def batch_violations(items: DataFrame, max_items: int = 10_000, max_chars: int = 4096, max_total: int = 4 * 1024 * 1024) -> DataFrame:
    """The first violation of each limit on ``idx, item``: too many items, an item too long, too much together.

    Limits are inclusive.  The running total needs one order over all items: it is added up by stretches of
    10 000 first, so only the stretch that passes the limit is looked at row by row.
    """
    sized = items.select("idx", F.length(F.coalesce("item", F.lit(""))).cast("long").alias("chars"))
    single = sized.where(F.col("chars") > max_chars).agg(F.min("idx").alias("idx")).select(F.lit("item_chars").alias("rule"), "idx")
    count = sized.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_items).select(F.lit("item_count").alias("rule"), F.lit(None).cast("long").alias("idx"))
    stretch = sized.withColumn("s", F.floor(F.col("idx") / 10_000))
    sums = stretch.groupBy("s").agg(F.sum("chars").alias("chars"))
    before = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("s", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("before"), "chars").where((F.col("before") <= max_total) & (F.col("before") + F.col("chars") > max_total)).drop("chars")
    running = stretch.join(F.broadcast(offsets), "s").withColumn("upto", F.col("before") + F.sum("chars").over(W.partitionBy("s").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)))
    total = running.where(F.col("upto") > max_total).agg(F.min("idx").alias("idx")).select(F.lit("total_chars").alias("rule"), "idx")
    return count.unionByName(single.where("idx IS NOT NULL")).unionByName(total.where("idx IS NOT NULL"))


def query_problem(query: Column, most: int = 4000) -> Column:
    """Why a search query is refused, or null."""
    return F.when(query.isNull() | ~query.rlike(r"(?U)\S"), "blank").when(F.length(query) > most, "too long").when(query.rlike(r"[\x00-\x1F\x7F]"), "control character")


def watch_list_problems(pubs: DataFrame, most: int = 25) -> DataFrame:
    """``idx, pub, problem`` of a watch list: entries that are unparseable or repeat an earlier one.

    A list of more than ``most`` entries, or of none, has a row of its own without a publication.
    """
    p = pubnum.docdb(pubnum.parse(F.col("pub")))
    nth = F.row_number().over(W.partitionBy("key").orderBy("idx"))
    out = pubs.select("idx", "pub", F.coalesce(p, F.col("pub")).alias("key"), p.isNotNull().alias("parsed")).withColumn("nth", nth)
    own = out.select("idx", "pub", F.when(~F.col("parsed"), "unparseable").when(F.col("nth") > 1, "repeated").alias("problem")).where("problem IS NOT NULL")
    size = pubs.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) | (F.col("n") == 0))
    return own.unionByName(size.select(F.lit(most).cast("long").alias("idx"), F.lit(None).cast("string").alias("pub"), F.when(F.col("n") == 0, "empty").otherwise("too many").alias("problem")))


def item_problems(items: DataFrame, max_chars: int = 4096) -> DataFrame:
    """``idx, problem`` of batch items ``idx, v``: texts or objects with a text ``pub``; an object's size is that of its JSON."""
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    pub = F.schema_of_variant(F.try_variant_get("v", "$.pub", "variant"))
    size = F.when(kind == "STRING", F.length(F.try_variant_get("v", "$", "string"))).otherwise(F.length(F.to_json("v")))
    shape = F.when((kind != "STRING") & ~kind.like("OBJECT%"), "not a text or object").when((kind != "STRING") & pub.isNull(), "no pub").when((kind != "STRING") & (pub != "STRING"), "pub is no text")
    return items.select("idx", F.coalesce(shape, F.when(size > max_chars, "too long")).alias("problem")).where("problem IS NOT NULL")


def query_list_problems(queries: DataFrame, most: int = 50) -> DataFrame:
    """``idx, problem`` of a search plan ``idx, query``: each refused query, and a row without a place for none or more than ``most``."""
    own = queries.select("idx", query_problem(F.col("query")).alias("problem")).where("problem IS NOT NULL")
    size = queries.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) | (F.col("n") == 0))
    return own.unionByName(size.select(F.lit(None).cast(queries.schema["idx"].dataType).alias("idx"), F.when(F.col("n") == 0, "empty").otherwise("too many").alias("problem")))


def pub_problem(pub: Column) -> Column:
    """Why a publication number is refused, or null."""
    return F.when(pub.isNull() | ~pub.rlike(r"(?U)\S"), "blank").when(pub.rlike(r"[\x00-\x1F\x7F]"), "control character").when(pubnum.parse(pub).isNull(), "unparseable")
