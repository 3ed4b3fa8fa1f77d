"""Stored raw documents: freshness, inventory, selection and lookup with fallbacks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.pubnum import full_text_office
from docketry.functions.records import LIFETIMES, PUB_KINDS, has_kind_code, instant


def effective_hours(kind: Column, key: Column, lifetimes: dict[str, int | None] = LIFETIMES) -> Column:
    """Lifetime in hours, null for never; a publication kind that never expires takes the family's where the key has no kind code."""
    pairs = [(F.lit(k), F.lit(v).cast("int")) for k, v in lifetimes.items()]
    own = F.try_element_at(F.create_map(*chain.from_iterable(pairs)), kind)
    family = F.lit(lifetimes["family"]).cast("int")
    return F.when(own.isNull() & kind.isin(*PUB_KINDS) & key.isNotNull() & ~has_kind_code(key), family).otherwise(own)


def is_fresh(kind: Column, key: Column, fetched_at: Column, now: Column, lifetimes: dict[str, int | None] = LIFETIMES) -> Column:
    """Fresh strictly before the deadline; an unreadable time is never fresh."""
    at, hours = instant(fetched_at), effective_hours(kind, key, lifetimes)
    return F.when(at.isNull(), False).when(hours.isNull(), True).otherwise(F.timestamp_seconds(F.unix_seconds(at) + hours * 3600) > now)


def problem() -> Column:
    """What is wrong with an entry of ``has_body, has_meta, meta_ok, size, meta_size``, or null."""
    return (
        F.when(~F.col("has_body") & F.col("has_meta"), "missing body").when(~F.col("has_body"), "stray tmp file").when(~F.col("has_meta"), "missing sidecar").when(~F.col("meta_ok"), "unreadable sidecar")
        .when(F.col("meta_size").isNotNull() & (F.col("meta_size") != F.col("size")), "size mismatch")
    )


def entries(listing: DataFrame, now: Column, lifetimes: dict[str, int | None] = LIFETIMES) -> DataFrame:
    """``listing`` with ``problem, broken, expired``; a broken entry isn't expired."""
    out = listing.withColumn("problem", problem()).withColumn("broken", F.col("problem").isNotNull())
    fresh = is_fresh(F.col("kind"), F.col("key"), F.when(F.col("has_meta") & F.col("meta_ok"), F.col("fetched_at")), now, lifetimes)
    return out.withColumn("expired", ~F.col("broken") & ~fresh)


def join_listings(bodies: DataFrame, sidecars: DataFrame, temporary: DataFrame) -> DataFrame:
    """One row for each kind and key that any of the three listings has.

    ``bodies(kind, key, size)``, ``sidecars(kind, key, fetched_at, meta_size, meta_ok)``, ``temporary(kind, key)``.
    """
    pad = lambda df, **flags: df.select("kind", "key", *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in (("size", "long"), ("fetched_at", "string"), ("meta_size", "long"), ("meta_ok", "boolean"))], *[F.lit(v).alias(k) for k, v in flags.items()])
    rows = pad(bodies, body=True, meta=False).unionByName(pad(sidecars, body=False, meta=True)).unionByName(pad(temporary, body=False, meta=False))
    any_of = lambda c: F.max(c).alias(c)
    out = rows.groupBy("kind", "key").agg(F.max("body").alias("has_body"), F.max("meta").alias("has_meta"), *map(any_of, ("size", "fetched_at", "meta_size", "meta_ok")))
    return out.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("meta_ok", F.coalesce("meta_ok", F.lit(False)))


def stats(inventory: DataFrame, kinds: tuple[str, ...] = tuple(LIFETIMES)) -> DataFrame:
    """Figures for each kind, zero for kinds without entries; oldest and newest are the smallest and largest text."""
    coded = F.col("kind").isin(*PUB_KINDS) & ~has_kind_code(F.col("key"))
    sums = inventory.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"), F.count_if(F.expr("expired")).alias("expired"), F.count_if(F.expr("broken")).alias("broken"),
        F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"), F.count_if(coded).alias("no_kind_code"), F.count_if(coded & F.col("expired")).alias("no_kind_code_expired"),
    )
    spark = inventory.sparkSession
    dimension = F.broadcast(spark.createDataFrame([(k,) for k in kinds], "kind string"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "bytes", "expired", "broken")]
    return dimension.join(sums, "kind", "left").select("kind", *zero, "oldest", "newest", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("no_kind_code", "no_kind_code_expired")])


def totals(by_kind: DataFrame) -> DataFrame:
    return by_kind.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", "bytes", "expired", "broken")])


def select(inventory: DataFrame, now: Column, kinds: list[str] | None = None, older_hours: int | None = None, pub: str | None = None, expired: bool = False, broken: bool = False) -> DataFrame:
    """Entries that meet all conditions given; ``expired`` and ``broken`` together mean either.  An age is inclusive."""
    out = inventory
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    if pub is not None:
        out = out.where(F.col("kind").isin(*PUB_KINDS) & (F.col("key") == pub))
    if older_hours is not None:
        out = out.where(F.timestamp_seconds(F.unix_seconds(instant(F.col("fetched_at"))) + older_hours * 3600) <= now)
    if expired and broken:
        return out.where("expired OR broken")
    return out.where("expired") if expired else out.where("broken") if broken else out


def latest(raw: DataFrame) -> DataFrame:
    """The row written last for each kind and key of an append-only table ``kind, key, fetched_at, seq, body``."""
    return raw.groupBy("kind", "key").agg(F.max_by(F.struct("fetched_at", "body"), "seq").alias("r")).select("kind", "key", "r.*")


def evict(raw: DataFrame, now: Column, kinds: tuple[str, ...] = ("search", "searchbib")) -> DataFrame:
    """The table without rows of the given kinds whose lifetime is over."""
    return raw.where(~F.col("kind").isin(*kinds) | is_fresh(F.col("kind"), F.col("key"), F.col("fetched_at"), now))


def lookup(pubs: DataFrame, stored: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``pubs(docdb, alternate)`` with the body stored under the number, or else under its alternate spelling.

    ``stored(key, body)`` has one body for each key.  With several stores in one table, both sides carry the columns
    ``within`` that tell them apart: a number is looked up in its own store alone, and keys are unique within each.
    """
    body = stored.select(*within, "key", "body")
    hit = pubs.join(body.select(*within, F.col("key").alias("docdb"), F.col("body").alias("b1")), [*within, "docdb"], "left")
    # numbers without an alternate spelling are looked for once more as they are, as null keys would all meet in one task
    hit = hit.withColumn("second", F.coalesce("alternate", "docdb"))
    hit = hit.join(body.select(*within, F.col("key").alias("second"), F.col("body").alias("b2")), [*within, "second"], "left")
    return hit.select(*within, "docdb", "alternate", F.coalesce("b1", "b2").alias("body"), F.when(F.col("b1").isNotNull(), F.col("docdb")).when(F.col("b2").isNotNull(), F.col("alternate")).alias("found_as"))


def legal_with_fallback(legal: DataFrame, pubs: DataFrame) -> DataFrame:
    """Legal events by publication ``pub, events``: a GB A-document without any takes those of the same number with kind B."""
    b = legal.where(F.col("pub").rlike(r"^GB\..*\.B$")).select(F.col("pub").alias("b_key"), F.col("events").alias("b_events"))
    own = pubs.select("pub").join(legal, "pub", "left").withColumn("b_key", F.when(F.col("pub").rlike(r"^GB\..*\.A[0-9]?$"), F.regexp_replace("pub", r"\.A[0-9]?$", ".B")))
    # rows without a B-document get a key that none has, each its own: null keys would all meet in one task
    out = own.withColumn("asked", F.coalesce("b_key", F.concat(F.lit(" "), "pub"))).join(b.withColumnRenamed("b_key", "asked"), "asked", "left")
    swap = F.col("b_key").isNotNull() & (F.coalesce(F.size("events"), F.lit(0)) <= 0) & (F.coalesce(F.size("b_events"), F.lit(0)) > 0)
    return out.select("pub", F.when(swap, F.col("b_events")).otherwise(F.col("events")).alias("events"), swap.alias("from_b"))


def claims_with_fallback(pubs: DataFrame, page_claims: DataFrame, full_text: DataFrame) -> DataFrame:
    """Claims of ``pubs(pub, country)``: from the page, else for EP and WO from full text, else none."""
    out = pubs.join(page_claims.select("pub", F.col("claims").alias("c1")), "pub", "left").join(full_text.select("pub", F.col("claims").alias("c2")), "pub", "left")
    second = F.when(full_text_office(F.col("country")), F.col("c2"))
    return out.select("pub", F.coalesce("c1", second).alias("claims"), F.when(F.col("c1").isNotNull(), "page").when(second.isNotNull(), "full text").otherwise("unavailable").alias("source"))
