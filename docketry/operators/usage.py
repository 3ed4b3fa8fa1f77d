"""Request logs summarised, and what throttling headers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import records

STATES = ("idle", "busy", "overloaded")


def since(log: DataFrame, bound: Column) -> DataFrame:
    """Lines at or after ``bound``; undated lines are left out (``usage_totals`` counts them)."""
    return log.where(F.col("at") >= bound)


def by_column(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def system_states(log: DataFrame) -> DataFrame:
    state, _ = records.throttling(F.col("throttling"))
    return log.select(state.alias("state")).where(F.col("state").isin(*STATES)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def usage_totals(log: DataFrame, today: Column) -> DataFrame:
    """One row over ``line_no, at, kind, status, throttling``; first and last go by line, not by time."""
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(records.non_green(F.col("throttling"))).alias("non_green_events"),
        F.min_by("at", "line_no").alias("first_at"), F.max_by("at", "line_no").alias("last_at"),
        F.count_if(F.to_date("at") == today).alias("today_requests"), F.count_if(F.col("at").isNull()).alias("undated_lines"),
    )


def usage_report(log: DataFrame, today: Column, bound: Column | None = None) -> DataFrame:
    """One row: counts by kind, status and system state as maps, first and last line, today's requests, and lines that count nowhere.

    ``log`` is that of ``typed_log``; lines that are no objects are ``skipped_lines``.  With a bound, lines before it
    are left out and lines without a readable time are ``undated_lines``.
    """
    line = ~F.col("skipped")
    at = records.instant(F.col("at"))
    undated = line & at.isNull() if bound is not None else F.lit(False)
    counted = line & (F.coalesce(at >= bound, F.lit(False)) if bound is not None else F.lit(True))
    state, _ = records.throttling(F.col("throttling"))
    rows = log.select("line_no", "at", "kind", "status", "skipped", undated.alias("undated"), counted.alias("counted"), F.when(state.isin(*STATES), state).alias("state"), records.non_green(F.col("throttling")).alias("alarm"), (F.to_date(at) == today).alias("now"))
    # one pass counts each combination; the maps are sums over its few rows
    few = rows.groupBy("kind", "status", "state", "skipped", "undated", "counted", "now").agg(F.count(F.lit(1)).alias("n"), F.count_if("alarm").alias("alarms"), F.min_by("at", "line_no").alias("first"), F.min("line_no").alias("low"), F.max_by("at", "line_no").alias("last"), F.max("line_no").alias("high"))

    # each combination counts towards some maps and some totals: entries of all of them are one aggregation
    entry = lambda name, k, n, condition: F.when(F.expr(condition), F.struct(F.lit(name).alias("name"), k.alias("k"), n.alias("n")))
    maps = {"by_kind": ("kind", "counted"), "by_status": ("status", "counted"), "system_states": ("state", "counted AND state IS NOT NULL"), "today_by_kind": ("kind", "counted AND now")}
    totals = {"total_requests": ("n", "counted"), "non_green_events": ("alarms", "counted"), "today_requests": ("n", "counted AND now"), "skipped_lines": ("n", "skipped"), "undated_lines": ("n", "undated")}
    entries = [entry(name, F.col(k), F.col("n"), condition) for name, (k, condition) in maps.items()] + [entry(name, F.lit(""), F.col(n), condition) for name, (n, condition) in totals.items()]
    each = few.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), *["low", "first", "high", "last"])
    sums = each.groupBy("e.name", "e.k").agg(F.sum("e.n").alias("n"), F.min_by("first", "low").alias("first"), F.min("low").alias("low"), F.max_by("last", "high").alias("last"), F.max("high").alias("high"))
    of = lambda name: F.col("name") == name
    map_ = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.when(of(name), F.struct("k", "n"))))).alias(name)
    counted = of("total_requests")
    return sums.agg(
        *[F.coalesce(F.sum(F.when(of(name), F.col("n"))), F.lit(0)).alias(name) for name in totals], F.coalesce(F.min_by("first", F.when(counted, F.col("low"))), F.lit("")).alias("first_at"),
        F.coalesce(F.max_by("last", F.when(counted, F.col("high"))), F.lit("")).alias("last_at"), *[map_(name) for name in maps],
    )


def services(log: DataFrame) -> DataFrame:
    """One row for each service that a line's header names."""
    _, entries = records.throttling(F.col("throttling"))
    rows = log.select("line_no", F.explode(entries).alias("e"))
    return rows.select("line_no", "e.service", "e.colour", F.col("e.limit").try_cast("int").alias("limit"))


def throttle_reaction(log: DataFrame) -> DataFrame:
    """What a line's header asks of its own service: rest seconds, least interval, and seconds blocked.

    Needs ``line_no, service, status, throttling``.  A colour other than green rests the service; an overloaded
    system stretches its interval to 60 seconds over the limit; a refusal, or black, blocks it.
    """
    state, entries = records.throttling(F.col("throttling"))
    base = F.coalesce(*[F.when(F.col("service") == k, F.lit(float(v))) for k, v in records.INTERVALS.items()], F.lit(1.0))
    own = F.get(F.filter(entries, lambda e: e["service"] == F.col("service")), F.lit(0))
    limit = own["limit"].try_cast("double")
    return log.select(
        "line_no", "service",
        F.when(own["colour"].isNotNull() & (own["colour"] != "green"), records.REST).otherwise(0).alias("rest_seconds"),
        F.when((state == "overloaded") & (limit > 0), F.greatest(base, 60 / limit)).otherwise(base).alias("interval_seconds"),
        F.when((F.col("status") == 403) | F.coalesce(own["colour"] == "black", F.lit(False)), records.BLOCKED).otherwise(0).alias("blocked_seconds"),
    )
