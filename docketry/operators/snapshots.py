"""Snapshots of legal status and family, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.functions.pubnum import docdb, key_or_raw, parse
from docketry.functions.records import event_key, gazette_date

FORMAT = 1


def keyed(events: DataFrame) -> DataFrame:
    """``events(pub, pos, gazette_date, code, desc, pre_lines)`` with the event's ``key``."""
    return events.withColumn("key", event_key(F.col("gazette_date"), F.col("code"), F.col("desc"), F.col("pre_lines")))


def reported(events: DataFrame) -> DataFrame:
    """Event rows as one row for each publication, ``pub, events``, in reported order."""
    full = F.struct("code", "desc", "gazette_date", "pre_lines").alias("event")
    rows = events.select("pub", "pos", full).groupBy("pub").agg(F.array_sort(F.collect_list(F.struct("pos", "event"))).alias("rows"))
    return rows.select("pub", F.transform("rows", lambda r: r["event"]).alias("events"))


def _key(event: Column) -> Column:
    return event_key(event["gazette_date"], event["code"], event["desc"], event["pre_lines"])


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _paired(legal: DataFrame, family: DataFrame) -> DataFrame:
    """Legal status and family of each publication in one row; a half that wasn't read is empty."""
    note = F.col("note").cast("string") if "note" in legal.columns else F.lit(None).cast("string")
    left = legal.select("pub", F.col("fetched_at").alias("legal_at"), _or_empty(F.col("events"), legal.schema["events"].dataType.simpleString()).alias("events"), note.alias("note"))
    right = family.select("pub", F.col("fetched_at").alias("family_at"), "family_id", F.filter("members", lambda m: m.isNotNull()).alias("members"))
    rows = left.join(right, "pub", "full")
    return rows.withColumn("members", _or_empty(F.col("members"), "array<string>")).withColumn("events", _or_empty(F.col("events"), left.schema["events"].dataType.simpleString()))


def _snapshot(keys: Column) -> Column:
    status = F.struct(F.col("legal_at").alias("fetched_at"), F.size(keys).alias("event_count"), F.array_sort(keys).alias("events"), "note")
    kin = F.struct(F.col("family_at").alias("fetched_at"), "family_id", F.array_sort("members").alias("members"))
    return F.struct("pub", F.lit(FORMAT).alias("snapshot_format"), status.alias("legal"), kin.alias("family"))


def build_snapshot(legal: DataFrame, family: DataFrame) -> DataFrame:
    """``pub, snapshot`` from ``legal(pub, fetched_at, events[, note])`` and ``family(pub, fetched_at, family_id, members)``.

    A snapshot holds sorted event keys and sorted members, repeats kept, so that what was reported in another order is
    the same record.  ``to_json`` of it is what a ledger stores; it leaves out a note that is null.
    """
    return _paired(legal, family).select("pub", _snapshot(F.transform("events", _key)).alias("snapshot"))


def _text(v: Column, path: str = "$") -> Column:
    """The text at a place of a variant, null for a value of any other type."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _object(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).like("OBJECT%"), F.lit(False))


def index_previous(previous: DataFrame) -> DataFrame:
    """Stored snapshots ``idx, v`` read back: ``idx, key, problem, fetched_at, family_at, family_id, members, keys``.

    ``key`` is the publication's DOCDB spelling, ``keys`` the stored events as arrays of text: an entry that is no list,
    or an empty one, doesn't count, and a part that is no text is read as empty.  ``problem`` says why a snapshot can't
    be used: it is no object, or its publication, format or a section is missing or wrong, or it repeats another's.
    """
    v, pub = F.col("v"), _text(F.col("v"), "$.pub")
    key, form = docdb(parse(pub)), F.try_variant_get(v, "$.snapshot_format", "variant")
    fits = F.coalesce(F.schema_of_variant(form).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (form.try_cast("double") == FORMAT), F.lit(False))
    own = F.when(~_object(v, "$") | v.isNull(), "no object").when(F.try_variant_get(v, "$.pub", "variant").isNull(), "pub missing").when(pub.isNull(), "pub is no text").when(key.isNull(), "pub unparseable")
    own = own.when(~fits, "format").when(~_object(v, "$.legal"), "legal").when(~_object(v, "$.family"), "family")
    rows = previous.select("idx", "v", key.alias("key"), own.alias("own"))
    nth = F.row_number().over(W.partitionBy("key", F.col("own").isNull()).orderBy("idx"))
    rows = rows.withColumn("problem", F.when(F.col("own").isNotNull(), F.col("own")).when(nth > 1, "repeated"))
    # a stored id of another type than text is no family's id: the text of its JSON, which no office gives, differs from all
    id_ = F.coalesce(_text(v, "$.family.family_id"), F.concat(F.lit("\x00"), F.to_json(F.try_variant_get(v, "$.family.family_id", "variant"))))
    list_ = lambda c, path: _or_empty(F.try_variant_get(c, path, "array<variant>"), "array<variant>")
    parts = F.transform(list_(v, "$.legal.events"), lambda k: F.transform(list_(k, "$"), lambda p: F.coalesce(_text(p), F.lit(""))))
    members = F.filter(F.transform(list_(v, "$.family.members"), lambda m: _text(m)), lambda m: m.isNotNull())
    return rows.select("idx", "key", "problem", _text(v, "$.legal.fetched_at").alias("fetched_at"), _text(v, "$.family.fetched_at").alias("family_at"), id_.alias("family_id"), members.alias("members"), F.filter(parts, lambda k: F.size(k) > 0).alias("keys"))


def _unmatched(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``key, new_events, missing_events``: what each side of two multisets of events has more often than the other.

    One shuffle by publication and event, on which all counts are windows; only differences are gathered by publication.
    """
    now = current.select("key", F.posexplode("events").alias("pos", "event")).withColumn("k", _key(F.col("event")))
    was = stored.select("key", F.posexplode("keys").alias("pos", "k"))
    rows = now.withColumn("was", F.lit(False)).unionByName(was.withColumn("was", F.lit(True)), allowMissingColumns=True)
    same = W.partitionBy("key", "k")
    nth = F.row_number().over(W.partitionBy("key", "k", "was").orderBy("pos"))
    rows = rows.withColumn("n_was", F.count_if("was").over(same)).withColumn("n_now", F.count_if(~F.col("was")).over(same)).withColumn("nth", nth)
    left = rows.where("nth > CASE WHEN was THEN n_now ELSE n_was END")
    found = left.groupBy("key").agg(F.array_sort(F.collect_list(F.when(~F.col("was"), F.struct("pos", "event")))).alias("new"), F.array_sort(F.collect_list(F.when(F.col("was"), F.col("k")))).alias("missing_events"))
    return found.select("key", F.transform("new", lambda r: r["event"]).alias("new_events"), "missing_events")


def diff_snapshots(legal: DataFrame, family: DataFrame, previous: DataFrame, since: Column | None = None) -> DataFrame:
    """What changed against stored snapshots ``previous(idx, v)``: ``pub, changed, first_snapshot, legal, family, snapshot``.

    Publications meet by their DOCDB spelling; stored snapshots with a problem are left out.  New events come in full,
    in reported order, the later occurrences of a repeated one; missing ones as sorted keys.  Without a stored snapshot
    nothing is compared.  With ``since``, ``legal`` also has the events dated on or after it and how many have no date.
    """
    now = _paired(legal, family).withColumn("key", key_or_raw(F.col("pub")))
    was = index_previous(previous).where("problem IS NULL")
    told = was.select("key", F.col("fetched_at").alias("legal_was"), F.col("family_at").alias("family_was"), F.col("family_id").alias("id_was"), F.col("members").alias("members_were"), F.lit(True).alias("known"))
    rows = now.join(told, "key", "left").join(_unmatched(now.join(was.select("key"), "key", "left_semi"), was), "key", "left")
    known, kind = F.coalesce("known", F.lit(False)), now.schema["events"].dataType.simpleString()
    fresh, gone = _or_empty(F.col("new_events"), kind), _or_empty(F.col("missing_events"), "array<array<string>>")
    differ = lambda a, b: F.array_sort(F.when(known, F.array_except(a, b)).otherwise(F.array().cast("array<string>")))
    moved = F.when(known & ~F.col("id_was").eqNullSafe(F.col("family_id")), F.struct(F.regexp_replace("id_was", "^\\x00", "").alias("from"), F.col("family_id").alias("to")))
    status = [F.col("legal_at").alias("fetched_at"), F.col("legal_was").alias("previous_fetched_at"), fresh.alias("new_events"), gone.alias("missing_events")]
    if since is not None:
        dated = lambda e: gazette_date(e["gazette_date"])
        status += [F.filter("events", lambda e: dated(e) >= since).alias("events_since"), F.size(F.filter("events", lambda e: dated(e).isNull())).alias("undated_events")]
    kin = F.struct(F.col("family_at").alias("fetched_at"), F.col("family_was").alias("previous_fetched_at"), differ("members", "members_were").alias("new_members"), differ("members_were", "members").alias("missing_members"), moved.alias("family_id_changed"))
    out = rows.select("key", "pub", (~known).alias("first_snapshot"), F.struct(*status).alias("legal"), kin.alias("family"), _snapshot(F.transform("events", _key)).alias("snapshot"))
    changed = F.expr("size(legal.new_events) + size(legal.missing_events) + size(family.new_members) + size(family.missing_members) > 0 OR family.family_id_changed IS NOT NULL")
    return out.select("key", "pub", changed.alias("changed"), "first_snapshot", "legal", "family", "snapshot")


def event_counts(events: DataFrame) -> DataFrame:
    return keyed(events).groupBy("pub", "key").agg(F.count(F.lit(1)).alias("n"))


def new_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that ``after`` reports more often than ``before`` did, in full: the later occurrences in reported order."""
    nth = F.row_number().over(W.partitionBy("pub", "key").orderBy("pos"))
    counted = event_counts(before).withColumnRenamed("n", "stored")
    return keyed(after).withColumn("nth", nth).join(counted, ["pub", "key"], "left").where(F.col("nth") > F.coalesce("stored", F.lit(0))).drop("nth", "stored")


def missing_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that ``before`` had more often, one row for each occurrence that is gone."""
    now = event_counts(after).withColumnRenamed("n", "seen")
    left = event_counts(before).join(now, ["pub", "key"], "left").withColumn("gone", F.col("n") - F.coalesce("seen", F.lit(0))).where("gone > 0")
    return left.select("pub", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("gone"))).alias("nth"))


def member_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``pub, member, change``: members added and removed, for publications that have a snapshot."""
    known = before.select("pub").distinct()
    a, b = before.select("pub", "member").distinct(), after.select("pub", "member").distinct()
    added = b.join(known, "pub", "left_semi").join(a, ["pub", "member"], "left_anti").withColumn("change", F.lit("new"))
    return added.unionByName(a.join(after.select("pub").distinct(), "pub", "left_semi").join(b, ["pub", "member"], "left_anti").withColumn("change", F.lit("missing")))


def changes(pubs: DataFrame, before_events: DataFrame, after_events: DataFrame, before_members: DataFrame, after_members: DataFrame, before_family: DataFrame, after_family: DataFrame) -> DataFrame:
    """One row for each publication of ``pubs(pub, stored)``: counts of each change, and whether there is any.

    ``stored`` says that there is an earlier snapshot; without one nothing is compared.
    """
    count = lambda df, name: df.groupBy("pub").agg(F.count(F.lit(1)).alias(name))
    members = member_changes(before_members, after_members).groupBy("pub").agg(F.count_if(F.expr("change = 'new'")).alias("new_members"), F.count_if(F.expr("change = 'missing'")).alias("missing_members"))
    moved = before_family.select("pub", F.col("family_id").alias("was")).join(after_family.select("pub", F.col("family_id").alias("is")), "pub").where("NOT was <=> is").select("pub", F.lit(True).alias("family_id_changed"))
    out = pubs.join(count(new_events(before_events, after_events), "new_events"), "pub", "left").join(count(missing_events(before_events, after_events), "missing_events"), "pub", "left").join(members, "pub", "left").join(moved, "pub", "left")
    n = lambda c: F.when(F.col("stored"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    out = out.select("pub", (~F.col("stored")).alias("first_snapshot"), n("new_events"), n("missing_events"), n("new_members"), n("missing_members"), (F.col("stored") & F.coalesce("family_id_changed", F.lit(False))).alias("family_id_changed"))
    return out.withColumn("changed", F.expr("new_events + missing_events + new_members + missing_members > 0 OR family_id_changed"))


def watch(pubs: DataFrame, legal: DataFrame, family: DataFrame, previous: DataFrame, errors: DataFrame, since: Column | None = None) -> DataFrame:
    """One row for each of ``pubs(idx, pub)``, ordered by ``idx``: its ``diff_snapshots``, or what ``errors(pub, error_type, error)`` says.

    ``pub`` is the DOCDB spelling.  A publication that neither was read nor failed is an error of its own.
    """
    asked = pubs.select("idx", key_or_raw(F.col("pub")).alias("key"))
    failed = errors.select(key_or_raw(F.col("pub")).alias("key"), "error_type", "error")
    report = diff_snapshots(legal, family, previous, since).drop("pub").join(failed, "key", "left_anti")
    rows = asked.join(report, "key", "left").join(failed, "key", "left")
    lost = F.col("error_type").isNull() & F.col("snapshot").isNull()
    rows = rows.withColumn("error", F.when(lost, "nothing was read").otherwise(F.col("error"))).withColumn("error_type", F.when(lost, "upstream_data").otherwise(F.col("error_type")))
    return rows.select("idx", F.col("key").alias("pub"), "changed", "first_snapshot", "legal", "family", "snapshot", "error_type", "error").orderBy("idx")


def watch_counts(results: DataFrame, pubs: DataFrame, previous: DataFrame) -> DataFrame:
    """One row over the results of ``watch``: changed, unchanged, first and failed, and stored snapshots of publications not asked for."""
    ignored = ignored_previous(index_previous(previous).where("problem IS NULL").select(F.col("key").alias("pub")), pubs.select(key_or_raw(F.col("pub")).alias("pub")))
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    counted = results.select("changed", "first_snapshot", "error_type", F.lit(False).alias("ignored")).unionByName(ignored.select(F.lit(True).alias("ignored")), allowMissingColumns=True)
    failed = "NOT ignored AND error_type IS NOT NULL"
    return counted.agg(count("changed", "changed_count"), count("NOT changed AND NOT first_snapshot AND error_type IS NULL", "unchanged_count"), count("first_snapshot", "first_count"), count(failed, "error_count"), count("ignored", "ignored_previous"))


def envelope(diff: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: publications changed, unchanged, seen for the first time, and failed; stored ones no longer watched are not among them."""
    failed = errors.select(F.lit(False).alias("changed"), F.lit(False).alias("first_snapshot"), F.lit(True).alias("failed"))
    rows = diff.select("changed", "first_snapshot", F.lit(False).alias("failed")).unionByName(failed)
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return rows.agg(count("changed", "changed"), count("first_snapshot", "first"), count("NOT changed AND NOT first_snapshot AND NOT failed", "unchanged"), count("failed", "error"))


def ignored_previous(stored: DataFrame, watched: DataFrame) -> DataFrame:
    return stored.select("pub").distinct().join(watched.select("pub"), "pub", "left_anti")


def events_since(events: DataFrame, bound: Column) -> DataFrame:
    """Events dated on or after ``bound``, in reported order."""
    return events.where(gazette_date(F.col("gazette_date")) >= bound)


def undated_events(events: DataFrame) -> DataFrame:
    return events.groupBy("pub").agg(F.count_if(gazette_date(F.col("gazette_date")).isNull()).alias("undated"))
