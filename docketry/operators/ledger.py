"""Ledger files checked by rules: findings ``target, file, line, rule, severity, key``.

Input is ``lines(target, file, line, v)``, ``v`` being a VARIANT object or null for a line that isn't one, and
``files(target, file, problem)``, one row for each file that is there.  The rules of a line are one array of structs,
so each file is read once however many rules it has; references are joined with the ids of all files at once.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docketry.functions import pubnum
from docketry.functions.records import instant, iso_date, with_time

# Files, keys and accepted values of the format.
MANIFEST, TRANSLATION = "ledger.json", "translation.md"
FILES = ("runs.jsonl", "features.jsonl", "queries.jsonl", "families.jsonl", "watch.jsonl")
FILE_ORDER = (MANIFEST, *FILES, TRANSLATION)
RUN_TYPES = ("baseline", "follow-up", "watch", "imported")
RUN_STAGES = ("concept", "development", "pre-release", "released")
RUN_MODES = ("standard", "degraded")
DATED_RUNS = ("baseline", "follow-up")
FEATURE_BASES = ("code", "design")
FEATURE_PRIORITIES = ("high", "medium", "low")
FEATURE_STATUSES = ("active", "retired", "excluded")
QUERY_STATUSES = ("adopted", "rejected", "dropped")
STAGE1 = ("A", "B", "C")
STAGE2 = ("close-read", "boundary", "lacks")
WATCH_REASONS = ("in-force", "key-lacks", "pending", "provisional", "boundary")
OBSERVATIONS = ("reads-on direction", "lacks", "unclear")
RUN_ID, FEATURE_ID, QUERY_ID = r"^[0-9]{8}-[0-9]{4}$", r"^F[0-9]+$", r"^Q[0-9]+$"
WINDOW, DATE_CLAUSE, TARGET_NAME = r"^[0-9]{8}-[0-9]{8}$", r"(?i)\bpd\s*(=|within|<|>)", r"^[a-z0-9_-]+$"
LAST_RUN = ("run_id", "type", "stage", "mode", "started_at", "target_version", "target_commit", "searched_through", "report")
SNAPSHOT_FORMAT = 1
#: The files whose ids each reference rule needs.
REFERS_TO = {"run-ref": "runs.jsonl", "feature-ref": "features.jsonl", "watch-family-unknown": "families.jsonl"}

FOUND = "array<struct<rule: string, severity: string, key: string>>"
REFS = "array<struct<rule: string, key: string, ref: string>>"


class One(NamedTuple):
    """A finding or reference, null where its rule is kept."""

    rule: str
    column: Column

    def only(self, condition: Column) -> One:
        return One(self.rule, F.when(condition, self.column))


class Many(NamedTuple):
    """Findings or references of an array's elements: ``made`` gives those of an element and its place."""

    items: Column
    made: Callable[[Column, Column], list[One]]


class Node:
    """Values under a VARIANT column.  ``path`` leads to an inner object; ``label`` stands before its keys in findings.

    With ``held``, expressions over the variant are gathered there under names, and columns of those names are returned:
    projected first, each is computed once however many rules use it.
    """

    def __init__(self, v: Column, path: str = "", label: Column | None = None, held: dict[str, Column] | None = None):
        self.v, self.path, self.label, self.held = v, path, F.lit(path) if label is None else label, held

    def keep(self, name: str, make: Callable[[], Column]) -> Column:
        if self.held is None:
            return make()
        if name not in self.held:
            self.held[name] = make()
        return F.col(f"`{name}`")

    def inner(self, key: str) -> Node:
        return Node(self.v, f"{self.path}{key}.", held=self.held)

    def _as(self, key: str, kind: str) -> Column:
        return F.try_variant_get(self.v, f"$.{self.path}{key}", kind)

    def kind(self, key: str) -> Column:
        """The type of a value, null where the key is missing; JSON null is VOID."""
        return self.keep(f"kind {self.path}{key}", lambda: F.schema_of_variant(self._as(key, "variant")))

    def text(self, key: str) -> Column:
        """The value where it is text, else null."""
        return self.keep(f"text {self.path}{key}", lambda: F.when(F.schema_of_variant(self._as(key, "variant")) == "STRING", self._as(key, "string")))

    def whole(self, key: str) -> Column:
        """The value where it is a whole number, else null."""
        return self.keep(f"whole {self.path}{key}", lambda: F.when(F.schema_of_variant(self._as(key, "variant")) == "BIGINT", self._as(key, "bigint")))

    def has(self, key: str) -> Column:
        return F.coalesce(self.kind(key), F.lit("VOID")) != "VOID"

    def is_object(self, key: str) -> Column:
        return F.coalesce(self.kind(key).like("OBJECT%"), F.lit(False))

    def items(self, key: str) -> Column:
        """The elements of an array, none where it isn't one."""
        return self.keep(f"items {self.path}{key}", lambda: F.coalesce(self._as(key, "array<variant>"), F.array().cast("array<variant>")))

    def is_list(self, key: str) -> Column:
        return F.coalesce(self.kind(key).like("ARRAY%"), F.lit(False))

    def pub(self, key: str) -> Column:
        """``text, p``: the value where it is text, and the publication number it parses to."""
        return self.keep(f"pub {self.path}{key}", lambda: numbered(F.when(F.schema_of_variant(self._as(key, "variant")) == "STRING", self._as(key, "string"))))

    def named(self, key: str) -> Column:
        return F.concat(self.label, F.lit(key))


def numbered(text: Column) -> Column:
    return F.struct(text.alias("text"), pubnum.parse(text).alias("p"))


def finding(condition: Column, rule: str, key: Column, severity: str = "error") -> One:
    return One(rule, F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.alias("key"))))


def reference(condition: Column, rule: str, key: Column, ref: Column) -> One:
    return One(rule, F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), key.alias("key"), ref.alias("ref"))))


def _required(n: Node, *keys: str) -> list[One]:
    return [finding(~n.has(k), "required-key", n.named(k)) for k in keys]


def _enum(n: Node, key: str, accepted: tuple[str, ...]) -> One:
    return finding(n.has(key) & ~F.coalesce(n.text(key).isin(*accepted), F.lit(False)), "enum", n.named(key))


def _shape(n: Node, key: str, good: Column) -> One:
    """A container of the wrong shape counts as a value that isn't accepted."""
    return finding(n.has(key) & ~good, "enum", n.named(key))


def _id(n: Node, key: str, pattern: str) -> One:
    return finding(n.has(key) & ~F.coalesce(n.text(key).rlike(pattern), F.lit(False)), "id-format", n.named(key))


def _date(n: Node, key: str) -> One:
    return finding(n.has(key) & iso_date(n.text(key)).isNull(), "date", n.named(key))


def _timestamp(n: Node, key: str) -> One:
    return finding(n.has(key) & with_time(n.text(key)).isNull(), "timestamp", n.named(key))


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _pub(condition: Column, pub: Column, key: Column, coded: bool, tolerant: bool = False) -> list[One]:
    """A publication ``text, p`` that can't be read, isn't in DOCDB spelling, or lacks the kind code it needs."""
    odd = condition & pub["p"].isNull()
    kept = odd & ~_blank(pub["text"]) if tolerant else F.lit(False)
    return [
        finding(kept, "pub-unparsed", key, "warning"), finding(odd & ~kept, "pub-spelling", key),
        finding(condition & (pubnum.docdb(pub["p"]) != pub["text"]), "pub-spelling", key), finding(condition & F.lit(coded) & (pub["p"]["kind"] == ""), "pub-kind", key),
    ]


def _run(n: Node, *keys: str) -> list[One]:
    return [reference(n.has(k), "run-ref", n.named(k), n.text(k)) for k in keys]


def _feature_shape(n: Node, key: str, all_: bool = False) -> One:
    """A list of features, or where it may be the word all."""
    return _shape(n, key, n.is_list(key) | (F.coalesce(n.text(key) == "all", F.lit(False)) if all_ else F.lit(False)))


def _feature_refs_of(n: Node, key: str) -> Many:
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    place = lambda i: F.concat(n.named(key), F.lit("["), i.cast("string"), F.lit("]"))
    return Many(n.items(key), lambda x, i: [reference(F.lit(True), "feature-ref", place(i), text(x))])


def _each(n: Node, key: str, rules) -> Many:
    """What ``rules`` gives for every element, with the element's place in its label."""
    return Many(n.items(key), lambda x, i: rules(Node(x, label=F.concat(n.named(key), F.lit("["), i.cast("string"), F.lit("].")))))


def _run_found(n: Node) -> Rules:
    through, path = lambda: n.kind("searched_through"), lambda: n.text("report")
    return {
        "required-key": lambda: [*_required(n, "run_id", "type", "stage", "mode", "started_at", "server_version"), finding(through().isNull(), "required-key", n.named("searched_through"))],
        "id-format": lambda: [_id(n, "run_id", RUN_ID)],
        "enum": lambda: [_enum(n, "type", RUN_TYPES), _enum(n, "stage", RUN_STAGES), _enum(n, "mode", RUN_MODES)],
        "timestamp": lambda: [_timestamp(n, "started_at"), _timestamp(n, "finished_at")],
        "searched-through": lambda: [finding((through() == "VOID") & n.text("type").isin(*DATED_RUNS), "searched-through", n.named("searched_through"))],
        "date": lambda: [_date(n, "searched_through")],
        "run-ref": lambda: [finding(_itself(n), "run-ref", n.named("previous_run"))],
        "report-missing": lambda: [finding(n.has("report") & (path().isNull() | (path() == "") | path().rlike(r"^/|(^|/)\.\.(/|$)")), "report-missing", n.named("report"))],
    }


def _itself(n: Node) -> Column:
    """Whether a run names itself as the one before it."""
    return F.coalesce(n.has("previous_run") & (n.text("previous_run") == n.text("run_id")), F.lit(False))


def _run_refs(n: Node) -> Rules:
    return {"run-ref": lambda: [reference(n.has("previous_run") & ~_itself(n), "run-ref", n.named("previous_run"), n.text("previous_run"))]}


def _feature_found(n: Node) -> Rules:
    return {
        "required-key": lambda: _required(n, "id", "title", "basis", "priority", "status", "since_run"),
        "id-format": lambda: [_id(n, "id", FEATURE_ID)],
        "enum": lambda: [_enum(n, "basis", FEATURE_BASES), _enum(n, "priority", FEATURE_PRIORITIES), _enum(n, "status", FEATURE_STATUSES)],
        "reason-missing": lambda: [finding((n.text("status") == "excluded") & _blank(n.text("reason")), "reason-missing", n.named("reason"), "warning")],
    }


def _feature_refs(n: Node) -> Rules:
    return {"run-ref": lambda: _run(n, "since_run", "changed_run")}


def _query_run_found(n: Node) -> list[One]:
    window = n.text("window")
    shaped = F.coalesce(F.schema_of_variant(n.v).like("OBJECT%"), F.lit(False))
    return [
        finding(~shaped, "enum", F.regexp_replace(n.label, r"\.$", "")), *[c.only(shaped) for c in _required(n, "run_id", "window")],
        finding(shaped & n.kind("total").isNull(), "required-key", n.named("total")),
        finding(n.has("total") & ~F.coalesce(n.whole("total") >= 0, F.lit(False)), "window", n.named("total")),
        finding(n.has("window") & ~F.coalesce((window == "all") | window.rlike(WINDOW), F.lit(False)), "window", n.named("window")),
    ]


def _query_found(n: Node) -> Rules:
    return {
        "required-key": lambda: _required(n, "id", "cql", "status", "features", "runs"),
        "id-format": lambda: [_id(n, "id", QUERY_ID)],
        "enum": lambda: [_enum(n, "status", QUERY_STATUSES), _feature_shape(n, "features"), _shape(n, "runs", n.is_list("runs"))],
        "cql-date-clause": lambda: [finding(n.text("cql").rlike(DATE_CLAUSE), "cql-date-clause", n.named("cql"), "warning")],
        "reason-missing": lambda: [finding(n.text("status").isin("rejected", "dropped") & _blank(n.text("reason")), "reason-missing", n.named("reason"), "warning")],
        "enum required-key window": lambda: [_each(n, "runs", _query_run_found)],
    }


def _query_refs(n: Node) -> Rules:
    return {"feature-ref": lambda: [_feature_refs_of(n, "features")], "run-ref": lambda: [_each(n, "runs", lambda r: _run(r, "run_id"))]}


def _family_found(n: Node) -> Rules:
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    pubs = lambda: n.keep("numbers", lambda: F.transform(F.coalesce(F.try_variant_get(n.v, "$.pubs", "array<variant>"), F.array().cast("array<variant>")), lambda x: numbered(text(x))))
    return {
        "required-key": lambda: _required(n, "family_id", "pubs", "stage1", "judged_run", "features"),
        "enum": lambda: [
            _shape(n, "family_id", F.coalesce(n.text("family_id") != "", F.lit(False))), _shape(n, "pubs", n.is_list("pubs") & (F.size(n.items("pubs")) > 0)),
            _enum(n, "stage1", STAGE1), _enum(n, "stage2", STAGE2), _feature_shape(n, "features", all_=True),
        ],
        "pub-unparsed pub-spelling pub-kind": lambda: [Many(pubs(), lambda x, i: _pub(F.lit(True), x, F.concat(F.lit("pubs["), i.cast("string"), F.lit("]")), coded=False, tolerant=True))],
    }


def _family_refs(n: Node) -> Rules:
    return {"run-ref": lambda: _run(n, "judged_run"), "feature-ref": lambda: [_feature_refs_of(n, "features")]}


def _watch_found(n: Node) -> Rules:
    seen, reading, read, snap = (n.inner(k) for k in ("observation", "status_reading", "claims_read", "snapshot"))
    event, whole = reading.inner("decisive_event"), lambda: n.is_object("snapshot")
    object_ = lambda h: F.coalesce(F.schema_of_variant(h.v).like("OBJECT%"), F.lit(False))
    numbers = "pub-unparsed pub-spelling pub-kind"
    return {
        "required-key": lambda: [
            *_required(n, "pub", "family_id", "reason", "added_run", "checked_run"), finding(~n.has("next_check") & ~n.has("closed_run"), "required-key", n.named("next_check")),
            finding(n.kind("snapshot").isNull(), "required-key", n.named("snapshot")),
        ],
        numbers: lambda: [*_pub(n.has("pub"), n.pub("pub"), n.named("pub"), coded=True), *_pub(read.has("pub"), read.pub("pub"), read.named("pub"), coded=True), *_pub(whole() & snap.has("pub"), snap.pub("pub"), snap.named("pub"), coded=False)],
        "enum": lambda: [
            _enum(n, "reason", WATCH_REASONS), _feature_shape(n, "features"), *[_shape(n, k, n.is_object(k)) for k in ("observation", "status_reading", "claims_read")], _enum(seen, "value", OBSERVATIONS),
            _shape(reading, "decisive_event", reading.is_object("decisive_event")), _shape(n, "history", n.is_list("history")), _each(n, "history", lambda h: [finding(~object_(h), "enum", F.regexp_replace(h.label, r"\.$", ""))]),
        ],
        "date": lambda: [_date(n, "next_check"), _date(event, "date")],
        "timestamp": lambda: [_timestamp(reading, "as_of")],
        "snapshot": lambda: [
            finding(n.has("snapshot") & ~whole(), "snapshot", n.named("snapshot")), finding(whole() & ~F.coalesce(snap.whole("snapshot_format") == SNAPSHOT_FORMAT, F.lit(False)), "snapshot", snap.named("snapshot_format")),
            finding(whole() & ~snap.has("pub"), "snapshot", snap.named("pub")), finding(whole() & (pubnum.docdb(snap.pub("pub")["p"]) != pubnum.docdb(n.pub("pub")["p"])), "snapshot", snap.named("pub")),
            *[finding(whole() & ~snap.is_object(k), "snapshot", snap.named(k)) for k in ("legal", "family")],
        ],
    }


def _watch_refs(n: Node) -> Rules:
    seen, reading, read = (n.inner(k) for k in ("observation", "status_reading", "claims_read"))
    return {
        "run-ref": lambda: [*_run(n, "added_run", "checked_run", "closed_run"), *_run(seen, "run_id"), *_run(reading, "run_id"), *_run(read, "run_id"), _each(n, "history", lambda h: _run(h, "run_id"))],
        "feature-ref": lambda: [_feature_refs_of(n, "features")],
        "watch-family-unknown": lambda: [reference(n.has("family_id"), "watch-family-unknown", n.named("family_id"), n.text("family_id"))],
    }


#: Of each file the rules over its lines' own values, and the references they hold, by name; a rule is built when it is wanted.
Rules = dict[str, Callable[[], list["One | Many"]]]
RULES = dict(zip(FILES, ((_run_found, _run_refs), (_feature_found, _feature_refs), (_query_found, _query_refs), (_family_found, _family_refs), (_watch_found, _watch_refs)), strict=True))


def _wanted(rules: Collection[str] | None, made: Iterable[One]) -> list[One]:
    return [one for one in made if rules is None or one.rule in rules]


def _built(rules: Collection[str] | None, registry: Rules) -> list[One | Many]:
    """Findings of the wanted rules; no other rule is built."""
    made = [f for names, make in registry.items() if rules is None or set(rules) & set(names.split()) for f in make()]
    return [f for f in made if isinstance(f, Many) or rules is None or f.rule in rules]


def _of_elements(many: Many, rules: Collection[str] | None) -> Column:
    return F.flatten(F.transform(many.items, lambda x, i: F.array(*[o.column for o in _wanted(rules, many.made(x, i))])))


def _gathered(found: list[One | Many], kind: str, rules: Collection[str] | None = None) -> Column:
    """Single structs and those of elements in one array, nulls left out."""
    ones = [f.column for f in found if isinstance(f, One)]
    each = [_of_elements(f, rules) for f in found if isinstance(f, Many)]
    arrays = [*([F.array(*ones)] if ones else []), *each]
    whole = arrays[0] if len(arrays) == 1 else F.flatten(F.array(*[a.cast(kind) for a in arrays])) if arrays else F.array()
    return F.filter(whole.cast(kind), lambda x: x.isNotNull())


def judged(lines: DataFrame, rules: Collection[str] | None = None, refs: Collection[str] | None = None) -> DataFrame:
    """``target, file, line, found, refs`` of every line that is an object: what its own rules find, and what it refers to.

    Only the wanted rules and references are built (None: all), and only the values they use are read from a line; a
    file that has none of them isn't read.
    """
    out = []
    for file, (found, referred) in RULES.items():
        held: dict[str, Column] = {}
        n = Node(F.col("v"), held=held)
        own, named = _built(rules, found(n)), _built(refs, referred(n))
        if own or named:
            rows = lines.where((F.col("file") == file) & F.col("v").isNotNull()).select("target", "file", "line", *[c.alias(name) for name, c in held.items()])
            out.append(rows.select("target", "file", "line", _gathered(own, FOUND, rules).alias("found"), _gathered(named, REFS, refs).alias("refs")))
    if not out:
        return lines.where("false").select("target", "file", "line", F.array().cast(FOUND).alias("found"), F.array().cast(REFS).alias("refs"))
    return reduce(DataFrame.unionByName, out)


def line_findings(lines: DataFrame, rules: Collection[str] | None = None) -> DataFrame:
    """Findings that a line's own values give, of the wanted rules."""
    # outer, lest the optimizer infers a filter over the whole array of rules
    return judged(lines, rules, ()).select("target", "file", "line", F.inline_outer("found")).where("rule IS NOT NULL")


def unique_ids(ids: DataFrame) -> DataFrame:
    """Lines of ``target, file, line, id`` that repeat an id, with the line that had it first."""
    first = F.min("line").over(W.partitionBy("target", "file", "id"))
    return ids.where("id IS NOT NULL").withColumn("first_line", first).where("line > first_line")


def ledger_ids(lines: DataFrame) -> DataFrame:
    """Valid ids of all files, ``target, file, line, id``; a watched publication counts by its DOCDB key."""
    n, file = Node(F.col("v")), F.col("file")
    valid = lambda key, pattern: F.when(n.text(key).rlike(pattern), n.text(key))
    own = (
        F.when(file == "runs.jsonl", valid("run_id", RUN_ID)).when(file == "features.jsonl", valid("id", FEATURE_ID)).when(file == "queries.jsonl", valid("id", QUERY_ID))
        .when(file == "families.jsonl", F.nullif(n.text("family_id"), F.lit(""))).when(file == "watch.jsonl", pubnum.docdb(pubnum.parse(n.text("pub"))))
    )
    return lines.where("v IS NOT NULL").select("target", "file", "line", own.alias("id"))


def referred_ids(lines: DataFrame, rules: Collection[str] | None = None) -> DataFrame:
    """``target, rule, ref``: the ids that references of the wanted rules may name, one row each."""
    named = {r: f for r, f in REFERS_TO.items() if rules is None or r in rules}
    n, file = Node(F.col("v")), F.col("file")
    rule = F.create_map(*[F.lit(x) for pair in ((f, r) for r, f in named.items()) for x in pair])
    own = F.when(file == "runs.jsonl", n.text("run_id")).when(file == "features.jsonl", n.text("id")).otherwise(n.text("family_id"))
    rows = lines.where(F.col("v").isNotNull() & file.isin(*named.values())).select("target", F.try_element_at(rule, file).alias("rule"), own.alias("ref"))
    return rows.where("ref IS NOT NULL").distinct()


def reference_findings(lines: DataFrame, files: DataFrame, rules: Collection[str] | None = None) -> DataFrame:
    """References to nothing, of the wanted rules, where the file that would hold the id can be read; an unknown family is a warning."""
    refs = judged(lines, (), rules).select("target", "file", "line", F.inline_outer("refs")).where("rule IS NOT NULL")
    rule = F.create_map(*[F.lit(x) for pair in ((f, r) for r, f in REFERS_TO.items()) for x in pair])
    readable = files.where(F.col("problem").isNull()).select("target", F.try_element_at(rule, F.col("file")).alias("rule")).where("rule IS NOT NULL").distinct()
    lost = refs.join(readable, ["target", "rule"], "left_semi").join(referred_ids(lines, rules), ["target", "rule", "ref"], "left_anti")
    return lost.select("target", "file", "line", "rule", F.when(F.col("rule") == "watch-family-unknown", "warning").otherwise("error").alias("severity"), "key")


def run_order(runs: DataFrame) -> DataFrame:
    """Runs ``target, file, line, started_at`` that began before the one parseable before them, offsets alike."""
    at, aware = instant(F.col("started_at")), F.col("started_at").rlike(r"[T ].*(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    rows = runs.withColumn("at", F.when(at.isNotNull(), F.struct(at.alias("at"), aware.alias("aware"))))
    before = F.last("at", ignorenulls=True).over(W.partitionBy("target").orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before", before).where("at.aware = before.aware AND at.at < before.at").drop("at", "before")


def absent_snapshots(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Watch lines whose snapshot is null: excused by a last check in a degraded run, and a warning where ``snapshot_error`` says why."""
    n = Node(F.col("v"))
    runs = lines.where((F.col("file") == "runs.jsonl") & n.text("run_id").isNotNull() & n.text("mode").isNotNull())
    modes = runs.groupBy("target", n.text("run_id").alias("run")).agg(F.max_by(n.text("mode"), "line").alias("mode"))
    readable = files.where((F.col("file") == "runs.jsonl") & F.col("problem").isNull()).select("target").distinct()
    rows = lines.where((F.col("file") == "watch.jsonl") & (n.kind("snapshot") == "VOID")).select("target", "file", "line", n.text("checked_run").alias("run"), _blank(n.text("snapshot_error")).alias("unsaid"))
    rows = rows.join(readable, "target", "left_semi").join(modes, ["target", "run"], "left").where("mode IS NULL OR mode <> 'degraded'")
    return rows.select("target", "file", "line", F.when(F.col("unsaid"), "snapshot").otherwise("snapshot-error").alias("rule"), F.when(F.col("unsaid"), "error").otherwise("warning").alias("severity"), F.lit("snapshot").alias("key"))


def file_findings(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Targets and files that are missing, badly named or unreadable, from ``targets(target)`` and ``files(target, file, problem)``."""
    needed = [(f, "missing-file", "error") for f in (MANIFEST, *FILES)] + [(TRANSLATION, "translation-missing", "warning")]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("file"), F.lit(r).alias("rule"), F.lit(s).alias("severity")) for f, r, s in needed]))
    absent = targets.select("target", each.alias("e")).select("target", "e.*").join(files.select("target", "file"), ["target", "file"], "left_anti")
    cols = ("target", "file", F.lit(None).cast("int").alias("line"), "rule", "severity", F.lit(None).cast("string").alias("key"))
    named = targets.where(~F.col("target").rlike(TARGET_NAME)).select("target", F.lit(MANIFEST).alias("file"), F.lit("target-name").alias("rule"), F.lit("warning").alias("severity"))
    bad = files.where("problem IS NOT NULL").select("target", "file", F.col("problem").alias("rule"), F.lit("error").alias("severity"))
    return absent.select(*cols).unionByName(named.select(*cols)).unionByName(bad.select(*cols))


def missing_ledgers(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """A finding for each of ``wanted(target)`` that has no ledger."""
    lost = wanted.select("target").distinct().join(targets.select("target"), "target", "left_anti")
    return lost.select("target", F.lit(MANIFEST).alias("file"), F.lit(None).cast("int").alias("line"), F.lit("missing-ledger").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("key"))


def manifest_findings(manifests: DataFrame) -> DataFrame:
    """What is wrong with ``manifests(target, v)``; a null ``v`` isn't a JSON object."""
    n = Node(F.col("v"))
    good = F.coalesce(n.whole("format") == 1, F.lit(False))
    found = [
        *_required(n, "format", "target", "created_at"), finding(n.has("format") & ~good, "manifest", F.lit("format")), finding(n.has("target") & ~n.text("target").eqNullSafe(F.col("target")), "manifest", F.lit("target")),
        finding(n.has("created_at") & with_time(n.text("created_at")).isNull(), "manifest", F.lit("created_at")),
    ]
    whole = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("json").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("key"))).cast(FOUND)).otherwise(_gathered(found, FOUND))
    return manifests.select("target", F.lit(MANIFEST).alias("file"), F.lit(None).cast("int").alias("line"), F.inline(whole))


def missing_reports(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Runs whose report, a relative path, isn't among ``paths(path)``, or ``paths(target, path)`` where targets have files of their own."""
    n = Node(F.col("v"))
    rows = lines.where(F.col("file") == "runs.jsonl").select("target", "file", "line", n.text("report").alias("path"))
    rows = rows.where((F.col("path") != "") & ~F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")).join(paths, [c for c in ("target", "path") if c in paths.columns], "left_anti")
    return rows.select("target", "file", "line", F.lit("report-missing").alias("rule"), F.lit("error").alias("severity"), F.lit("report").alias("key"))


def check(targets: DataFrame, files: DataFrame, lines: DataFrame, manifests: DataFrame, paths: DataFrame) -> DataFrame:
    """All findings.  References into a file that can't be read aren't judged."""
    n = Node(F.col("v"))
    cols = ("target", "file", "line", "rule", "severity", "key")
    mark = lambda df, rule, key, severity="error": df.select("target", "file", "line", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(key).cast("string").alias("key"))
    runs = lines.where((F.col("file") == "runs.jsonl") & F.col("v").isNotNull()).select("target", "file", "line", n.text("started_at").alias("started_at"))
    parts = [
        file_findings(targets, files), manifest_findings(manifests), mark(lines.where("v IS NULL AND line IS NOT NULL"), "json", None), line_findings(lines), reference_findings(lines, files),
        unique_ids(ledger_ids(lines)).select("target", "file", "line", F.lit("unique-id").alias("rule"), F.lit("error").alias("severity"), F.col("id").alias("key")),
        mark(run_order(runs), "run-order", "started_at", "warning"), absent_snapshots(lines, files), missing_reports(lines, paths),
    ]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by target, errors first, then file by file and line by line."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FILE_ORDER)), F.col("file")), F.lit(0)), F.lit(len(FILE_ORDER) + 1))
    return findings.orderBy("target", "severity", rank, F.col("line").asc_nulls_first(), "rule", "key")


def enum_counts(rows: DataFrame, column: str, accepted: tuple[str, ...]) -> DataFrame:
    """A count for each accepted value, zero included; other values are ignored."""
    dimension = F.broadcast(rows.sparkSession.createDataFrame([(a,) for a in accepted], f"{column} string"))
    return dimension.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def _watch_columns(n: Node, today: Column) -> list[Column]:
    due = iso_date(n.text("next_check"))
    is_open = ~n.has("closed_run")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return [count(is_open, "open"), count(~is_open, "closed"), count(is_open & (due <= today), "due"), count(is_open & (n.text("reason") == "provisional"), "provisional"), F.min(F.when(is_open, due)).alias("next_check")]


def watch_summary(lines: DataFrame, today: Column) -> DataFrame:
    """For each target open and closed entries, closed being those with a ``closed_run``; of the open ones those due, provisional ones, and the earliest next check."""
    return lines.where((F.col("file") == "watch.jsonl") & F.col("v").isNotNull()).groupBy("target").agg(*_watch_columns(Node(F.col("v")), today))


def last_run(rows: DataFrame, *keys: str) -> DataFrame:
    """The run on the last readable line of each target."""
    return rows.groupBy("target").agg(F.max_by(F.struct(*keys), "line").alias("r")).select("target", "r.*")


def status(targets: DataFrame, files: DataFrame, lines: DataFrame, manifests: DataFrame, today: Column) -> DataFrame:
    """One forgiving row for each target: what can be counted is counted, the rest is named in ``problems``.

    ``target, format, runs, last_run, features, queries, families, watch, problems``; the counts by status are maps.
    """
    n, file, good = Node(F.col("v")), F.col("file"), F.col("v").isNotNull()
    of = lambda f: good & (file == f)
    by = lambda f, values: F.create_map(*[x for s in values for x in (F.lit(s), F.count_if(F.coalesce(of(f) & (n.text("status") == s), F.lit(False))))])
    watch = F.struct(*_watch_columns(Node(F.when(of("watch.jsonl"), F.col("v"))), today)[2:])
    last = F.max_by(F.struct(*[n.text(k).alias(k) for k in LAST_RUN]), F.when(of("runs.jsonl"), F.col("line")))
    open_ = F.count_if(of("watch.jsonl") & ~n.has("closed_run"))
    sums = lines.groupBy("target").agg(
        F.count_if(of("runs.jsonl")).alias("runs"), last.alias("last_run"), by("features.jsonl", FEATURE_STATUSES).alias("features"), by("queries.jsonl", QUERY_STATUSES).alias("queries"), F.count_if(of("families.jsonl")).alias("families"),
        open_.alias("open"), F.count_if(of("watch.jsonl") & n.has("closed_run")).alias("closed"), watch.alias("w"),
    )
    bad = lines.where("v IS NULL AND line IS NOT NULL").select("target", F.concat("file", F.lit(" line "), F.col("line").cast("string"), F.lit(": not a JSON object")).alias("problem"))
    bad = bad.unionByName(files.where("problem IS NOT NULL").select("target", F.concat_ws(" ", "file", "problem").alias("problem")))
    each = F.explode(F.array(*map(F.lit, (MANIFEST, *FILES))))
    absent = targets.select("target", each.alias("file")).join(files.select("target", "file"), ["target", "file"], "left_anti")
    bad = bad.unionByName(absent.select("target", F.concat("file", F.lit(" is missing")).alias("problem"))).groupBy("target").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    formats = manifests.groupBy("target").agg(F.max(n.whole("format").cast("int")).alias("format"))
    none = lambda c, empty: F.coalesce(c, empty).alias(c)
    out = targets.join(formats, "target", "left").join(sums, "target", "left").join(bad, "target", "left")
    zero = lambda values: F.create_map(*[x for s in values for x in (F.lit(s), F.lit(0).cast("long"))])
    counts = F.struct(F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("closed", F.lit(0)).alias("closed"), F.coalesce("w.due", F.lit(0)).alias("due"), F.coalesce("w.provisional", F.lit(0)).alias("provisional"), F.col("w.next_check").alias("next_check"))
    return out.select("target", "format", none("runs", F.lit(0)), "last_run", none("features", zero(FEATURE_STATUSES)), none("queries", zero(QUERY_STATUSES)), none("families", F.lit(0)), counts.alias("watch"), none("problems", F.array().cast("array<string>")))
