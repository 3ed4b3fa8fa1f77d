"""Registered queries of the ledger rules, over ledger lines made of the driver's tables with faults in known places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators import ledger
from docketry.plans.catalog import query
from docketry.plans.proxies import duck, view


def _line(df: DataFrame, *values: Column) -> DataFrame:
    # nulls are left out of the text, so a null is a missing key
    return df.select("target", "file", "line", F.parse_json(F.to_json(F.struct(*values))).alias("v"))


def _lit(**values: str) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def _lines(spark, sf_dir, *files: str) -> DataFrame:
    """Lines of the wanted files in the format's own keys."""
    made = {
        "runs": lambda v: _line(v, "run_id", "started_at", "mode", *_lit(type="baseline", stage="concept", server_version="1.1.0", searched_through="2024-01-01")),
        "features": lambda v: _line(v, "id", "priority", "status", *_lit(title="x", basis="code", since_run="20240100-0001")),
        "queries_": lambda v: _line(v, "id", "cql", "status", F.array("feature").alias("features"), F.array(F.struct(F.col("run").alias("run_id"), F.lit(1).alias("total"), F.col("win").alias("window"))).alias("runs")),
        "families": lambda v: _line(v, "family_id", F.array("pub").alias("pubs"), "stage1", *_lit(judged_run="20240100-0001", features="all")),
    }
    out = [made[f](view(spark, sf_dir, f)) for f in files if f != "watch_lines"]
    if "watch_lines" in files:
        w = view(spark, sf_dir, "watch_lines")
        shot = F.concat(F.lit('{"snapshot_format": 1, "legal": {}, "family": {}, "pub": "'), "pub", F.lit('"}'))
        rest = F.to_json(F.struct("pub", "family_id", F.col("run").alias("added_run"), F.col("run").alias("checked_run"), "next_check", "closed_run", "reason", F.col("shot_error").alias("snapshot_error")))
        text = F.concat(F.expr("left(r, length(r) - 1)"), F.lit(', "snapshot": '), F.when(F.col("shotless"), "null").otherwise(shot), F.lit("}"))
        out.append(w.withColumn("r", rest).select("target", "file", "line", F.parse_json(text).alias("v")))
    return reduce(DataFrame.unionByName, out)


def _files(spark) -> DataFrame:
    return spark.createDataFrame([("main", f, None) for f in (ledger.MANIFEST, ledger.TRANSLATION, *ledger.FILES)], "target string, file string, problem string")


def _own(spark, sf_dir, rule: str, *files: str) -> DataFrame:
    return ledger.line_findings(_lines(spark, sf_dir, *files), {rule}).select("target", "file", "line", "key")


def _lost(spark, sf_dir, rule: str, *files: str) -> DataFrame:
    return ledger.reference_findings(_lines(spark, sf_dir, *files), _files(spark), {rule}).select("target", "file", "line", "key", "severity")


@query(duck("features") + "SELECT v.priority, count(f.priority) AS n FROM (VALUES ('high'), ('medium'), ('low')) v(priority) LEFT JOIN features f ON f.priority = v.priority GROUP BY v.priority")
def ledger_enum_counts(spark, sf_dir):
    return ledger.enum_counts(view(spark, sf_dir, "features"), "priority", ledger.FEATURE_PRIORITIES)


WATCH = ", d AS (SELECT *, CASE WHEN line % 12 <> 0 THEN next_check END AS c, closed_run IS NULL AS o FROM watch_lines) SELECT target, count(*) FILTER (o) AS open, count(*) FILTER (NOT o) AS closed, count(*) FILTER (o AND c <= '1995-06-17') AS due, count(*) FILTER (o AND reason = 'provisional') AS provisional, min(c) FILTER (o) AS next_check FROM d GROUP BY target"


@query(duck("watch_lines") + WATCH)
def ledger_watch_summary(spark, sf_dir):
    rows = ledger.watch_summary(_lines(spark, sf_dir, "watch_lines"), F.lit("1995-06-17").cast("date"))
    return rows.withColumn("next_check", F.col("next_check").cast("string"))


@query(duck("runs", "features", "queries_", "families", "watch_lines") + """SELECT 'main' AS target, 1 AS format, (SELECT count(*) FROM runs) AS runs, (SELECT arg_max(run_id, line) FROM runs) AS last_run, (SELECT count(*) FROM features WHERE status = 'excluded') AS excluded,
    (SELECT count(*) FROM queries_ WHERE status = 'adopted') AS adopted, (SELECT count(*) FROM families) AS families, (SELECT count(*) FROM watch_lines WHERE closed_run IS NULL) AS open, 0 AS problems""")
def ledger_status(spark, sf_dir):
    lines = _lines(spark, sf_dir, "runs", "features", "queries_", "families", "watch_lines")
    manifest = spark.sql("SELECT 'main' AS target, parse_json('{\"format\": 1, \"target\": \"main\"}') AS v")
    out = ledger.status(manifest.select("target"), _files(spark), lines, manifest, F.lit("1995-06-17").cast("date"))
    return out.select("target", "format", "runs", F.col("last_run.run_id").alias("last_run"), F.col("features")["excluded"].alias("excluded"), F.col("queries")["adopted"].alias("adopted"), "families", F.col("watch.open").alias("open"), F.size("problems").alias("problems"))


@query(duck("runs") + "SELECT target, arg_max(run_id, line) AS run_id, arg_max(mode, line) AS mode FROM runs GROUP BY target")
def ledger_last_run(spark, sf_dir):
    return ledger.last_run(view(spark, sf_dir, "runs"), "run_id", "mode")


@query(duck("features") + "SELECT target, file, line, id, first_line FROM (SELECT *, min(line) OVER (PARTITION BY target, file, id) AS first_line FROM features) WHERE line > first_line")
def ledger_unique_ids(spark, sf_dir):
    return ledger.unique_ids(ledger.ledger_ids(_lines(spark, sf_dir, "features", "queries_"))).select("target", "file", "line", "id", "first_line")


@query(duck("queries_", "runs") + "SELECT target, file, line, 'runs[0].run_id' AS key, 'error' AS severity FROM queries_ WHERE run NOT IN (SELECT run_id FROM runs)")
def ledger_run_refs(spark, sf_dir):
    return _lost(spark, sf_dir, "run-ref", "runs", "features", "queries_", "families")


@query(duck("queries_", "features") + "SELECT target, file, line, 'features[0]' AS key, 'error' AS severity FROM queries_ WHERE feature NOT IN (SELECT id FROM features)")
def ledger_feature_refs(spark, sf_dir):
    return _lost(spark, sf_dir, "feature-ref", "features", "queries_", "families")


@query(duck("families", "watch_lines") + "SELECT target, file, line, 'family_id' AS key, 'warning' AS severity FROM watch_lines WHERE family_id NOT IN (SELECT family_id FROM families)")
def ledger_unknown_families(spark, sf_dir):
    return _lost(spark, sf_dir, "watch-family-unknown", "families", "watch_lines")


@query(duck("runs") + "SELECT target, line, started_at FROM (SELECT *, lag(started_at) OVER (PARTITION BY target ORDER BY line) AS b FROM runs) WHERE started_at < b")
def ledger_run_order(spark, sf_dir):
    return ledger.run_order(view(spark, sf_dir, "runs").select("target", "file", "line", "started_at")).select("target", "line", "started_at")


@query(duck("queries_") + "SELECT target, file, line, 'status' AS key FROM queries_ WHERE status IS NULL")
def ledger_required_keys(spark, sf_dir):
    return _own(spark, sf_dir, "required-key", "runs", "features", "queries_", "families", "watch_lines")


@query(duck("queries_", "features", "families") + "SELECT target, file, line, 'status' AS key FROM queries_ WHERE status = 'kept' UNION ALL SELECT target, file, line, 'priority' FROM features WHERE priority = 'other' UNION ALL SELECT target, file, line, 'stage1' FROM families WHERE stage1 = 'D'")
def ledger_enums(spark, sf_dir):
    return _own(spark, sf_dir, "enum", "runs", "features", "queries_", "families", "watch_lines")


@query(duck("watch_lines") + "SELECT target, file, line, 'next_check' AS key FROM watch_lines WHERE next_check = '2024-13-01'")
def ledger_date_checks(spark, sf_dir):
    return _own(spark, sf_dir, "date", "runs", "watch_lines")


@query(duck("queries_") + "SELECT target, file, line, 'id' AS key FROM queries_ WHERE id LIKE 'q%'")
def ledger_id_formats(spark, sf_dir):
    return _own(spark, sf_dir, "id-format", "runs", "features", "queries_")


@query(duck("queries_", "features") + "SELECT target, file, line, 'reason' AS key FROM queries_ WHERE status = 'rejected' UNION ALL SELECT target, file, line, 'reason' FROM features WHERE status = 'excluded'")
def ledger_reasons(spark, sf_dir):
    return _own(spark, sf_dir, "reason-missing", "features", "queries_")


@query(duck("queries_") + "SELECT target, file, line, 'cql' AS key FROM queries_ WHERE cql LIKE '%PD within%'")
def ledger_query_dates(spark, sf_dir):
    return _own(spark, sf_dir, "cql-date-clause", "queries_")


@query(duck("queries_") + "SELECT target, file, line, 'runs[0].window' AS key FROM queries_ WHERE win <> 'all'")
def ledger_windows(spark, sf_dir):
    return _own(spark, sf_dir, "window", "queries_")


@query(duck("families", "watch_lines") + """SELECT target, file, line, 'pub-spelling' AS rule, 'pubs[0]' AS key FROM families WHERE line % 11 = 0 UNION ALL SELECT target, file, line, 'pub-unparsed', 'pubs[0]' FROM families WHERE line % 11 = 1
    UNION ALL SELECT target, file, line, 'pub-kind', 'pub' FROM watch_lines WHERE line % 15 = 0""")
def ledger_spellings(spark, sf_dir):
    return ledger.line_findings(_lines(spark, sf_dir, "families", "watch_lines"), {"pub-spelling", "pub-kind", "pub-unparsed"}).select("target", "file", "line", "rule", "key")


@query(duck("watch_lines", "runs") + """, m AS (SELECT run_id, arg_max(mode, line) AS mode FROM runs GROUP BY run_id) SELECT w.target, w.file, w.line, CASE WHEN shot_error IS NULL THEN 'snapshot' ELSE 'snapshot-error' END AS rule
    FROM watch_lines w LEFT JOIN m ON m.run_id = w.run WHERE shotless AND coalesce(m.mode, '') <> 'degraded'""")
def ledger_absent_snapshots(spark, sf_dir):
    return ledger.absent_snapshots(_lines(spark, sf_dir, "runs", "watch_lines"), _files(spark)).select("target", "file", "line", "rule")


@query(duck("nation_targets") + """SELECT target, 'ledger.json' AS file, 'target-name' AS rule FROM nation_targets WHERE bad UNION ALL SELECT target, 'translation.md', 'translation-missing' FROM nation_targets WHERE k % 3 = 0 UNION ALL SELECT target, 'runs.jsonl', 'encoding' FROM nation_targets WHERE k % 5 = 0
    UNION ALL SELECT target, f, 'missing-file' FROM nation_targets, (VALUES ('features.jsonl'), ('queries.jsonl'), ('families.jsonl'), ('watch.jsonl')) v(f) WHERE k % 4 = 0""")
def ledger_files(spark, sf_dir):
    t = view(spark, sf_dir, "nation_targets")
    of = lambda condition, names, problem=None: t.where(condition).select("target", F.explode(F.array(*map(F.lit, names))).alias("file"), F.lit(problem).cast("string").alias("problem"))
    files = of("true", [ledger.MANIFEST]).unionByName(of("k % 3 <> 0", [ledger.TRANSLATION])).unionByName(of("k % 4 <> 0", ledger.FILES[1:])).unionByName(of("k % 5 <> 0", ledger.FILES[:1])).unionByName(of("k % 5 = 0", ledger.FILES[:1], "encoding"))
    return ledger.file_findings(t.select("target"), files).select("target", "file", "rule")
