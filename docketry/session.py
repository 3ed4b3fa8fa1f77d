"""A session with the settings the operators expect, and the SQL functions they offer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docketry.functions import claims, pubnum
from docketry.functions.text import SPACE


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """ANSI SQL, UTC, adaptive plans; partitions are Spark's own unless given."""
    builder = SparkSession.builder.appName("docketry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    register_functions(spark)
    return spark


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


_CLEAN = f"upper(regexp_replace(spelling, {_literal(f'^{SPACE}+|{SPACE}+$')}, ''))"
_GROUP = [f"regexp_extract({_CLEAN}, {_literal(pubnum.PATTERN)}, {k})" for k in range(6)]
_NUMBER = f"replace({_GROUP[3]}, '/', '')"
_OLD_US = f"({_GROUP[1]} = 'US' AND startswith({_GROUP[5]}, 'A') AND rlike({_NUMBER}, '^(?:19|20)[0-9][0-9]0[0-9]{{6}}$') AND left({_NUMBER}, 4) < '{pubnum.ELEVEN_DIGITS_FROM}')"
_PARSE = f"""CASE WHEN {_GROUP[1]} <> '' AND length({_NUMBER}) <= {pubnum.MAX_DIGITS} AND ({_GROUP[4]} = '' OR {_GROUP[2]} <> '' OR {_GROUP[1]} IN {pubnum.LEADING_LETTER_OFFICES})
    THEN named_struct('country', {_GROUP[1]}, 'number', CASE WHEN {_OLD_US} THEN concat(left({_NUMBER}, 4), substr({_NUMBER}, 6)) ELSE {_NUMBER} END, 'kind', {_GROUP[5]}) END"""
_BEFORE = f"CASE WHEN claim_number > 1 AND rlike(claim, {_literal(claims.PRECEDING)}) THEN sequence(1, claim_number - 1) ELSE array() END"
_PARTS = f"flatten(transform(regexp_extract_all(coalesce(claim, ''), {_literal(claims.LISTS)}, 1), t -> regexp_extract_all(regexp_replace(t, {_literal(claims.TO)}, '-'), '([0-9]+-[0-9]+|[0-9]+)', 1)))"
_FIRST, _LAST = "coalesce(try_cast(regexp_extract(p, '^([0-9]+)', 1) AS INT), 0)", "try_cast(regexp_extract(p, '-([0-9]+)$', 1) AS INT)"
_NAMED = f"flatten(transform({_PARTS}, p -> CASE WHEN {_LAST} IS NULL THEN array({_FIRST}) WHEN {_LAST} BETWEEN {_FIRST} AND {_FIRST} + {claims.SPAN} THEN sequence({_FIRST}, greatest({_LAST}, {_FIRST})) ELSE array({_FIRST}, {_LAST}) END))"
_REFS = f"filter(array_distinct(concat({_BEFORE}, {_NAMED})), n -> n > 0 AND NOT coalesce(n = claim_number, false))"
#: SQL functions, each an expression that Catalyst inlines.
SQL_FUNCTIONS = {
    "search_key": ("query STRING, first INT, last INT", "STRING", "substring(sha2(concat(query, '\\n', first, '-', last), 256), 1, 16)"),
    "event_digest": ("description STRING, pre_lines ARRAY<STRING>", "STRING", "substring(sha2(concat(coalesce(description, ''), char(31), array_join(transform(coalesce(pre_lines, array()), x -> coalesce(x, '')), char(30))), 256), 1, 8)"),
    "parse_pubnum": ("spelling STRING", "STRUCT<country: STRING, number: STRING, kind: STRING>", _PARSE),
    "extract_claim_refs": ("claim STRING, claim_number INT", "ARRAY<INT>", _REFS),
    "has_kind_code": ("key STRING", "BOOLEAN", "length(key) - length(replace(key, '.', '')) = 2"),
}


def register_functions(spark: SparkSession) -> None:
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
