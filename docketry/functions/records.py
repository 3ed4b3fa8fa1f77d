"""Keys, dates, lifetimes and header values of stored records, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import strip

UNIT, LINE = "\x1f", "\x1e"
NON_GREEN = "yellow|red|black"
#: Seconds for which a service rests: by default, at most, and after a refusal.
REST, REST_MOST, BLOCKED = 60, 300, 900
#: Least seconds between requests of each service.
INTERVALS = {"search": 4, "retrieval": 1, "inpadoc": 2, "other": 1, "page": 2}
#: Lifetimes by kind, in hours; none: never expires.
LIFETIMES = {"biblio": 90 * 24, "claims": None, "legal": 7 * 24, "family": 30 * 24, "gp": None, "search": 24, "searchbib": 24}
#: Characters of a text that a message shows.
SHOWN = 80
PUB_KINDS = ("biblio", "claims", "legal", "family", "gp")


def event_key(date: Column, code: Column, desc: Column, pre_lines: Column) -> Column:
    """``[date, code, digest]``: the first eight hex digits over description and lines keep events of one day and code apart."""
    text = F.concat(F.coalesce(desc, F.lit("")), F.lit(UNIT), F.array_join(F.transform(F.coalesce(pre_lines, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), LINE))
    return F.array(F.coalesce(date, F.lit("")), F.coalesce(code, F.lit("")), F.substring(F.sha2(text, 256), 1, 8))


def search_key(query: Column, begin: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat(query, F.lit("\n"), begin.cast("string"), F.lit("-"), end.cast("string")), 256), 1, 16)


def valid_key(key: Column) -> Column:
    return key.rlike(r"^[A-Za-z0-9._-]+$") & ~key.isin(".", "..")


def has_kind_code(key: Column) -> Column:
    """A DOCDB key with a kind code has exactly two dots."""
    return F.length(key) - F.length(F.replace(key, F.lit("."), F.lit(""))) == 2


def gazette_date(text: Column) -> Column:
    """A calendar date from ``YYYYMMDD`` or ``YYYY-MM-DD``, months and days also of one digit; null if there is none."""
    compact = r"^([0-9]{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12][0-9]|0[1-9]|[1-9])$"
    dashed = r"^([0-9]{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9])$"

    def read(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
        return F.try_to_date(F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")

    return F.coalesce(read(compact), read(dashed))


def iso_date(text: Column) -> Column:
    """Strictly ``YYYY-MM-DD``."""
    return F.try_to_date(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), "yyyy-MM-dd")


def date_number(text: Column) -> Column:
    """A ``YYYYMMDD`` date as a number, 0 where it is missing or none; underscores between digits are allowed."""
    clean = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(F.when(clean.rlike(r"^[+-]?[0-9]{1,18}$"), clean.try_cast("bigint")), F.lit(0))


def instant(text: Column) -> Column:
    """A timestamp from ISO text; without an offset it is in the session's time zone."""
    return F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), text))


def with_time(text: Column) -> Column:
    """An instant whose text has a time of day too."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:?[0-9]{2}"), instant(text))


def canonical_time(at: Column) -> Column:
    """UTC seconds with ``+00:00``, for a session in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def since_problem(text: Column) -> Column:
    """Why a lower bound in time is refused, or null; ``instant`` reads a bound that isn't."""
    return F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "blank").when(text.rlike(r"[\x00-\x1F\x7F]"), "control character").when(instant(text).isNull(), "no date or time")


def spell_epoch(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text with the offset of the session's time zone, fractions cut off."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ssxxx")


def tmp_target(name: Column) -> Column:
    """The file that a temporary one was written for, null for other names: ``<name>.tmp`` or ``<name>.<pid>.<random>.tmp``."""
    return F.when(name.endswith(".tmp"), F.regexp_replace(F.regexp_replace(name, r"\.tmp$", ""), r"\.[0-9]+\.[0-9a-f]+$", ""))


def spell_lifetime(hours: Column) -> Column:
    return F.when(hours.isNull(), "never").when(hours % 24 == 0, F.concat((hours / 24).cast("int").cast("string"), F.lit("d"))).when(hours == F.floor(hours), F.concat(hours.cast("int").cast("string"), F.lit("h"))).otherwise(F.concat(F.round(hours * 3600).cast("long").cast("string"), F.lit("s")))


def parse_lifetime(text: str) -> int | None:
    """Hours of ``0`` (never), ``<n>d`` or ``<n>h``; anything else is refused."""
    if text == "0":
        return None
    m = re.fullmatch(r"([1-9][0-9]*)([dh])", text)
    if not m:
        raise ValueError(f"a lifetime is 0, <n>d or <n>h, not {text!r}")
    return int(m[1]) * (24 if m[2] == "d" else 1)


def parse_lifetimes(text: str, kinds: dict[str, int | None] = LIFETIMES) -> dict[str, int | None]:
    """``kind=lifetime,...`` over the defaults; unknown and repeated kinds are refused."""
    out: dict[str, int | None] = {}
    for entry in filter(None, (e.strip() for e in text.split(","))):
        kind, sep, value = entry.partition("=")
        if not sep or kind.strip() not in kinds or kind.strip() in out:
            raise ValueError(f"unknown or repeated kind in {entry!r}")
        out[kind.strip()] = parse_lifetime(value.strip())
    return kinds | out


def throttling(header: Column) -> tuple[Column, Column]:
    """System state, and a map from service to colour and limit; empty where the header has another shape."""
    shape = r"^\s*([A-Za-z_]+)\s*\(([^)]*)\)"
    header = F.coalesce(header, F.lit(""))
    inside = F.regexp_extract(header, shape, 2)
    entry = r"(\w+)=(\w+):([0-9]+)"
    names, colours, limits = (F.regexp_extract_all(inside, F.lit(entry), F.lit(k)) for k in (1, 2, 3))
    # the last entry of a repeated service counts: earlier ones are left out
    rows = F.arrays_zip(names.alias("service"), colours.alias("colour"), limits.alias("limit"))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda q: q["service"] == r["service"]))
    state = F.when(F.size(names) > 0, F.regexp_extract(header, shape, 1)).otherwise("")
    return state, last


def non_green(header: Column) -> Column:
    return F.coalesce(header, F.lit("")).rlike(NON_GREEN)


def retry_seconds(text: Column) -> Column:
    """Seconds of a Retry-After header between 0 and REST_MOST; otherwise REST."""
    value = strip(text).try_cast("double")
    return F.when((value > 0) & (value <= REST_MOST), value).otherwise(float(REST))


def windowed_query(query: Column, searched_through: Column, until: Column, overlap_days: int = 90) -> Column:
    """The query limited to publication dates from ``overlap_days`` before the last run on."""
    return F.format_string('(%s) and pd within "%s %s"', query, F.date_format(F.date_sub(searched_through, overlap_days), "yyyyMMdd"), F.date_format(until, "yyyyMMdd"))


def quoted(text: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def shown(v: Column) -> Column:
    """A VARIANT value for a message: containers by name, texts quoted and cut to ``SHOWN`` characters, all else as JSON."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    cut = F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.lit("..."))).otherwise(text)
    return F.when(kind.like("OBJECT%"), "an object").when(kind.like("ARRAY%"), "an array").when(kind == "STRING", quoted(cut)).when(kind == "VOID", "null").otherwise(F.to_json(v))
