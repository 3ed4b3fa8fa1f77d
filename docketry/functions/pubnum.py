"""Publication numbers as Column expressions: parsed once, rendered in several spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import let, strip

# Limits and office lists that decide what parses.
MAX_DIGITS = 12
LEADING_LETTER_OFFICES = ("JP", "TW", "HU", "BR")
ELEVEN_DIGITS_FROM = 2026
OFFICE_ORDER = ("US", "EP", "WO", "GB", "CA", "AU", "KR", "CN", "JP")

#: Between matched groups.
CUT = "\x01"

# The accepted spellings.  Groups: country, separator, number, leading letters, kind.
PATTERN = (
    r"^([A-Z]{2})([.\- ]?)"
    r"([0-9]{1,12}(?:/[0-9]{1,12})?|([A-Z]{1,2})?[0-9]{1,12}(?:[A-Z]{1,4}[0-9]{4,12})?)"
    r"(?:[.\- ]?([A-Z][0-9]?))?$"
)


def parse(text: Column) -> Column:
    """``struct<country, number, kind>``, null where the text is no publication number; a missing kind is empty.

    US A-documents of an 11-digit number with a year before 2026 take their 10-digit form.
    """
    # one match gives all groups: joined by a character that no number has, and cut there again
    groups = F.regexp_replace(F.upper(strip(text)), PATTERN, CUT.join(f"${k}" for k in range(1, 6)))
    return let(F.when(~F.contains(text, F.lit(CUT)), F.split(groups, CUT)), _read)


def _read(g: Column) -> Column:
    """The number of matched groups, null where the pattern didn't match."""
    number = F.replace(F.get(g, F.lit(2)), F.lit("/"), F.lit(""))
    country, separator, lead, kind = (F.get(g, F.lit(k)) for k in (0, 1, 3, 4))
    valid = (F.size(g) == 5) & (F.length(number) <= MAX_DIGITS) & ((lead == "") | (separator != "") | country.isin(*LEADING_LETTER_OFFICES))
    shrink = (country == "US") & kind.startswith("A") & number.rlike("^(?:19|20)[0-9]{2}0[0-9]{6}$") & (F.substring(number, 1, 4) < F.lit(str(ELEVEN_DIGITS_FROM)))
    number = F.when(shrink, F.concat(F.substring(number, 1, 4), F.substring(number, 6, 12))).otherwise(number)
    return F.when(valid, F.struct(country.alias("country"), number.alias("number"), kind.alias("kind")))


def docdb(p: Column) -> Column:
    return let(p, lambda q: F.when(q.isNotNull(), F.concat(q["country"], F.lit("."), q["number"], F.when(q["kind"] != "", F.concat(F.lit("."), q["kind"])).otherwise(""))))


def epodoc(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat(p["country"], p["number"], p["kind"]))


def _year_first(p: Column, digits: str) -> Column:
    return (p["country"] == "US") & p["number"].rlike(f"^(?:19|20)[0-9]{{2}}{digits}$")


def google(p: Column) -> Column:
    """US numbers of ten digits that begin with a year get a zero after it."""
    padded = F.concat(p["country"], F.substring(p["number"], 1, 4), F.lit("0"), F.substring(p["number"], 5, 12), p["kind"])
    return F.when(_year_first(p, "[0-9]{6}"), padded).otherwise(epodoc(p))


def alternate_docdb(p: Column) -> Column:
    """The other of the 10- and 11-digit spellings of a US number that begins with a year, else null."""
    year = F.substring(p["number"], 1, 4)
    other = F.when(_year_first(p, "[0-9]{6}"), F.concat(year, F.lit("0"), F.substring(p["number"], 5, 12))).when(_year_first(p, "0[0-9]{6}"), F.concat(year, F.substring(p["number"], 6, 12)))
    return F.when(other.isNotNull(), docdb(F.struct(p["country"].alias("country"), other.alias("number"), p["kind"].alias("kind"))))


def key_or_raw(text: Column) -> Column:
    """The DOCDB spelling, or the text itself where it doesn't parse."""
    return F.coalesce(docdb(parse(text)), text)


def office_rank(country: Column) -> Column:
    """0 for the most preferred office; offices not listed and unparseable numbers come last."""
    place = F.array_position(F.array(*map(F.lit, OFFICE_ORDER)), country)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(OFFICE_ORDER)).cast("int")


def full_text_office(country: Column) -> Column:
    """Whether an office's claims can be had as full text."""
    return F.coalesce(country.isin("EP", "WO"), F.lit(False))


def normalize(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``country, number, kind, docdb, epodoc, google, alternate``; null where unparseable."""
    p = F.col("_parsed")
    out = df.withColumn("_parsed", parse(F.col(column)))
    return out.select(*df.columns, p["country"].alias("country"), p["number"].alias("number"), p["kind"].alias("kind"), docdb(p).alias("docdb"), epodoc(p).alias("epodoc"), google(p).alias("google"), alternate_docdb(p).alias("alternate")).drop("_parsed")
