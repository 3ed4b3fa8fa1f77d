"""Office XML parsed with from_xml: prefixed names, text kept as it is, malformed bodies as null rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.claims import claim_refs, split_claims
from docketry.functions.text import collapse, strip

#: Attributes are fields with an underscore before the name; text beside attributes is _VALUE.
OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
_ID = "`document-id`: array<struct<`_document-id-type`: string, country: string, `doc-number`: string, kind: string, date: string>>"
_TEXTS = "array<struct<_lang: string, _VALUE: string>>"
_DOCUMENT = f"""array<struct<_country: string, `_doc-number`: string, _kind: string, `_family-id`: string,
  `bibliographic-data`: struct<`publication-reference`: struct<{_ID}>, `invention-title`: {_TEXTS},
    `classifications-ipcr`: struct<`classification-ipcr`: array<struct<text: string>>>,
    `patent-classifications`: struct<`patent-classification`: array<struct<`classification-scheme`: struct<_scheme: string>, section: string, class: string, subclass: string, `main-group`: string, subgroup: string>>>,
    parties: struct<applicants: struct<applicant: array<struct<`_data-format`: string, `applicant-name`: struct<name: string>>>>, inventors: struct<inventor: array<struct<`_data-format`: string, `inventor-name`: struct<name: string>>>>>,
    `references-cited`: struct<citation: array<struct<patcit: struct<{_ID}>, nplcit: struct<text: string>>>>>,
  abstract: array<struct<_lang: string, p: array<string>>>>>"""
BIBLIO = f"""`exchange-documents` struct<`exchange-document`: {_DOCUMENT}>, _bad string"""
FAMILY = f"""`ops:patent-family` struct<`ops:family-member`: array<struct<`_family-id`: string, `publication-reference`: struct<{_ID}>>>>, _bad string"""


def _parsed(df: DataFrame, body: str, schema: str) -> DataFrame:
    # the outer element is the row; a prefix on it is part of its name
    inner = F.regexp_replace(F.col(body), r"^\s*<\?xml[^>]*\?>\s*|(?s)<!--.*?-->", "")
    return df.withColumn("x", F.from_xml(inner, schema, OPTIONS))


def docdb_of(ids: Column) -> Column:
    """The DOCDB spelling of the first docdb-type id; null where country or number is missing."""
    one = F.try_element_at(F.filter(ids, lambda d: d["_document-id-type"] == "docdb"), F.lit(1))
    return F.when(one["country"].isNotNull() & one["doc-number"].isNotNull(), F.concat(strip(one["country"]), F.lit("."), strip(one["doc-number"]), F.when(F.coalesce(strip(one["kind"]), F.lit("")) != "", F.concat(F.lit("."), strip(one["kind"]))).otherwise("")))


def english(texts: Column) -> Column:
    """The English entry, whatever the case of its mark, else the first one."""
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: F.lower(t["_lang"]) == "en"), F.lit(1)), F.try_element_at(texts, F.lit(1)))


def _names(rows: Column, holder: str) -> Column:
    clean = lambda some: F.array_distinct(F.filter(F.transform(some, lambda r: F.regexp_replace(strip(r[holder]["name"]), "[, ]+$", "")), lambda n: F.coalesce(n, F.lit("")) != ""))
    none = F.array().cast("array<string>")
    own = F.coalesce(clean(F.filter(rows, lambda r: r["_data-format"] == "original")), none)
    rest = F.coalesce(clean(F.filter(rows, lambda r: ~F.coalesce(r["_data-format"] == "original", F.lit(False)))), none)
    return F.when(F.size(own) > 0, own).otherwise(rest)


def biblio(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """One row for each exchange document of a body, or one with ``error`` where there is none; one without bibliographic data has an error too.

    The publication is that of the document's own attributes.  Titles keep their inner white space.
    """
    return _documents(_parsed(df, body, BIBLIO).select(F.col(key).alias("requested"), F.posexplode_outer("x.exchange-documents.exchange-document").alias("pos", "d")))


def _documents(rows: DataFrame) -> DataFrame:
    """Fields of exchange documents ``requested, pos, d``."""
    data = F.col("d")["bibliographic-data"]
    ids = data["publication-reference"]["document-id"]
    none = F.array().cast("array<string>")
    filled = lambda c, k: F.coalesce(strip(c[k]), F.lit(""))
    parts = ("section", "class", "subclass", "main-group", "subgroup")
    whole = lambda c: reduce(lambda a, b: a & b, [filled(c, k) != "" for k in parts])
    cpc = F.filter(data["patent-classifications"]["patent-classification"], lambda c: F.coalesce(F.upper(c["classification-scheme"]["_scheme"]).startswith("CPC"), F.lit(False)) & whole(c))
    cited = data["references-cited"]["citation"]
    own = lambda k: F.coalesce(F.col("d")[k], F.lit(""))
    pub = F.concat(own("_country"), F.lit("."), own("_doc-number"), F.when(own("_kind") != "", F.concat(F.lit("."), own("_kind"))).otherwise(""))
    there = F.col("d").isNotNull() & data.isNotNull()
    return rows.select(
        "requested", "pos", F.when(there, pub).alias("pub"), own("_family-id").alias("family_id"),
        F.coalesce(strip(english(data["invention-title"])["_VALUE"]), F.lit("")).alias("title"),
        F.coalesce(collapse(english(F.transform(F.col("d")["abstract"], lambda a: F.struct(a["_lang"].alias("_lang"), F.array_join(a["p"], "\n").alias("_VALUE"))))["_VALUE"]), F.lit("")).alias("abstract"),
        _names(data["parties"]["applicants"]["applicant"], "applicant-name").alias("applicants"), _names(data["parties"]["inventors"]["inventor"], "inventor-name").alias("inventors"),
        F.coalesce(F.filter(F.transform(data["classifications-ipcr"]["classification-ipcr"], lambda c: collapse(c["text"])), lambda t: t != ""), none).alias("ipc"),
        F.coalesce(F.array_distinct(F.transform(cpc, lambda c: F.concat(*[filled(c, k) for k in parts[:4]], F.lit("/"), filled(c, "subgroup")))), none).alias("cpc"),
        F.coalesce(strip(F.try_element_at(F.filter(ids, lambda d: d["_document-id-type"] == "docdb"), F.lit(1))["date"]), F.lit("")).alias("publication_date"),
        F.coalesce(F.array_compact(F.transform(cited, lambda c: docdb_of(c["patcit"]["document-id"]))), none).alias("cited_patents"),
        F.coalesce(F.size(F.filter(cited, lambda c: c["nplcit"].isNotNull())), F.lit(0)).alias("npl_citation_count"),
        F.when(~there, "upstream_data").alias("error"),
    )


def family(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """``requested, family_id, members, error``: distinct members in order, incomplete ones left out; the id is the first member's."""
    members = F.col("x")["ops:patent-family"]["ops:family-member"]
    wrapped = _parsed(df, body, FAMILY)
    ids = F.array_distinct(F.array_compact(F.transform(members, lambda m: docdb_of(m["publication-reference"]["document-id"]))))
    return wrapped.select(F.col(key).alias("requested"), F.coalesce(F.try_element_at(members, F.lit(1))["_family-id"], F.lit("")).alias("family_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("members"), F.when(members.isNull(), "upstream_data").alias("error"))


def _element(body: str) -> ElementTree.Element | None:
    """The outer element, None for a body that isn't well-formed or declares entities of its own."""
    try:
        return None if "<!ENTITY" in body else ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return None


def _legal_events(body: str) -> tuple[list[tuple], str | None]:
    """Events with text as it stands; ElementTree keeps what from_xml can't: children of any name beside mixed text."""
    root = _element(body)
    if root is None:
        return [], "upstream_data"
    local = lambda e: e.tag.rpartition("}")[2]
    events = []
    for e in root.iter():
        if local(e) == "legal":
            # the first date that isn't empty counts
            dates = ((c.text or "").strip() for c in e if local(c) != "pre" and c.get("desc") == "Gazette DATE")
            events.append(((e.get("code") or "").strip(), (e.get("desc") or "").strip(), next(filter(None, dates), ""), [c.text or "" for c in e if local(c) == "pre"]))
    section = any(local(e) == "patent-family" and e.get("legal") == "true" for e in root.iter())
    return events, None if events or section else "upstream_data"


def _claim_texts(body: str) -> tuple[str | None, str | None]:
    """The English claims, else the first language's: outermost claim-text elements joined by line feeds."""
    root = _element(body)
    if root is None:
        return None, "upstream_data"
    local = lambda e: e.tag.rpartition("}")[2]
    sections = [e for e in root.iter() if local(e) == "claims"]
    if not sections:
        return None, "upstream_data"
    chosen = next((s for s in sections if (s.get("lang") or "").lower() == "en"), sections[0])
    out: list[str] = []

    def gather(e) -> None:
        for child in e:
            if local(child) == "claim-text":
                out.append("".join(child.itertext()))
            else:
                gather(child)

    gather(chosen)
    return "\n".join(out), None


def legal_events(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """``pub, pos, code, desc, gazette_date, pre_lines, error``: one row for each event, or one with an error.

    An event without a code has an empty one.  A section without events has no row; a body without a section, which
    every fault is, is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pub, text in zip(b["pub"], b["body"], strict=True):
                events, error = _legal_events(text or "")
                rows += [(pub, i, *e, None) for i, e in enumerate(events)] or ([(pub, None, None, None, None, None, error)] if error else [])
            yield pd.DataFrame(rows, columns=["pub", "pos", "code", "desc", "gazette_date", "pre_lines", "error"]).astype({"pos": "Int64"})

    return df.select(F.col(key).alias("pub"), F.col(body).cast("string").alias("body")).mapInPandas(run, "pub string, pos long, code string, `desc` string, gazette_date string, pre_lines array<string>, error string")


def claim_bodies(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """``pub, text, error`` of full-text claims."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(pub, *_claim_texts(text or "")) for pub, text in zip(b["pub"], b["body"], strict=True)]
            yield pd.DataFrame(rows, columns=["pub", "text", "error"])

    return df.select(F.col(key).alias("pub"), F.col(body).cast("string").alias("body")).mapInPandas(run, "pub string, text string, error string")


def claims(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """``pub, number, text, depends_on, error`` of the numbered claims in full-text bodies.

    A body that can't be read, has no claims section or no numbered claim is one row with an error.
    """
    whole = claim_bodies(df, key, body).select(F.struct("pub", "error").alias("of"), "text")
    cut = split_claims(whole, "of", "text", unnumbered=True)
    error = F.coalesce("of.error", F.when(F.col("number").isNull(), "upstream_data"))
    return cut.select("of.pub", "number", "text", F.when(F.col("number").isNotNull(), claim_refs(F.col("text"), F.col("number"))).alias("depends_on"), error.alias("error"))


#: Prefixed and bare spellings of a search response; what isn't there is null.
SEARCH = f"""`ops:biblio-search` struct<`_total-result-count`: string, `ops:query`: struct<_VALUE: string, _syntax: string>, `ops:range`: struct<_begin: string, _end: string>,
  `ops:search-result`: struct<`ops:publication-reference`: array<struct<`_family-id`: string, {_ID}>>, `exchange-documents`: array<struct<`exchange-document`: {_DOCUMENT}>>>>,
  code string, `ops:code` string, _bad string"""
NOT_FOUND = "SERVER.EntityNotFound"


def _searched(df: DataFrame, body: str) -> tuple[DataFrame, Column, Column]:
    """Parsed bodies, the fault's code, and the search section."""
    fault = F.coalesce(F.col("x")["ops:code"], F.col("x")["code"])
    return _parsed(df, body, SEARCH), strip(fault), F.col("x")["ops:biblio-search"]


def _page_columns(code: Column, found: Column) -> list[Column]:
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("long"))
    none = F.coalesce(code == NOT_FOUND, F.lit(False))
    return [
        F.when(none, F.lit(0).cast("long")).when(found.isNotNull(), number(found["_total-result-count"])).alias("total_count"), F.coalesce(strip(found["ops:query"]["_VALUE"]), F.lit("")).alias("searched"),
        number(found["ops:range"]["_begin"]).alias("begin"), number(found["ops:range"]["_end"]).alias("end"), F.when(~none & found.isNull(), "upstream_data").alias("error"),
    ]


def search_page(df: DataFrame, key: str = "query", body: str = "body") -> DataFrame:
    """``query, total_count, searched, begin, end, hits, error`` of search results: hits in order, as ``pub, family_id``.

    A fault that nothing was found is an empty page; another fault or body is an error.
    """
    rows, code, found = _searched(df, body)
    hits = F.transform(found["ops:search-result"]["ops:publication-reference"], lambda r: F.struct(docdb_of(r["document-id"]).alias("pub"), F.coalesce(r["_family-id"], F.lit("")).alias("family_id")))
    return rows.select(F.col(key).alias("query"), *_page_columns(code, found), F.coalesce(hits, F.array().cast("array<struct<pub: string, family_id: string>>")).alias("hits"))


def search_hits(df: DataFrame, key: str = "query", body: str = "body") -> DataFrame:
    """``query, pos, pub, family_id``: one row for each hit of a search result."""
    # an inner explode would infer a filter on hits, which parses every body once more, and in the task that reads it
    held = search_page(df, key, body).select("query", F.posexplode_outer("hits").alias("pos", "h")).where("pos IS NOT NULL")
    return held.select("query", "pos", "h.pub", "h.family_id")


def search_biblio_page(df: DataFrame, key: str = "query", body: str = "body") -> DataFrame:
    """``query, total_count, searched, begin, end, docs, error`` of searches that answer with documents; ``docs`` is their number."""
    rows, code, found = _searched(df, body)
    docs = F.aggregate(found["ops:search-result"]["exchange-documents"], F.lit(0), lambda n, d: n + F.coalesce(F.size(d["exchange-document"]), F.lit(0)))
    return rows.select(F.col(key).alias("query"), *_page_columns(code, found), F.coalesce(docs, F.lit(0)).alias("docs"))


def search_biblio(df: DataFrame, key: str = "query", body: str = "body") -> DataFrame:
    """The documents of such searches as ``biblio`` gives them, in order; a search without any has no row here."""
    rows, _, found = _searched(df, body)
    held = F.transform(found["ops:search-result"]["exchange-documents"], lambda h: h["exchange-document"])
    docs = F.flatten(F.filter(held, lambda d: d.isNotNull()))
    return _documents(rows.select(F.col(key).alias("requested"), F.posexplode_outer(docs).alias("pos", "d")).where("pos IS NOT NULL"))
