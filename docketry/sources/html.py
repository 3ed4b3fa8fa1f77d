"""Patent pages read with the standard library's parser inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.claims import claim_refs
from docketry.functions.pubnum import docdb, parse
from docketry.functions.text import collapse, strip

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REFERENCE_ROWS = ("backwardReferences", "forwardReferences", "similarDocuments")
# Element, itemprop, and whether reference rows count, of each field; no element stands for any.
FIELDS = {
    "pub_number": ("dd", "publicationNumber", True), "title": ("span", "title", False), "status_display": ("span", "status", True), "expiration": ("time", "expiration", True),
    "priority_date": (None, "priorityDate", False), "publication_date": (None, "publicationDate", False), "assignee": (None, "assigneeCurrent", False),
}
CPC_LEAF = r"^[A-Z][0-9]{2}[A-Z][0-9]+/[0-9]+$"


class _Page(HTMLParser):
    """Collects texts by the elements they stand in: each open element may own a sink."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        # of the open elements by depth: sinks, claims sections, and table rows with a name
        self.sinks: list[tuple[int, list[str]]] = []
        self.in_claims: list[int] = []
        self.rows: list[tuple[int, str]] = []
        self.fields: dict[str, str] = {}
        self.claims: list[tuple[str, list[str], list[str]]] = []
        self.sections: list[list[str]] = []
        self.abstract: list[str] | None = None
        self.codes: list[list[str]] = []
        self.refs: dict[str, list[list[str]]] = {k: [] for k in REFERENCE_ROWS}

    def _row(self) -> str | None:
        return self.rows[-1][1] if self.rows else None

    def handle_starttag(self, tag, attributes):
        a, sink = dict(attributes), None
        prop = a.get("itemprop")
        if tag == "section" and prop == "claims":
            self.sections.append(sink := [])
        elif tag == "section" and prop == "abstract" and self.abstract is None:
            self.abstract = sink = []
        elif tag == "div" and self.in_claims and "claim" in (a.get("class") or "").split() and "num" in a:
            self.claims.append((a["num"] or "", sink := [], []))
        elif tag == "claim-ref" and self.claims:
            self.claims[-1][2].append(a.get("idref") or "")
        elif prop == "Code" and tag == "span":
            self.codes.append(sink := [])
        elif tag == "tr" and prop in self.refs:
            self.refs[prop].append([])
        elif tag == "span" and prop == "publicationNumber" and self._row() in self.refs:
            own = self.refs[self._row()]
            if own and not own[-1]:
                own[-1] = sink = [""]
        else:
            for name, (element, wanted, anywhere) in FIELDS.items():
                if prop == wanted and element in (None, tag) and name not in self.fields and (anywhere or self._row() is None):
                    self.fields[name] = sink = []
        if tag not in VOID:
            depth = len(self.stack)
            self.stack.append(tag)
            if sink is not None:
                self.sinks.append((depth, sink))
            if tag == "section" and prop == "claims":
                self.in_claims.append(depth)
            if tag == "tr" and prop:
                self.rows.append((depth, prop))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                del self.stack[k:]
                while self.sinks and self.sinks[-1][0] >= k:
                    self.sinks.pop()
                while self.in_claims and self.in_claims[-1] >= k:
                    self.in_claims.pop()
                while self.rows and self.rows[-1][0] >= k:
                    self.rows.pop()
                break

    def handle_data(self, data):
        for _, sink in self.sinks:
            sink.append(data)


COLUMNS = "pub string, " + ", ".join(f"{c} string" for c in FIELDS) + ", abstract string, claims array<struct<number: string, text: string, refs: array<string>>>, section_text string, n_sections int, codes array<string>, backward_refs array<string>, forward_refs array<string>, similar array<string>"


def _read(html: str, pub: str) -> tuple:
    page = _Page()
    page.feed(html)
    page.close()
    # a title keeps the white space inside it; other fields are the stripped pieces of their text
    clean = lambda pieces: "".join(p.strip() for p in pieces)
    refs = [[t for r in page.refs[k] if (t := clean(r))] for k in REFERENCE_ROWS]
    return (
        pub, *[("".join if c == "title" else clean)(page.fields.get(c, [])) for c in FIELDS], "".join(page.abstract or []),
        [(n, "".join(t), r) for n, t, r in page.claims], " ".join("".join(s) for s in page.sections), len(page.sections), ["".join(c) for c in page.codes], *refs,
    )


def patent_pages(df: DataFrame, key: str = "pub", body: str = "body") -> DataFrame:
    """One row for each page, texts cleaned; ``error`` where it has no publication number or no claims section.

    A claim refers to what its markup says, else to what its text says; text without numbered claims is kept as
    ``claims_fallback_text``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in ("pub, " + ", ".join(FIELDS) + ", abstract, claims, section_text, n_sections, codes, backward_refs, forward_refs, similar").split(",")]
        for b in batches:
            yield pd.DataFrame([_read(h or "", p) for p, h in zip(b["pub"], b["body"], strict=True)], columns=names)

    raw = df.select(F.col(key).alias("pub"), F.col(body).cast("string").alias("body")).mapInPandas(run, COLUMNS)
    numbered = F.filter("claims", lambda c: c["number"].rlike(r"^\s*[0-9]+\s*$"))
    tidy = F.transform(numbered, lambda c: F.struct(F.trim(c["number"]).try_cast("int").alias("number"), collapse(c["text"]).alias("text"), F.array_distinct(F.filter(F.transform(c["refs"], lambda r: F.regexp_extract(r, r"CLM-0*([0-9]+)", 1).try_cast("int")), lambda n: n.isNotNull())).alias("marked")))
    full = F.transform(tidy, lambda c: F.struct(c["number"].alias("number"), c["text"].alias("text"), F.when(F.size(c["marked"]) > 0, c["marked"]).otherwise(claim_refs(c["text"], c["number"])).alias("depends_on")))
    number = strip(F.col("pub_number"))
    return raw.select(
        F.col("pub").alias("requested"), number.alias("pub_number"), F.coalesce(docdb(parse(number)), F.col("pub")).alias("docdb"), strip(F.col("title")).alias("title"), collapse(F.col("abstract")).alias("abstract"),
        full.alias("claims"), F.array_distinct(F.filter(F.transform("codes", strip), lambda c: c.rlike(CPC_LEAF))).alias("cpc_codes"),
        *[strip(F.col(c)).alias(c) for c in ("status_display", "expiration", "priority_date", "publication_date", "assignee")], "backward_refs", "forward_refs", "similar",
        F.when(F.size(numbered) == 0, collapse(F.col("section_text"))).otherwise("").alias("claims_fallback_text"),
        F.when(number == "", "no publication number").when(F.col("n_sections") == 0, "no claims section").alias("error"),
    )

