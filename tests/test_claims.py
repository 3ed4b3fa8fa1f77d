"""Claims from pages, else from full text."""

from docketry.sources.claims import claims_of


def test_sources_of_claims(spark):
    page = '<html><dd itemprop="publicationNumber">{}</dd><section itemprop="claims"><div class="claim" num="00001"><div class="claim-text">1. A thing.</div></div></section></html>'
    body = "<w><claims lang='EN'><claim-text>1. A thing.</claim-text><claim-text>2. The thing of claim 1.</claim-text></claims></w>"
    f = lambda *rows: spark.createDataFrame(list(rows), "pub string, body string")
    pubs = f(("ep 1 a1", None), ("EP.2.A1", None), ("US.3.A1", None), ("EP.4.A1", None), ("EP.5.A1", None), ("?", None), ("EP1A1", None))
    out = claims_of(pubs, f(("EP.1.A1", page.format("EP1A1")), ("EP.2.A1", "<p>"), ("EP.5.A1", "<p>")), f(("EP2A1", body), ("US.3.A1", body), ("EP.5.A1", "<w")))
    rows = {r.pub: ([c.number for c in r.claims or []], r.source, r.error is not None) for r in out.collect()}
    assert rows == {"EP.1.A1": ([1], "page", False), "EP.2.A1": ([1, 2], "full text", False), "US.3.A1": ([], "unavailable", False), "EP.4.A1": ([], "unavailable", False), "EP.5.A1": ([], "unavailable", True)}
