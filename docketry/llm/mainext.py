"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by where they stand (menus,
footers, forms and the like), by link density, length and stop-word density.  Short blocks stay open, and the
second pass gives them the label of their nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import only, text_or_empty

# Element names of HTML.
#: Elements whose content is never text.
DROPPED = frozenset("script style noscript template svg iframe object canvas video audio map head title textarea select option datalist button".split())
#: Elements whose content stands beside an article.
ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
#: Elements that begin and end blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTION = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag of these closes what is left open inside.
SCOPES = BLOCK - frozenset(["p", "hr"])
# Words in class, id and role by which pages mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored sponsors promo promoted promotion promotions"
    " nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toolbar topbar"
    " sidebar sidebars rail widget widgets related recommended recommendations trending popular teaser"
    " footer masthead"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer paywall"
    " comment comments commentlist respond reply replies discussion disqus"
    " share sharing social subscribe subscription newsletter signup login signin search searchbox contentinfo complementary dialog alertdialog".split()
)
# Words that turn such a word into a remark on the layout, as in "has-sidebar" or "ad-free".
LAYOUT = frozenset("has have with without no not non free is".split())
# Frequent function words of English, German, Spanish and French.
STOP_WORDS = frozenset(
    "the of and to a in is it that for was are be with as on by this from at or an not which have has had were but they you we his her she he their its if will would can"
    " der die das und in von zu den mit ist des auf für im dem nicht ein eine als auch es an er sich aus sie nach wie bei"
    " de la el los las y que en un una por con para del se su al lo es como más pero sus le"
    " le les des du et une est dans pour qui sur pas au par plus avec ne ce il sont cette ou aux".split()
)
#: Characters from which a block is long, and below which it is short.
LONG, SHORT = 200, 70
#: A container with this share of the page's text is no notice or sidebar, whatever its name.
WHOLE = 0.9
STOP_HIGH, STOP_LOW = 0.30, 0.10
LINKS = 0.4

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^"'<>]++|"[^"]*"|'[^']*')*+)>|<[!?][^<>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    section: int
    noise: bool
    label: str = field(default="")


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its class, id or role names it as something beside the article."""
    hidden = named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                named = named or not (NOISE.isdisjoint(words) or words & LAYOUT)
    return hidden, named


class _Reader:
    """Cuts a page into blocks.  Tags left open or closed wrongly end with the element around them."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: Of the block: innermost container whose name marks it, or -1.
        self.held_by: list[int] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # element, whether it stands aside from here on, number of its article, marked container
        #: Of marked containers: the one around it, whether it holds an article, characters of its own blocks.
        self.around: list[int] = []
        self.has_article: list[bool] = []
        self.is_article: list[bool] = []
        self.text: list[str] = []
        self.links, self.heading, self.in_links, self.sections = 0, False, 0, 0
        #: An inline element whose text is left out, and how deep elements of its name are open in it.
        self.muted: tuple[str, int] | None = None

    def close(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined:
            _, aside, section, mark = self.stack[-1] if self.stack else ("", False, 0, -1)
            self.blocks.append(Block(joined, self.links, self.heading, section, aside))
            self.held_by.append(mark)
        self.text.clear()
        self.links, self.heading = 0, False

    def say(self, raw: str) -> None:
        if raw and not self.muted:
            plain = html.unescape(raw)
            self.text.append(plain)
            if self.in_links:
                self.links += len(" ".join(plain.split()))

    def start(self, name: str, attributes: str, closed: bool) -> None:
        if self.muted and name == self.muted[0] and not closed:
            self.muted = (name, self.muted[1] + 1)
        if name == "br" and not self.muted:
            self.text.append(" ")
        elif name == "a":
            self.in_links += 1
        elif name in BLOCK:
            self.close()
            if name == "p" and self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            self.heading = name in HEADING
            if name not in VOID and not closed:
                _, aside, section, mark = self.stack[-1] if self.stack else ("", False, 0, -1)
                hidden, named = _marks(attributes) if attributes else (False, False)
                if name in SECTION:
                    self.sections += 1
                    section = self.sections
                    if mark >= 0:
                        self.has_article[mark] = True
                if named and name not in ("html", "body", "main"):
                    self.around.append(mark)
                    self.has_article.append(name == "article")
                    self.is_article.append(name == "article")
                    mark = len(self.around) - 1
                self.stack.append((name, aside or hidden or name in ASIDE or (name == "header" and not section), section, mark))
        elif attributes and name not in VOID and not closed and not self.muted and any(_marks(attributes)):
            self.muted = (name, 1)

    def end(self, name: str) -> None:
        if self.muted and name == self.muted[0]:
            self.muted = (name, self.muted[1] - 1) if self.muted[1] > 1 else None
        if name == "a":
            self.in_links = max(0, self.in_links - 1)
        if name in BLOCK:
            self.close()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    del self.stack[k:]
                    # an inline element left open ends here too
                    self.muted = None
                    break
                if self.stack[k][0] in SECTION and name not in SCOPES:
                    break

    def finish(self) -> list[Block]:
        """The blocks; a container's name counts against what is in it, unless it holds the page's article or nearly all of its text.

        An article inside it doesn't make it the page's: comments and teasers are articles too.  It is, if hardly any
        text of an article lies outside; where each of several named containers has one, an article with a name of
        its own, then the largest.
        """
        self.close()
        size, of_articles = [0] * len(self.around), [0] * len(self.around)
        total, articles = 0, 0
        for block, mark in zip(self.blocks, self.held_by, strict=True):
            if not block.noise:
                n, own = len(block.text), len(block.text) if block.section else 0
                total, articles = total + n, articles + own
                if mark >= 0:
                    size[mark] += n
                    of_articles[mark] += own
        # containers come before those inside them
        for k in range(len(self.around) - 1, -1, -1):
            if (up := self.around[k]) >= 0:
                size[up] += size[k]
                of_articles[up] += of_articles[k]
                self.has_article[up] = self.has_article[up] or self.has_article[k]
        whole = [size[k] >= WHOLE * total or (self.has_article[k] and articles - of_articles[k] < LONG) for k in range(len(self.around))]
        if articles >= LONG and not any(b.section and not b.noise and m < 0 for b, m in zip(self.blocks, self.held_by, strict=True)) and not any(whole):
            # an article with a name of its own comes before one in a container with a name
            best = max((k for k in range(len(self.around)) if self.has_article[k]), key=lambda k: (self.is_article[k] and self.around[k] < 0, of_articles[k], k), default=-1)
            while best >= 0:
                whole[best], best = True, self.around[best]
        beside: list[bool] = []
        for k, up in enumerate(self.around):
            beside.append((up >= 0 and beside[up]) or not whole[k])
        for block, mark in zip(self.blocks, self.held_by, strict=True):
            block.noise = block.noise or (mark >= 0 and beside[mark])
        return self.blocks


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    reader, at = _Reader(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        reader.say(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            reader.end(name)
        elif name == "title":
            end = re.compile(r"</title\s*>|<body\b", re.IGNORECASE).search(page, at)
            at = (end.end() if end[0][1] == "/" else end.start()) if end else len(page)
        elif name in DROPPED:
            if name != "head":
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
                # content left open runs to the end, as it does in a browser
                at = end.end() if end else len(page)
                reader.text.append(" ")
        else:
            reader.start(name, m[3], m[3].rstrip().endswith("/"))
    return reader.finish()


def classify(blocks: list[Block]) -> None:
    """Label blocks ``good`` or ``bad``: decided ones first, then open ones by their nearest decided neighbour."""
    has_section = any(b.section and not b.noise for b in blocks)
    for b in blocks:
        n = len(b.text)
        words = b.text.lower().split()
        stop = sum(w.strip(".,;:!?\"'()*#$%&|") in STOP_WORDS for w in words) / len(words)
        links = b.link_chars / n
        if b.noise or (has_section and not b.section):
            b.label = "bad"
        elif links > LINKS:
            b.label = "bad" if n < LONG or stop < STOP_LOW else "open"
        elif b.section and n >= SHORT:
            b.label = "good"
        elif n >= LONG:
            b.label = "good" if stop >= STOP_LOW else "open"
        elif n >= SHORT and stop >= STOP_HIGH:
            b.label = "good"
        else:
            b.label = "open"
    # what a block's place decides says nothing about its neighbours
    decided = [i for i, b in enumerate(blocks) if b.label != "open" and not b.noise and (b.section or not has_section)]
    some_good = any(blocks[i].label == "good" for i in decided)
    own: dict[int, list[int]] = {}
    for i in decided:
        own.setdefault(blocks[i].section, []).append(i)
    labels = {i: blocks[i].label for i in decided}
    for i, b in enumerate(blocks):
        if b.label != "open":
            continue
        # neighbours in another article count only where this one has none
        if not some_good or (b.section and b.section not in own):
            # nothing to inherit from: an article of short blocks alone
            b.label = "bad" if b.link_chars > LINKS * len(b.text) else "good"
        else:
            b.label = labels[_nearest(own.get(b.section, decided), i, labels)]


def _nearest(places: list[int], i: int, labels: dict[int, str]) -> int:
    """The place nearest to ``i``; of two as near, one labelled good."""
    k = bisect_left(places, i)
    return min(places[max(k - 1, 0) : k + 1], key=lambda p: (abs(p - i), labels[p] != "good"))


def main_text(page: str) -> str:
    """Good blocks in page order, joined by a line feed; white space inside a block is one space."""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; whole pages are read, null counts as empty.

    Broken markup and pages without an article give what the rules find, or an empty text.  Rows are
    independent: repeated rows are repeated, an empty table gives none, other columns are ignored.  No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = only(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", "url", text_or_empty("html").alias("html"))
    return rows.mapInPandas(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
