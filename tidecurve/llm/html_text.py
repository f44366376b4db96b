"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

A page becomes a tree of its elements. Elements that are furniture by their meaning (menus, scripts, buttons, notices
and so on) are taken out. One that only its class, id or style says so of, and a form, stays if it holds half of the
text of the page's articles or more (without articles, of its main elements; without these, of the body): such
as a wrapper "has-sidebar", a form around the page, or a body that scripts show later; comments and related items, which may be articles too, don't. For every other node i with C characters, T tags, LC characters
and LT tags of links, and LCb and Cb those of the body::

    density = C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

(zero counts as one in denominators; the base of the logarithm is e at least, so that pages without
links are defined). The node whose children's densities have the largest sum heads the main text; the threshold is the least
density on the path from the body to it. An article (or main element) around it is taken whole, the widest first, if it is as
dense as the least dense element between it and the body, and so are articles beside it that are text of their own, not teasers. Without such, the
chosen node's siblings and those of its ancestors belong to the text if they reach the threshold, are headings, or are mostly text
outside of links; directly below the body they must also hold sentences, as the small print of a page's foot has no element of its own.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in
page order. Null or empty html gives an empty text and 0; a page of furniture only gives an empty text;
unclosed and misnested tags are closed as needed; a tag that the page's end cuts is dropped; the time follows a page's length
whatever its markup is; each row stands for itself; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The start of a comment, a declaration or a tag; what ends a tag or opens a quoted value within it.
OPENS, NEXT = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))"), re.compile(r">|=\s*([\x22'])")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s'\">]+)))?")
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never main text.
FURNITURE = frozenset("nav aside footer button select option input label dialog menu head object canvas svg audio video datalist".split()) | RAW
#: Elements that are furniture unless they hold much of the page.
WEIGHED = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words in class or id that name furniture.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal overlay footer masthead comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager toolbar skip banner alert googlead googleads adsense adsbygoogle adbox adslot adunit adwrap adcontainer dfp mpu taboola outbrain leaderboard".split())
#: Words that may stand beside those in one class or id: "site-footer" is furniture, "has-sidebar" and "related-work" aren't.
BESIDE = frozenset("site page main global top bottom left right primary secondary box area wrapper container list section block bar link links item items post posts story stories body inner outer heading title text thread form button buttons icon icons unit slot panel row col group js header user reader readers visitor article blog fb facebook twitter web mobile desktop sticky fixed horizontal vertical mega dropdown toggle mini small large inline more also latest recent popular trending view show all count policy".split())
#: With these a header is the site's, not an article's.
SITE = frozenset("header site page main global top web mobile desktop sticky fixed primary wrapper container inner bar".split())
KEPT = frozenset("html body main article".split())
#: Short pieces of a class that say something; others ("td-ad", "c-promo__x") are prefixes and numbers.
SAYING = frozenset("no is in of to on up go my we he it an at by as or so us ad ai tv".split())
HEADINGS, SENTENCES = frozenset("h1 h2 h3 h4 h5 h6".split()), re.compile(r"\w[\w\W]{24,}[.!?…:;\u3002\uff01\uff1f][\x22'\u201d\u00bb)\]]*\s*$")
SMALL_PRINT = re.compile(r"^\W*(©|\(c\)|copyright\b)|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos", re.I)
#: Characters up to which a block may be small print.
SMALL_PRINT_CHARS = 300
#: Share of links up to which a block is text; characters, or share of the main article's, that make an article beside it no teaser.
LINK_SHARE, ARTICLE_CHARS, ARTICLE_SHARE = 0.3, 200, 0.25
REFERENCE = re.compile(r"&#0*([0-9]{8,});?|&#[xX]0*([0-9a-fA-F]{7,});?")
#: Starting one of these ends an open one of those within the same block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": set()}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS, HUMP = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


def _furniture(tag: str, told: str, in_article: bool) -> str:
    """"kind" if an element is furniture by what it is, "name" if its class or id says so, or nothing."""
    if tag in FURNITURE:
        return "kind"
    if tag == "header" and not in_article:
        return "kind"
    if not told.strip(" /"):
        return "name" if tag in WEIGHED else ""
    a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(told)}
    if tag not in KEPT and a.get("role", "") in ROLES:
        return "kind"
    if tag not in KEPT and (tag in WEIGHED or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "") == "form" or HIDDEN.search(a.get("style", ""))):
        return "name"
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w for w in WORDS.findall(HUMP.sub("-", token).lower()) if len(w) > 2 or w in SAYING]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words) or not in_article and "header" in words and SITE.issuperset(words):
            return "name"
    return ""


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers beyond Unicode, of any length, become U+FFFD."""
    return html.unescape(REFERENCE.sub("\ufffd", text))


class Page:
    """The tree as columns over node numbers (parents before children) and the text runs in page order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.out, self.article, self.named = ["html"], [-1], [False], [False], [False]
        self.runs: list[tuple[int, int, str]] = []  # node, block, text
        self.open, self.block = [0], 0
        self.own: set[int] = set()  # nodes of which only what stands in no child is main text
        self.at: dict[str, list[int]] = {}  # tag: depths of its open elements
        self.blocks: list[int] = []  # depths of open blocks
        at, n = 0, len(source)
        for what, start, stop in self._tokens(source):
            if start > at and not self.out[self.open[-1]]:
                self.runs.append((self.open[-1], self.block, decoded(source[at:start])))
            at = stop
            if what is None:
                continue
            tag = what[4].lower()
            if what[3]:
                self._end(tag)
            else:
                told = source[what.end() : stop - 1]
                self._start(tag, told)
                if tag in RAW and not told.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                    at = self.to = close.start() if close else n
        if at < n and not self.out[self.open[-1]]:
            self.runs.append((self.open[-1], self.block, decoded(source[at:])))
        if any(self.named):
            self._settle()

    def _tokens(self, source: str) -> Iterator[tuple[re.Match | None, int, int]]:
        """Tags (or None for comments and declarations), their starts and ends. Each part of a page is passed once or twice:
        what a search doesn't find before the end isn't searched again. A tag that the page's end cuts is dropped."""
        self.to, n, lone = 0, len(source), set()
        while m := OPENS.search(source, self.to):
            if m[1]:
                close = source.find("-->", m.end())
                self.to = close + 3 if close >= 0 else n
                yield None, m.start(), self.to
                continue
            if m[2]:
                close = source.find(">", m.end())
                self.to = close + 1 if close >= 0 else n
                yield None, m.start(), self.to
                continue
            at = m.end()
            while (x := NEXT.search(source, at)) and x[1]:
                quote = x[1]
                close = -1 if quote in lone else source.find(quote, x.end())
                if close < 0:  # no such quote follows: it is a character like others
                    lone.add(quote)
                at = close + 1 or x.end()
            self.to = x.end() if x else n
            yield (m if x else None), m.start(), self.to

    def _settle(self) -> None:
        """Take out what is furniture by name only, but for elements that hold half of the page's prose or more."""
        n = len(self.tag)
        chars = [0] * n
        for node, _, text in self.runs:
            chars[node] += len("".join(text.split()))
        for prose in ("article", "main", "html"):
            inside, held = [False] * n, [0] * n
            for i, p in enumerate(self.parent):
                inside[i] = p >= 0 and inside[p] or self.tag[i] == prose and not (prose == "article" and self.named[i])
                held[i] = chars[i] if inside[i] else 0
            for i in range(n - 1, 0, -1):
                held[self.parent[i]] += held[i]
            if held[0]:
                break
        for i, p in enumerate(self.parent):
            self.out[i] = self.out[i] or p >= 0 and self.out[p] or self.named[i] and self.tag[i] not in KEPT and 2 * held[i] < max(held[0], 1)
        self.runs = [r for r in self.runs if not self.out[r[0]]]

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.at[self.tag[self.open.pop()]].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def _deepest(self, tags: set[str]) -> int:
        """Depth of the innermost open element of some tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _start(self, tag: str, told: str) -> None:
        if tag in BLOCK or tag == "body":
            self.block += 1
            if self.blocks and self.tag[self.open[self.blocks[-1]]] == "p":  # a block ends an open paragraph
                self._close_to(self.blocks[-1])
        if tag in ENDS and (depth := self._deepest(ENDS[tag])) > self._deepest(SCOPE[tag]):
            self._close_to(depth)
        if tag == "html":
            return
        if tag == "br" and not self.out[self.open[-1]]:
            self.runs.append((self.open[-1], self.block, " "))
        up = self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        furniture = _furniture(tag, told, self.article[up])
        self.out.append(self.out[up] or furniture == "kind")
        self.named.append(furniture == "name")
        self.article.append(self.article[up] or tag in ("article", "main"))
        if tag not in VOID and not told.endswith("/"):
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        depth = self._deepest({tag})
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):  # an inline end tag doesn't reach out of its block
            self._close_to(depth)

    def main_nodes(self) -> set[int] | None:
        """Heads of the subtrees that are the main text; None if there is none."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in self.runs:
            chars[node] += len("".join(text.split()))
        for i in range(n - 1, -1, -1):
            if self.tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
            if (p := self.parent[i]) >= 0 and not self.out[i]:
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
        if not chars[0]:
            return None
        ratio = link_chars[0] / chars[0]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.out[i] or not chars[i]:
                continue
            c, lc = chars[i], link_chars[i]
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            density[i] = c / max(tags[i], 1) * math.log(max(1.0, c / max(lc, 1) * max(tags[i], 1) / max(link_tags[i], 1))) / math.log(max(base, math.e))
            if self.parent[i] >= 0:
                total[self.parent[i]] += density[i]
        head = max(range(min(1, n - 1), n), key=lambda i: total[i])  # below html, if there is anything
        path = [head]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        least = min(density[i] for i in path if self.tag[i] != "html" or len(path) == 1)
        # An article is whole if it is as dense as what surrounds it is somewhere; else its parts are chosen as others are.
        around = math.inf
        for i in reversed(path):
            if self.tag[i] in ("article", "main") and (density[i] >= around or around == math.inf):
                return {i} | self._articles(i, chars, link_chars)
            around = min(around, density[i]) if self.tag[i] != "html" else around
        if not total[head]:
            return {0}
        if self.tag[head] in ("body", "html"):  # its children are weighed one by one
            whole = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.out[i] and 2 * chars[i] >= chars[0]]
            if whole:
                return {whole[0]} | self._articles(whole[0], chars, link_chars)
            self.own = {head}
        up = set(path)
        first, last = self._places()

        def belongs(i: int) -> bool:
            told = "" if chars[i] > SMALL_PRINT_CHARS else " ".join("".join(t for _, _, t in self.runs[first[i] : last[i] + 1]).split())
            if SMALL_PRINT.search(told):
                return False
            if density[i] >= least or self.tag[i] in HEADINGS:
                return True
            if link_chars[i] > LINK_SHARE * chars[i]:
                return False
            if self.tag[self.parent[i]] not in ("body", "html"):
                return True
            return chars[i] > SMALL_PRINT_CHARS or bool(SENTENCES.search(told))

        beside = {i for i in range(n) if self.parent[i] in up and i not in up and (self.parent[i] != head or head in self.own) and not self.out[i] and chars[i] and self.tag[i] in BLOCK}
        return ({head} - self.own) | {i for i in beside if belongs(i)}

    def _articles(self, chosen: int, chars: list[int], link_chars: list[int]) -> set[int]:
        """Other articles of the page, outside of the chosen one and of each other, that are text and no teasers."""
        found: set[int] = set()
        inside = [False] * len(self.tag)
        for i, p in enumerate(self.parent):
            inside[i] = i == chosen or p >= 0 and inside[p]
            if self.tag[i] == "article" and not inside[i] and not self.out[i] and not self.named[i]:
                inside[i] = True
                if chars[i] >= min(ARTICLE_CHARS, ARTICLE_SHARE * chars[chosen]) and link_chars[i] <= LINK_SHARE * chars[i]:
                    found.add(i)
        up = chosen
        while up >= 0:  # an article around the chosen one was passed over
            found.discard(up)
            up = self.parent[up]
        return found

    def _places(self) -> tuple[list[int], list[int]]:
        """The first and the last text run within each node."""
        n, runs = len(self.tag), len(self.runs)
        first, last = [runs] * n, [-1] * n
        for k, (node, _, _) in enumerate(self.runs):
            first[node], last[node] = min(first[node], k), k
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            first[p], last[p] = min(first[p], first[i]), max(last[p], last[i])
        return first, last

    def text(self) -> str:
        heads = self.main_nodes()
        if heads is None:
            return ""
        inside = [False] * len(self.tag)
        for i, p in enumerate(self.parent):
            inside[i] = not self.out[i] and (i in heads or p >= 0 and inside[p])
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.runs:
            if inside[node] or node in self.own:
                blocks.setdefault(block, []).append(text)
        shown = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in shown if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"))
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return named.mapInArrow(run, f"key {kind(key)}, url {kind(url)}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
