"""Main text of web pages, with site templates removed.

A page is read into element subtrees. Boilerplate elements are left out: by tag, by a word of the class, a whole id or role, or by a
first or last part of such a word (`comment-list`, `siteFooter`), but for articles and headings. What is marked or a form stays if it
holds more of article or main than stands outside of such elements; without either, what only a part marks stays if it holds two
thirds of the page's text. A form also stays if it holds the page's h1 or all its text. The main region is the article, unless main holds more text beside it, else main, else the
body. Every subtree of a block element of the region is hashed (words marked up inside a sentence stay), and Spark counts
for each host in how many different main texts a subtree occurs: exact copies of an article count once, so that
copying does not make a text a template. Subtrees that recur across many of a host's texts are deleted.

A host has at most (subtrees in a page) / SHARE such templates, so one row a host holds them. They are broadcast
while they number BROADCAST_TEMPLATES at most, and joined by host beyond.

Defined results: null html is empty and has an empty text; broken markup is read as far as it goes; a null url, or
one without a host, belongs to the empty host; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .url_filter import split_url

#: A template recurs in so many different main texts of its host, and in such a share of them: inside an article or main, or elsewhere.
MIN_TEXTS, SHARE_INSIDE, SHARE_OUTSIDE = 8, 0.5, 0.3
BROADCAST_TEMPLATES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer head iframe input map menu nav noscript object script select style svg template textarea title video".split())
FORMS = frozenset(["fieldset", "form"])
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
WHOLE = frozenset(["html", "body", "main", "article"])
UNMARKED = HEADINGS | WHOLE
#: An element is left out: not, unless it holds the article, or in any case.
KEPT, UNLESS_HOLDING, LEFT_OUT = 0, 1, 2
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation navigation newsletter notice notices pagination pager popup promo promoted related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Parts of such words that mark as well; fewer, as a part may stand in the name of any section.
PART_MARKS = frozenset(
    "ad ads advert advertisement adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead nav navbar navigation "
    "newsletter pagination promo share sharing sidebar social sponsored subscribe topbar".split()
)
ARTICLE, MAIN, BODY = 2, 1, 0
WORD_MARK, PART_MARK = 1, 2
_PARTS = re.compile(r"[-_\s]+|(?<=[a-z0-9])(?=[A-Z])")
#: Opening one of these closes an open element of the others named, up to the container.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Inside a tag; a quotation mark that nothing closes is a character like any other.
_INSIDE = r"""(?:[^<>"'=]|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+"""
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|svg|iframe)\b{_INSIDE}>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>|<[!?/][^<>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _marked(attributes: str, region: int) -> int:
    """Whether a word of the class, or the id or role, marks boilerplate, or the first or last part of one does."""
    marks, parts = (MARKS - {"header"} if region == ARTICLE else MARKS), False  # an article's own header holds its title
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name not in ("class", "id", "role"):
            continue
        words = value.split() if name == "class" else [value.strip()]
        if any(w.lower() in marks for w in words):
            return WORD_MARK
        for w in words:
            ends = [x.lower() for x in _PARTS.split(w) if x]
            parts = parts or len(ends) > 1 and (ends[0] in PART_MARKS or ends[-1] in PART_MARKS)
    return PART_MARK if parts else 0


class Page:
    """pieces: (region, text) in page order, a blank between blocks; subtrees: (hash, first piece, end) of elements with text."""

    def __init__(self, source: str):
        self.spared: set[int] = set()  # elements that stay, by their number
        while True:
            self._read(source)
            sizes = Counter()
            for r, t in self.pieces:
                sizes[r] += len(t.strip())
            outside, kept = sizes[ARTICLE] + sizes[MAIN], sum(sizes.values())
            stay = {k for k, n in self.held.items() if n > outside}
            stay |= {k for k in self.forms if self.headed[k]}
            if not outside:
                stay |= {k for k in self.by_part if self.left[k] > 2 * kept}
            if not stay and not kept:
                stay = self.forms
            if stay <= self.spared:
                break
            self.spared |= stay
        self.region = ARTICLE if sizes[ARTICLE] and sizes[ARTICLE] >= sizes[MAIN] else MAIN if sizes[MAIN] else BODY

    def _read(self, source: str) -> None:
        self.pieces: list[tuple[int, str]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.stack: list[list] = []  # tag, region, left out, first piece, parts to hash, number if left out by itself
        self.forms: set[int] = set()
        self.by_part: set[int] = set()
        self.held, self.left, self.headed = Counter(), Counter(), Counter()  # of left out elements: text of articles, all text, whether an h1
        self.owners: list[int] = []  # the elements that are left out by themselves, from the outermost
        self.articles = 0  # open articles and mains within them
        self.open_tags: Counter = Counter()
        self.opened = at = 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if tag := m[3]:
                self._close(tag.lower()) if m[2] else self._open(tag.lower(), m[4])
        if at < len(source):
            self._text(source[at:])
        while self.stack:
            self._pop()

    def _text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top[2]:
            if top[2] == UNLESS_HOLDING and (n := len(raw.strip())):
                for k in self.owners:
                    self.left[k] += n
                    self.held[k] += n if self.articles else 0
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((top[1] if top else BODY, text))
        if top:
            top[4].append(" ".join(text.split()))

    def _break(self) -> None:
        if self.pieces and self.pieces[-1][1] != " ":
            self.pieces.append((self.stack[-1][1] if self.stack else BODY, " "))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self._break()
            return
        if tag not in INLINE:
            self._close("p")
            if tag in CLOSES and any(self.open_tags[t] for t in CLOSES[tag][0]):
                these, within = CLOSES[tag]
                for f in reversed(self.stack):
                    if f[0] in within:
                        break
                    if f[0] in these:
                        self._close(f[0])
                        break
            self._break()
        region, dropped = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (BODY, KEPT)
        own, self.opened = None, self.opened + 1
        if dropped == UNLESS_HOLDING and tag == "h1":
            for k in self.forms.intersection(self.owners):
                self.headed[k] = 1
        if dropped == KEPT:
            if tag == "article":
                region = ARTICLE
            elif tag == "main":
                region = max(region, MAIN)
        if tag in DROPPED:
            dropped = LEFT_OUT
        elif dropped != LEFT_OUT and self.opened not in self.spared:
            form = tag in FORMS
            mark = _marked(attributes, region) if attributes and tag not in UNMARKED else 0
            if form or mark or (tag == "header" and region == BODY):
                dropped, own = UNLESS_HOLDING, self.opened
                self.owners.append(own)
                if form:
                    self.forms.add(own)
                elif mark == PART_MARK:
                    self.by_part.add(own)
        if dropped == UNLESS_HOLDING and tag in ("article", "main"):
            self.articles += 1
        self.stack.append([tag, region, dropped, len(self.pieces), [], own])
        self.open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return

    def _pop(self) -> None:
        tag, region, dropped, first, parts, own = self.stack.pop()
        self.open_tags[tag] -= 1
        if own is not None:
            self.owners.pop()
        if dropped == UNLESS_HOLDING and tag in ("article", "main"):
            self.articles -= 1
        if not dropped and parts:
            own = xxhash.xxh64_intdigest(tag + "\x00" + "\x00".join(parts)) - (1 << 63)
            if tag not in WHOLE and tag not in INLINE:
                self.subtrees.append((own, first, len(self.pieces)))
            if self.stack:
                self.stack[-1][4].append(f"{own:x}")
        if tag not in INLINE:
            self._break()

    def text(self, templates: frozenset = frozenset()) -> str:
        change = [0] * (len(self.pieces) + 1)
        for own, a, b in self.subtrees:
            if own in templates:
                change[a] += 1
                change[b] -= 1
        kept = (t if r >= self.region and not cut else " " for (r, t), cut in zip(self.pieces, accumulate(change)))
        return " ".join("".join(kept).split())

    def hashes(self) -> set[int]:
        """The subtrees of the main region."""
        before = [0, *accumulate(r >= self.region for r, _ in self.pieces)]
        return {own for own, a, b in self.subtrees if before[b] > before[a]}


def count_templates(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> host and its templates."""

    def run(batches):
        for batch in batches:
            hosts, texts, regions, hashes = [], [], [], []
            for host, source in zip(common.column(batch, "host").to_pylist(), common.texts(common.column(batch, "html"))):
                page = Page(source)
                hosts.append(host)
                texts.append(xxhash.xxh64_intdigest(page.text()) - (1 << 63))
                regions.append(page.region != BODY)
                hashes.append(list(page.hashes()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(regions, pa.bool_()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "main", "inside", "hashes"])

    read = common.stored(pages.select("host", "html").mapInArrow(run, "host string, main long, inside boolean, hashes array<bigint>").dropDuplicates(["host", "main"]), "page-subtrees")
    sizes = read.groupBy("host").agg(F.count("*").alias("texts"))
    counted = read.select("host", "inside", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"), F.bool_or("inside").alias("inside")).where(F.col("n") >= MIN_TEXTS)
    share = F.when(F.col("inside"), SHARE_INSIDE).otherwise(SHARE_OUTSIDE)
    return counted.join(sizes, "host").where(F.col("n") >= share * F.col("texts")).groupBy("host").agg(F.collect_set("hash").alias("templates"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = split_url(common.clean_columns(pages, page_id=id_col, url=url_col, html=html_col)).drop("path")
    kind = pages.schema["page_id"].dataType.simpleString()
    templates = common.stored(count_templates(pages), "templates")
    small = None
    if (templates.agg(F.sum(F.size("templates"))).first()[0] or 0) <= BROADCAST_TEMPLATES:
        small = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["templates"]) for r in templates.collect()})
        pages = pages.withColumn("templates", F.lit(None).cast("array<bigint>"))
    else:
        pages = pages.join(templates, "host", "left")

    def run(batches):
        none = frozenset()
        for batch in batches:
            found = []
            own = common.column(batch, "templates")
            for k, (host, source) in enumerate(zip(common.column(batch, "host").to_pylist(), common.texts(common.column(batch, "html")))):
                found.append(Page(source).text(small.value.get(host, none) if small else frozenset(own[k].as_py() or ())))
            yield pa.RecordBatch.from_arrays([common.column(batch, "page_id"), common.column(batch, "url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "host", "html", "templates").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(common.read(spark, sf_dir, "pages"))
