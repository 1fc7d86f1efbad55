"""Web pages as rows: a tolerant reader turns markup into a list of nodes, and leaves all choosing to expressions.

A node's stripped text is a piece of the page's stripped texts joined, and its raw text a piece of the raw ones, so
each node carries four offsets instead of its text. Nodes stand in document order; a node's descendants are those
from pos + 1 to last. Text nodes have the tag #text; scripts and styles have no text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

NODES = "array<struct<pos:int,last:int,tag:string,attrs:map<string,string>,begin:int,end:int,raw_begin:int,raw_end:int>>"
_NODE = pa.struct([("pos", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("end", pa.int32()), ("raw_begin", pa.int32()), ("raw_end", pa.int32())])
_FIELDS = [f.name for f in _NODE]
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PIECE = 1 << 20
_NONE = ((), ())
SILENT = frozenset(["script", "style", "template"])
#: Elements that a new one ends, and those that keep it inside.
ENDS = {
    "li": (("li",), ("ul", "ol")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "p": (("p",), ("div", "td", "li", "article", "section")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}


#: A tag with its attributes; a quotation mark that nothing closes is a character like any other, and a tag that nothing closes reaches to the end.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)(>?)""")
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}


@lru_cache(1 << 14)
def _short_attributes(said: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names and values; of equal names the first stays."""
    attrs: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(said):
        attrs.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return tuple(attrs), tuple(attrs.values())


def _attributes(said: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return _short_attributes(said) if len(said) <= 64 else _short_attributes.__wrapped__(said)


#: A tag that ends with its first >, whatever follows it: quotation marks in it only enclose values.
_CLOSED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
SHORT = 96


@lru_cache(1 << 14)
def _closed_tag(markup: str) -> tuple[bool, str, tuple, bool] | None:
    """(closing, name, attributes, empty) of such a tag, as pages repeat them; None for other markup."""
    if not (tag := _CLOSED.fullmatch(markup)):
        return None
    closing, name, said = tag.groups()
    name = name.lower()
    return bool(closing), name, _attributes(said) if said else _NONE, said.endswith("/") and name not in VOID


class _Reader:
    """Pages one after the other into columns of nodes. Open elements are kept by tag too, so that no tag looks through all of them.

    With tags, only nodes of these are put down, under the places that they have among all.
    """

    def __init__(self, tags: frozenset[str] | None = None):
        self.tags = tags
        self.tag: list[str] = []
        self.attrs: list[tuple] = []
        self.ints: list[int] = []  # six for each node: pos, last, begin, end, raw_begin, raw_end
        self.sizes: list[int] = []

    def page(self, source: str) -> tuple[str, str]:
        """Puts down a page's nodes; its text and its raw text."""
        self.open: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.raw: list[str] = []
        self.count = self.n = self.raw_n = self.silent = 0
        before = len(self.tag)
        self.feed(source)
        self.sizes.append(len(self.tag) - before)
        return "".join(self.text), "".join(self.raw)

    def _add(self, tag: str, attrs: tuple) -> int:
        """The node's row, or -1."""
        pos = self.count
        self.count += 1
        if self.tags is not None and tag not in self.tags:
            return -1
        self.tag.append(tag)
        self.attrs.append(attrs)
        n, raw_n = self.n, self.raw_n
        self.ints += (pos, pos, n, n, raw_n, raw_n)
        return len(self.tag) - 1

    def end_from(self, k: int) -> None:
        for tag, row in self.open[:k - 1 if k else None:-1]:
            if row >= 0:
                row *= 6
                self.ints[row + 1], self.ints[row + 3], self.ints[row + 5] = self.count - 1, self.n, self.raw_n
            self.places[tag].pop()
            if tag in SILENT:
                self.silent -= 1
        del self.open[k:]

    def start(self, tag: str, attrs: tuple) -> None:
        if tag in ENDS:
            these, within = ENDS[tag]
            if any(map(self.places.get, these)):
                inside = max((self.places[t][-1] for t in within if self.places.get(t)), default=-1)
                ended = [p[k] for t in these if (p := self.places.get(t)) and (k := bisect_right(p, inside)) < len(p)]
                if ended:
                    self.end_from(min(ended))
        row = self._add(tag, attrs)
        if tag not in VOID:
            if (places := self.places.get(tag)) is None:
                places = self.places[tag] = []
            places.append(len(self.open))
            self.open.append((tag, row))
            if tag in SILENT:
                self.silent += 1

    def end(self, tag: str) -> None:
        if places := self.places.get(tag):
            self.end_from(places[-1])

    def data(self, data: str) -> None:
        if self.silent or not data:
            return
        if "&" in data:
            data = unescape(data)
        row, stripped = self._add("#text", _NONE), data.strip()
        self.text.append(stripped)
        self.raw.append(data)
        self.n += len(stripped)
        self.raw_n += len(data)
        if row >= 0:
            self.ints[6 * row + 3], self.ints[6 * row + 5] = self.n, self.raw_n

    def arrow(self) -> pa.ListArray:
        ints = [pa.array(np.ascontiguousarray(c)) for c in np.array(self.ints, np.int32).reshape(-1, 6).T]
        offsets = lambda sizes: pa.array(accumulate(sizes, initial=0), pa.int32())
        names, values = (pa.array([x for a in self.attrs for x in a[k]], pa.string()) for k in (0, 1))
        attrs = pa.MapArray.from_arrays(offsets(len(a[0]) for a in self.attrs), names, values)
        fields = [ints[0], ints[1], pa.array(self.tag, pa.string()), attrs, *ints[2:]]
        return pa.ListArray.from_arrays(offsets(self.sizes), pa.StructArray.from_arrays(fields, fields=list(_NODE)))

    def feed(self, source: str) -> None:
        at = begin = 0
        while (at := source.find("<", at)) >= 0:
            end = source.find(">", at, at + SHORT)
            known = _closed_tag(source[at : end + 1]) if end >= 0 else None
            tag = None if known else _TAG.match(source, at)
            if not known and not tag:
                after = source[at + 1 : at + 3]
                if not (after[:1] in ("!", "?") or (after[:1] == "/" and len(after) == 2)):
                    at += 1  # no markup
                    continue
            if begin < at:
                self.data(source[begin:at])
            if known:
                closing, name, attrs, empty = known
                begin = at = end + 1
            elif tag:
                begin = at = tag.end()
                closing, name, said, whole = tag.groups()
                if not whole:
                    begin = len(source)
                    break
                name = name.lower()
                attrs = _NONE if closing or not said else _attributes(said)
                empty = said.endswith("/") and name not in VOID
            else:
                comment = source.startswith("<!--", at)
                end = source.find("-->", at + 4) if comment and not source.startswith(("<!-->", "<!--->"), at) else source.find(">", at)
                begin = at = len(source) if end < 0 else end + (3 if source.startswith("-->", end) else 1)
                continue
            if closing:
                self.end(name)
                continue
            self.start(name, attrs)
            if empty:
                self.end(name)
            if name in _RAW_END and self.open and self.open[-1][0] == name:
                found = _RAW_END[name].search(source, at)
                begin = at = found.start() if found else len(source)
        self.data(source[begin:])
        self.end_from(0)


def _read(source: str | None) -> tuple[str, str, list[dict]]:
    r = _Reader()
    text, raw = r.page(source or "")
    pos, last, *offsets = (r.ints[k::6] for k in range(6))
    rows = zip(pos, last, r.tag, (list(zip(*a)) for a in r.attrs), *offsets)
    return text, raw, [dict(zip(_FIELDS, row)) for row in rows]


def _pieces(html: pa.Array):
    """(first row, number of rows) of pieces of PIECE bytes or little more, so that what a task holds doesn't grow with its pages."""
    begin = held = 0
    for k, size in enumerate(pc.binary_length(html).to_pylist()):
        held += size or 0
        if held >= PIECE:
            yield begin, k + 1 - begin
            begin, held = k + 1, 0
    if begin < len(html):
        yield begin, len(html) - begin


def read_nodes(pages: DataFrame, html_col: str = "html", tags: Iterable[str] | None = None) -> DataFrame:
    """The pages without their markup, with text, raw and nodes, of the given tags alone if any; null markup has no nodes. Other columns named so are replaced."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "raw", "nodes")]
    pages = pages.select(*(f"`{c}`" for c in keep), f"`{html_col}`")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1]), "text string", "raw string", f"nodes {NODES}"])
    wanted = None if tags is None else frozenset(tags)

    def run(batches):
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for begin, n in _pieces(html):
                r = _Reader(wanted)
                read = [r.page(h or "") for h in html.slice(begin, n).to_pylist()]
                text, raw = (pa.array([t[k] for t in read], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, n) for c in batch.columns[:-1]), text, raw, r.arrow()], names=[*keep, "text", "raw", "nodes"])

    return pages.mapInArrow(run, schema)
