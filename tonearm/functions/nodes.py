"""Choosing nodes of a page (columns text, raw and nodes of sources.markup) by expressions: a test is a function of a node."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

Test = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def el(*tags: str, cls: str | None = None, equal: dict | None = None, has: dict | None = None, starts: dict | None = None, present: str | None = None) -> Test:
    """Nodes of one of the tags (any element if none), with a class, and attributes that equal, contain or start with values."""

    def test(n: Column) -> Column:
        ok = n["tag"].isin(*tags) if tags else n["tag"] != "#text"
        if cls:
            named = attr(n, "class")  # few classes hold the word: only those are split
            ok &= F.contains(named, F.lit(cls)) & ((named == cls) | F.array_contains(F.split(named, r"\s+"), cls))
        for k, v in (equal or {}).items():
            ok &= attr(n, k) == v
        for k, v in (has or {}).items():
            ok &= F.contains(attr(n, k), F.lit(v))
        for k, v in (starts or {}).items():
            ok &= F.startswith(attr(n, k), F.lit(v))
        if present:
            ok &= attr(n, present).isNotNull()
        return F.coalesce(ok, F.lit(False))

    return test


def any_of(*tests: Test) -> Test:
    return lambda n: reduce(lambda a, b: a | b, (t(n) for t in tests))


def below(node: Column, n: Column) -> Column:
    return (n["pos"] > node["pos"]) & (n["pos"] <= node["last"])


class under:  # noqa: N801  used like the other tests
    """Nodes that pass inner and have an ancestor that passes outer."""

    def __init__(self, outer: Test, inner: Test):
        self.outers, self.inner = ([outer, *inner.outers], inner.inner) if isinstance(inner, under) else ([outer], inner)

    def __call__(self, n: Column) -> Column:
        return self.among([F.filter("nodes", o) for o in self.outers], n)

    def among(self, outers: list[Column], n: Column) -> Column:
        return reduce(lambda ok, os: ok & F.exists(os, lambda x: below(x, n)), outers, self.inner(n))


def every(test: Test, within: Column | None = None, of: Column | str = "nodes") -> Column:
    """Nodes (or those of a list that are) in document order, inside a node if given (which is worked out once, as are the ancestors that a test asks for)."""
    held = [F.filter("nodes", o) for o in test.outers] if isinstance(test, under) else []
    held = F.struct(*([] if within is None else [within.alias("within")]), *(o.alias(f"outer{k}") for k, o in enumerate(held)))

    def chosen(h: Column) -> Column:
        def test_of(n: Column) -> Column:
            ok = test.among([h[f"outer{k}"] for k in range(len(test.outers))], n) if isinstance(test, under) else test(n)
            return ok if within is None else below(h["within"], n) & ok

        return F.filter(of, test_of)

    return let(held, chosen) if within is not None or isinstance(test, under) else F.filter(of, test)


def first(test: Test, within: Column | None = None, of: Column | str = "nodes") -> Column:
    return F.get(every(test, within, of), F.lit(0))


def ancestor(node: Column, *tags: str) -> Column:
    """The nearest of the tags that the node is in."""
    return let(node, lambda x: F.try_element_at(F.filter("nodes", lambda n: n["tag"].isin(*tags) & below(n, x)), F.lit(-1)))


def content(node: Column) -> Column:
    """All text of the node, each piece stripped."""
    return let(node, lambda n: F.substring(F.col("text"), n["begin"] + 1, n["end"] - n["begin"]))


def raw_content(node: Column) -> Column:
    return let(node, lambda n: F.substring(F.col("raw"), n["raw_begin"] + 1, n["raw_end"] - n["raw_begin"]))
