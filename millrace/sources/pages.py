"""List pages that have landed in a table."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sliced import sliced_udf

_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset({"script", "style"})
#: Elements that end an open one of the same kind.
_CLOSES = {
    "li": {"li"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "a": {"a"},
}
_STOPS = frozenset({"ul", "ol", "table", "div", "dl", "select", "td", "section", "nav", "body"})


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None") -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Element | str] = []

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def descendants(self):
        for p in self.parts:
            if isinstance(p, Element):
                yield p
                yield from p.descendants()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = self.at
        while node.parent is not None and node.tag not in _STOPS | {tag} | _CLOSES.get(tag, set()):
            node = node.parent
        if node.tag in _CLOSES.get(tag, ()):
            self.at = node.parent
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.parts.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _tree(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_NAME = r"[A-Za-z_][\w-]*"
_SIMPLE = re.compile(rf"\*|({_NAME})|\.({_NAME})|#({_NAME})|\[\s*({_NAME})\s*(?:([~^$*|]?=)\s*(\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]")


def parse_selector(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Groups of (combinator, tests); tags, classes, ids, attributes, descendants
    and children.  ValueError for anything else."""
    groups = []
    for group in re.split(r",(?![^\[]*\])", selector):
        steps, rest, combinator = [], group.strip(), " "
        if not rest:
            raise ValueError(f"invalid selector {selector!r}")
        while rest:
            tests = []
            while found := _SIMPLE.match(rest):
                if found[1] and tests:
                    raise ValueError(f"invalid selector {selector!r}")
                tests.append(found.groups())
                rest = rest[found.end() :]
            if not tests:
                raise ValueError(f"invalid selector {selector!r}")
            steps.append((combinator, tests))
            found = re.match(r"\s*>\s*|\s+", rest)
            if found:
                combinator, rest = found[0].strip() or " ", rest[found.end() :]
                if not rest:
                    raise ValueError(f"invalid selector {selector!r}")
            elif rest:
                raise ValueError(f"invalid selector {selector!r}")
        groups.append(steps)
    return groups


def _passes(e: Element, tests: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, value in tests:
        if tag and e.tag != tag.lower() or cls and cls not in e.attrs.get("class", "").split() or ident and e.attrs.get("id") != ident:
            return False
        if attr:
            own = e.attrs.get(attr.lower())
            want = (value or "").strip("\"'")
            if own is None:
                return False
            ok = {
                None: True, "=": own == want, "~=": want in own.split(), "^=": bool(want) and own.startswith(want),
                "$=": bool(want) and own.endswith(want), "*=": bool(want) and want in own, "|=": own == want or own.startswith(want + "-"),
            }[op]
            if not ok:
                return False
    return True


def _matches(e: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
    combinator, tests = steps[-1]
    if not _passes(e, tests):
        return False
    if len(steps) == 1:
        return True
    up = e.parent
    while up is not None and up.parent is not None:
        if _matches(up, steps[:-1]):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False


def list_links(html: str | None, selector: str, base: str | None) -> list[dict]:
    """url and title of the links that a selector finds, in document order."""
    groups, out = parse_selector(selector), []
    for e in _tree(html or "").descendants():
        if not any(_matches(e, g) for g in groups):
            continue
        anchor = e if e.tag == "a" else next((d for d in e.descendants() if d.tag == "a"), None)
        href = (anchor.attrs.get("href") or "").strip() if anchor else ""
        if not href or href.startswith("#"):
            continue
        try:
            url = urljoin(base or "", href)
            fine = urlsplit(url).scheme in ("http", "https")
        except ValueError:
            continue
        if fine:
            out.append({"url": url, "title": " ".join(anchor.text().split())})
    return out


def page_title(html: str | None) -> str:
    return next((e.text().strip() for e in _tree(html or "").descendants() if e.tag == "title"), "")


def parse_page_list(raw_docs: DataFrame, selector: str) -> DataFrame:
    """Items (with doc_id) of list pages; ValueError at once for a bad selector."""
    parse_selector(selector)

    links = sliced_udf(lambda body, base: list_links(body, selector, base), T.ArrayType(_LINK))
    return _as_items(raw_docs.select("source_id", "doc_id", "fetched_at", F.posexplode(links("body", "base_url")).alias("pos", "i")))


def _as_items(each: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return each.select(
        "source_id", "doc_id", *keep, "pos", F.col("i.url").alias("guid"), "i.url", "i.title", F.lit("").alias("author"), F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(True).alias("inferred_time"), F.lit("").alias("summary"), F.lit("").alias("content"), F.lit("text/html").alias("content_type"),
        F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("extra"), "fetched_at",
    )


_titles = sliced_udf(page_title, T.StringType())


def page_titles(raw_docs: DataFrame) -> DataFrame:
    """source_id, doc_id, title of list pages."""
    return raw_docs.select("source_id", "doc_id", _titles("body").alias("title"))


def _links_of(body: str | None, base: str | None, config: str | None) -> dict:
    """error and links of a page by the selector of its source's config."""
    try:
        selector = json.loads(config or "{}").get("selector") or ""
        return {"error": "", "links": list_links(body, selector, base)}
    except (ValueError, AttributeError) as e:
        return {"error": f"webpage: {e}", "links": []}


_read_links = sliced_udf(_links_of, T.StructType([T.StructField("error", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]))


def before_cursor(links: Column, cursor: Column) -> Column:
    """What of an array of links stands before the url in a cursor ({"newest_url":
    ...}); all if it isn't there."""
    stop = F.array_position(F.transform(links, lambda x: x["url"]), F.get_json_object(cursor, "$.newest_url"))
    return F.when(F.coalesce(stop, F.lit(0)) > 0, F.slice(links, F.lit(1), (stop - 1).cast("int"))).otherwise(links)


def read_pages(docs: DataFrame) -> DataFrame:
    """docs (with ``config``: selector, and ``cursor``) and error, links: those before
    the cursor, cut inside the document before anything is exploded."""
    each = docs.select("*", F.explode(F.array(_read_links("body", "base_url", "config"))).alias("_read"))
    return each.withColumns({"error": F.col("_read.error"), "links": before_cursor(F.col("_read.links"), F.col("cursor"))}).drop("_read")


def items_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items, with doc_id and the columns ``keep``, of pages that were read."""
    each = docs.select("source_id", "doc_id", *keep, "fetched_at", F.posexplode("links").alias("pos", "i"))
    return _as_items(each, keep)


def next_cursor() -> Column:
    """The first link that was kept, or null where there is none."""
    return F.when(F.size("links") > 0, F.to_json(F.struct(F.col("links")[0]["url"].alias("newest_url"))))


def cut_at_cursor(items: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, cursors): of each source what stands before the url in its cursor
    ({"newest_url": ...}), all if it isn't there; and the new cursors, the first
    url kept or the old one."""
    newest = cursors.select("source_id", F.get_json_object("cursor", "$.newest_url").alias("newest"), "cursor")
    stop = items.join(newest, "source_id").where("url = newest").groupBy("source_id").agg(F.min("pos").alias("stop"))
    kept = items.join(stop, "source_id", "left").where("stop IS NULL OR pos < stop").drop("stop")
    first = kept.groupBy("source_id").agg(F.min_by("url", "pos").alias("first"))
    moved = first.join(newest.select("source_id", "cursor"), "source_id", "full").select(
        "source_id", F.when(F.col("first").isNotNull(), F.to_json(F.struct(F.col("first").alias("newest_url")))).otherwise(F.col("cursor")).alias("cursor")
    )
    return kept, moved
