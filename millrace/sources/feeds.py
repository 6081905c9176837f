"""Feed documents that have landed in a table: RSS 2.0, Atom and JSON Feed."""

from __future__ import annotations

import json
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sliced import sliced_udf
from millrace.functions.text import trim_white
from millrace.functions.times import parse_feed_time

_STRINGS = ("guid", "url", "title", "author", "published", "updated", "summary", "content", "content_type")
_ITEM = T.StructType([*(T.StructField(n, T.StringType()) for n in _STRINGS), T.StructField("tags", T.ArrayType(T.StringType()))])
_DOC = T.StructType([*(T.StructField(n, T.StringType()) for n in ("error", "format", "title")), T.StructField("items", T.ArrayType(_ITEM))])

#: Fixed value: items kept of a feed document in one round.
ITEM_LIMIT = 200


#: Fixed value: what a document without any content says.
EMPTY = "empty response body"


class FeedError(ValueError):
    """A document that is no feed; it fails as a whole."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _own(node: ElementTree.Element) -> str:
    """Direct character data, without that of children."""
    return (node.text or "") + "".join(child.tail or "" for child in node)


def _last(node: ElementTree.Element, name: str) -> str:
    """Trimmed text of the last child of that local name."""
    found = [c for c in node if _local(c.tag) == name]
    return _own(found[-1]).strip() if found else ""


def _rss(root: ElementTree.Element) -> tuple[str, list[dict]]:
    channels = [c for c in root if _local(c.tag) == "channel"]
    items = []
    for node in (n for c in channels for n in c if _local(n.tag) == "item"):
        get = {name: _last(node, name) for name in ("guid", "link", "author", "creator", "encoded", "description", "category", "title", "pubDate")}
        items.append(
            {
                "guid": get["guid"] or get["link"], "url": get["link"] or get["guid"], "title": get["title"], "author": get["author"] or get["creator"],
                "published": get["pubDate"], "updated": "", "summary": get["description"], "content": get["encoded"] or get["description"],
                "content_type": "text/html", "tags": [get["category"]] if get["category"] else [],
            }
        )
    titles = [t for t in (_last(c, "title") for c in channels) if t]
    return titles[-1] if titles else "", items


def _atom(root: ElementTree.Element) -> tuple[str, list[dict]]:
    items = []
    for node in (n for n in root if _local(n.tag) == "entry"):
        links = [c for c in node if _local(c.tag) == "link"]
        link = next((x for x in links if x.get("rel", "") in ("", "alternate")), links[0] if links else None)
        people = [c for c in node if _local(c.tag) == "author"]
        terms = [(c.get("term") or "").strip() for c in node if _local(c.tag) == "category"]
        items.append(
            {
                "guid": _last(node, "id"), "url": "" if link is None else (link.get("href") or "").strip(), "title": _last(node, "title"),
                "author": _last(people[-1], "name") if people else "", "published": _last(node, "published"), "updated": _last(node, "updated"),
                "summary": _last(node, "summary"), "content": _last(node, "content"), "content_type": "text/html", "tags": [t for t in terms if t],
            }
        )
    return _last(root, "title"), items


def _typed(doc: dict, name: str, kind: type):
    value = doc.get(name)
    if value is None:
        return kind()
    if not isinstance(value, kind):
        raise FeedError(f"broken JSON, {name} is no {kind.__name__}")
    return value


def _json_feed(text: str) -> tuple[str, list[dict]]:
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise FeedError(f"broken JSON, {e}") from e
    if not isinstance(doc, dict):
        raise FeedError("broken JSON, the document is no object")
    items = []
    for item in _typed(doc, "items", list):
        if not isinstance(item, dict):
            raise FeedError("broken JSON, an item is no object")
        get = lambda name, item=item: _typed(item, name, str).strip()
        tags = _typed(item, "tags", list)
        if not all(isinstance(t, str) for t in tags):
            raise FeedError("broken JSON, a tag is no string")
        link = get("url") or get("external_url")
        html = get("content_html")
        items.append(
            {
                "guid": get("id") or link, "url": link, "title": get("title"), "author": _typed(_typed(item, "author", dict), "name", str).strip(),
                "published": get("date_published"), "updated": "", "summary": get("summary"), "content": html or get("content_text"),
                "content_type": "text/html" if html else "text/plain", "tags": tags,
            }
        )
    return _typed(doc, "title", str).strip(), items


def read_feed(body: str | None) -> dict:
    """error, format, title and items of one document; an error leaves no items."""
    text = (body or "").strip()
    try:
        if not text:
            raise FeedError(EMPTY)
        if text[0] in "{[":
            title, items = _json_feed(text)
            kind = "json"
        elif text[0] == "<":
            try:
                root = ElementTree.fromstring(text.encode() if text.startswith("<?xml") and "encoding" not in text[:100] else text)
            except (ElementTree.ParseError, ValueError) as e:
                raise FeedError(f"broken XML, {e}") from e
            kind = {"rss": "rss", "feed": "atom"}.get(_local(root.tag))
            if kind is None:
                raise FeedError(f"{_local(root.tag)!r} is the root of no known feed format")
            title, items = _rss(root) if kind == "rss" else _atom(root)
        else:
            raise FeedError("starts like neither XML nor JSON")
    except FeedError as e:
        return {"error": f"feed: {e}", "format": "", "title": "", "items": []}
    return {"error": "", "format": kind, "title": title, "items": items}


_read_feeds = sliced_udf(read_feed, _DOC)


def read_feeds(raw_docs: DataFrame) -> DataFrame:
    """raw_docs with ``feed``: error ('' if fine), format, title, items.

    The explode of one element keeps later filters and projections from reading the
    documents again for each of their columns."""
    return raw_docs.select("*", F.explode(F.array(_read_feeds("body"))).alias("feed"))


def limit_items(items: Column, limit: int = ITEM_LIMIT) -> Column:
    """The first ``limit`` of an array of items; all if limit is 0 or less."""
    return F.slice(items, F.lit(1), F.lit(limit)) if limit > 0 else items


def items_of(docs: DataFrame, keep: tuple[str, ...] = (), limit: int = ITEM_LIMIT) -> DataFrame:
    """Items (see schemas.ITEM), doc_id and the columns ``keep`` from the result of
    :func:`read_feeds`."""
    each = docs.where("feed.error = ''").select("source_id", "doc_id", *keep, "fetched_at", F.posexplode(limit_items(F.col("feed.items"), limit)).alias("pos", "i"))
    published, updated = parse_feed_time("i.published"), parse_feed_time("i.updated")
    return each.select(
        "source_id", "doc_id", *keep, "pos", "i.guid", "i.url", "i.title", "i.author", F.coalesce(published, updated).alias("published_at"),
        F.coalesce(published, updated).isNull().alias("inferred_time"), "i.summary", "i.content", "i.content_type", "i.tags",
        F.create_map().cast("map<string,string>").alias("extra"), "fetched_at",
    )


def parse_feed(raw_docs: DataFrame, limit: int = ITEM_LIMIT) -> DataFrame:
    """Items of all well-formed feed documents, with doc_id."""
    return items_of(read_feeds(raw_docs), limit=limit)


def feed_errors(raw_docs: DataFrame) -> DataFrame:
    """source_id, doc_id, error of the documents that fail."""
    return read_feeds(raw_docs).where("feed.error <> ''").select("source_id", "doc_id", "feed.error")


def feed_titles(raw_docs: DataFrame) -> DataFrame:
    """source_id, doc_id, title, error of every document."""
    return read_feeds(raw_docs).select("source_id", "doc_id", trim_white("feed.title").alias("title"), "feed.error")
