"""Kinds of sources: how their documents are read and what items they hold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feeds, pages, personal

ReadDocs = Callable[[DataFrame], DataFrame]


class Kind(NamedTuple):
    """``read`` adds ``error`` ('' if fine) to documents (with ``config`` and
    ``cursor`` of their source) and whatever ``items`` needs; ``items`` gives the
    items of documents read, with doc_id; ``cursor`` a source's next cursor after a
    document that was read (null: as it was, '': none)."""

    read: ReadDocs
    items: ReadDocs
    cursor: Callable[[], object]


def _feed_cursor():
    none = (F.coalesce("etag", F.lit("")) == "") & (F.coalesce("last_modified", F.lit("")) == "")
    held = F.struct(F.nullif("etag", F.lit("")).alias("etag"), F.nullif("last_modified", F.lit("")).alias("last_modified"))
    return F.when(none, F.lit("")).otherwise(F.to_json(held))


def _read_feeds(docs: DataFrame) -> DataFrame:
    return feeds.read_feeds(docs).withColumn("error", F.col("feed.error"))


_kinds: dict[str, Kind] = {
    "feed": Kind(_read_feeds, feeds.items_of, _feed_cursor),
    "webpage": Kind(pages.read_pages, pages.items_of, pages.next_cursor),
    "bilibili": Kind(personal.unpack_envelope, personal.items_of, lambda: F.lit(None).cast("string")),
}


def register_kind(name: str, kind: Kind) -> None:
    """Makes documents of sources of this type readable."""
    _kinds[name] = kind


def registered() -> dict[str, Kind]:
    return dict(sorted(_kinds.items()))


def with_sources(raw_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of undeleted, enabled sources of a registered type, with ``type``
    and ``config``."""
    active = sources.where("enabled AND NOT deleted").where(F.col("type").isin(*_kinds)).select(F.col("id").alias("source_id"), "type", "config")
    return raw_docs.join(active, "source_id")


def parse_all(raw_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of all documents of active sources, without cursors."""
    typed = with_sources(raw_docs, sources).withColumn("cursor", F.lit(None).cast("string"))
    parts = [kind.items(kind.read(typed.where(F.col("type") == name)).where("error = ''")) for name, kind in registered().items()]
    return reduce(DataFrame.unionByName, parts)
