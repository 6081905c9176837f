"""Ingest: items to entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import sanitize_items
from millrace.functions.text import identity_hash, normalize_url, text
from millrace.functions.times import published_or_fetched
from millrace.sources.personal import enrich_new

from .dedup import LAYERS, dedup_first_wins, entry_keys, reject_known
from .tables import with_ids, written


class Ingested(NamedTuple):
    """entries: new rows; rejected: the order columns and reason; summary: one row."""

    entries: DataFrame
    rejected: DataFrame
    summary: DataFrame


def with_keys(items: DataFrame) -> DataFrame:
    """Items with null strings as '', normalised url and content_hash."""
    strings = {c: text(c) for c in ("guid", "title", "author", "summary", "content", "content_type")}
    return items.withColumns(strings).withColumns({"url": normalize_url("url"), "content_hash": identity_hash("title", "content")})


def item_to_entry(items: DataFrame, now: Column) -> DataFrame:
    """Rows of the entry table from items with keys and ids."""
    return items.select(
        "id", "source_id", "guid", "url", "content_hash", "title", "author", published_or_fetched("published_at", "fetched_at").alias("published_at"), "summary", "content", "content_type",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
        F.date_trunc("second", "fetched_at").alias("fetched_at"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("deleted"),
    )


def order_columns(items: DataFrame) -> list[str]:
    """What tells items apart and orders them: source, then the document as it was
    fetched (where items know it, by its digest where they know that, too), then the
    place in it."""
    known = [c for c in ("fetched_at", "doc_id", "digest") if c in items.columns] if "doc_id" in items.columns else []
    return ["source_id", *known, "pos"]


def ingest(
    items: DataFrame, entries: DataFrame, now, details: DataFrame | None = None, order_cols: list[str] | None = None, layers: tuple[str, ...] = LAYERS, failed: DataFrame | None = None,
    known: Callable[[DataFrame], DataFrame] | None = None, last_id: int | None = None,
) -> Ingested:
    """New entries of a batch: cleaned, keyed, without identity-less items, held
    against the store and against each other in order (see :func:`order_columns`),
    enriched, numbered in the order of acceptance.

    Order columns that two items share are an error, as neither would be first.
    ``failed`` (source_id, error) are documents that could not be read; they count as
    errors in the summary.  ``known`` may hold candidates against a store of keys (see
    :mod:`.known`) and ``last_id`` give the last number; then entries aren't read.  Only keys are joined; the texts are written once, with
    their keys, and join the accepted keys in the end.
    """
    order_cols = order_cols or order_columns(items)
    stamp = F.lit(now).cast("timestamp")
    keyed = written(with_keys(sanitize_items(items)), "keyed")
    keys = keyed.select(*order_cols, *(c for c in ("source_id", "guid", "url", "content_hash") if c not in order_cols))
    if not keys.groupBy(*order_cols).count().where("count > 1").isEmpty():
        raise ValueError(f"several items share their {', '.join(order_cols)}: give order_cols that tell items apart")
    nameless = (F.col("guid") == "") & (F.col("url") == "") & (F.col("content_hash") == "")
    named = keys.where(~nameless).withColumn("ord", F.struct(*order_cols))
    checked = written(known(named) if known else reject_known(named, entry_keys(entries, layers), layers), "checked")
    judged = written(dedup_first_wins(checked.where("reason IS NULL").drop("reason", "entry_id", "ord"), order_cols, layers), "judged")
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if last_id is None else last_id
    numbers = with_ids(judged.where("accepted").select(*order_cols), order_cols, last + 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in order_cols]
    accepted = keyed.alias("a").join(numbers.alias("b"), same).select("a.*", "b.id")
    if details is not None:
        accepted = enrich_new(accepted, details)
    new = written(item_to_entry(accepted, stamp), "new-entries")
    reasons = [keys.where(nameless).withColumn("reason", F.lit("no_identity")), checked.where("reason IS NOT NULL"), judged.where("NOT accepted")]
    rejected = reduce(DataFrame.unionByName, (r.select(*order_cols, "reason") for r in reasons))
    return Ingested(new, rejected, ingest_summary(new, rejected, failed))


def ingest_summary(new: DataFrame, rejected: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """sources, inserted, skipped, errors of a run, one row; the ids are in the
    new entries."""
    touched = new.select("source_id", F.lit(1).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    touched = touched.unionByName(rejected.select("source_id", F.lit(0).alias("i"), F.lit(1).alias("s"), F.lit(0).alias("e")))
    if failed is not None:
        touched = touched.unionByName(failed.select("source_id", F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    return touched.agg(
        F.countDistinct("source_id").alias("sources"), F.coalesce(F.sum("i"), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("skipped"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"),
    )
