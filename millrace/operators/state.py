"""Flags of entries: events, joins, the read-later list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.schemas import FLAGS

from .listing import page_of


def with_state(entries: DataFrame, state: DataFrame) -> DataFrame:
    """entries with their flags, all false where there is no row."""
    flags = state.select(F.col("entry_id").alias("id"), *(F.col(f).alias(f"_{f}") for f in FLAGS))
    joined = entries.join(flags, "id", "left")
    return joined.select(*entries.columns, *(F.coalesce(f"_{f}", F.lit(False)).alias(f) for f in FLAGS))


def read_later(entries: DataFrame, state: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of the entries to be read later, last marked first."""
    marked = state.where("read_later").select(F.col("entry_id").alias("id"), F.col("updated_at").alias("marked_at"))
    found = entries.where(~F.col("deleted")).join(marked, "id")
    return page_of(found.orderBy(F.col("marked_at").desc(), F.col("id").desc()), page, page_size)


def valid_events(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Events on undeleted entries with a known flag."""
    known = entries.where(~F.col("deleted")).select(F.col("id").alias("entry_id")).distinct()
    return events.where(F.col("flag").isin(*FLAGS) & F.col("value").isNotNull()).join(known, "entry_id", "left_semi")


def apply_state_events(state: DataFrame, events: DataFrame, entries: DataFrame) -> DataFrame:
    """State after events (seq, ts, entry_id, flag, value) in the order (ts, seq).

    An event that sets what is set changes nothing; one that does change something
    makes the row if it is missing and gives it its time.  Events on unknown or
    deleted entries are left out.
    """
    valid = valid_events(events, entries)
    before = state.select("entry_id", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("old")) for f in FLAGS))).alias("x")).select("entry_id", "x.flag", "x.old")
    order = W.partitionBy("entry_id", "flag").orderBy("ts", "seq")
    joined = valid.join(before, ["entry_id", "flag"], "left")
    previous = F.coalesce(F.lag("value").over(order), F.col("old"), F.lit(False))
    changes = joined.withColumn("previous", previous).where("value <> previous")
    last = changes.groupBy("entry_id").agg(
        F.max("ts").alias("_ts"), *(F.max_by(F.when(F.col("flag") == f, F.col("value")), F.when(F.col("flag") == f, F.struct("ts", "seq"))).alias(f"_{f}") for f in FLAGS)
    )
    both = state.join(last, "entry_id", "full")
    flags = [F.coalesce(f"_{f}", f, F.lit(False)).alias(f) for f in FLAGS]
    return both.select("entry_id", *flags, F.coalesce("_ts", "updated_at").alias("updated_at"))


def migrate_read_later(old: DataFrame, state: DataFrame) -> DataFrame:
    """state and rows for the old entries (id, read_later, updated_at) that were to
    be read later and have none."""
    new = old.where("read_later = 1").select(
        F.col("id").alias("entry_id"), F.lit(False).alias("read"), F.lit(False).alias("favorite"), F.lit(False).alias("archive"), F.lit(True).alias("read_later"), "updated_at"
    )
    return state.unionByName(new.join(state.select("entry_id"), "entry_id", "left_anti").select(state.columns))
