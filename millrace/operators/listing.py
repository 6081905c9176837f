"""Filtered, sorted, paged lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Page size if none or a wrong one is given, and the largest.
PAGE_SIZE, MOST = 50, 200


def page_size_of(size: int | None) -> int:
    return size if size and 1 <= size <= MOST else PAGE_SIZE


def page_of(ordered: DataFrame, page: int, page_size: int | None) -> DataFrame:
    size = page_size_of(page_size)
    return ordered.offset((max(page, 1) - 1) * size).limit(size)


def filter_entries(
    entries: DataFrame, state: DataFrame | None = None, source_id: int | None = None, read: bool | None = None, favorite: bool | None = None, archive: bool | None = None
) -> DataFrame:
    """Undeleted entries of a source (all for 0 or None) with the flags given; a
    missing state row has no flag."""
    found = entries.where(~F.col("deleted"))
    if source_id:
        found = found.where(F.col("source_id") == source_id)
    asked = {f: v for f, v in (("read", read), ("favorite", favorite), ("archive", archive)) if v is not None}
    if asked:
        flags = state.select(F.col("entry_id").alias("id"), *(F.col(f).alias(f"_{f}") for f in asked))
        found = found.join(flags, "id", "left")
        for f, v in asked.items():
            found = found.where(F.coalesce(f"_{f}", F.lit(False)) == v)
        found = found.select(entries.columns)
    return found


def newest_first() -> list[Column]:
    return [F.col("published_at").desc(), F.col("id").desc()]


def list_entries(entries: DataFrame, state: DataFrame | None = None, page: int = 1, page_size: int | None = None, after: tuple | None = None, **filters) -> DataFrame:
    """A page of entries, newest first; ``after`` = (published_at, id) of the last
    row seen takes the next page by key instead of by number."""
    found = filter_entries(entries, state, **filters)
    if after:
        found = found.where(F.struct("published_at", "id") < F.struct(F.lit(after[0]).cast("timestamp"), F.lit(after[1]).cast("long")))
        page = 1
    return page_of(found.orderBy(*newest_first()), page, page_size)


def total_of(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def list_all_entries(entries: DataFrame, state: DataFrame | None = None, **filters) -> DataFrame:
    """All entries by source, newest first in each."""
    return filter_entries(entries, state, **filters).orderBy("source_id", *newest_first())


def recent_fetch_logs(log: DataFrame, source_id: int = 0, limit: int = 50) -> DataFrame:
    """The last rows of the log, of one source or of all."""
    found = log.where(F.col("source_id") == source_id) if source_id else log
    return found.orderBy(F.col("id").desc()).limit(page_size_of(limit))


def recent_fetch_logs_by_source(log: DataFrame, limit: int = 50) -> DataFrame:
    """The last rows of the log of every source."""
    order = W.partitionBy("source_id").orderBy(F.col("id").desc())
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= page_size_of(limit))
