"""Continuous forms: ingest, flags, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.ingest import ingest
from millrace.operators.refresh import refresh
from millrace.operators.state import apply_state_events
from millrace.operators.store import Store
from millrace.schemas import FLAGS, STATE


def stream_refresh(raw_docs: DataFrame, checkpoint: str, store: Store, sources: Callable[[], DataFrame], now: Callable[[], object], stream: str = "refresh", **trigger) -> StreamingQuery:
    """Refresh rounds over a stream of landed documents (schemas.RAW_DOC): each
    micro-batch changes entries, cursors, health, log and runs of the store together
    (see :func:`millrace.operators.refresh.refresh`).  A batch that was interrupted
    before its commit left nothing behind, one that is run again after it changes
    nothing."""

    def run(batch: DataFrame, number: int) -> None:
        refresh(batch, store, sources(), now(), stream, number)

    return raw_docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_ingest(
    items: DataFrame, checkpoint: str, read_entries: Callable[[], DataFrame], append: Callable[[DataFrame, int], None], now: Callable[[], object], **trigger
) -> StreamingQuery:
    """Ingests a stream of items (schemas.DOCUMENT_ITEM, or schemas.ITEM where a
    micro-batch has one document a source) batch by batch against all history.

    ``read_entries`` gives the store as it is, ``append`` adds new entries under a
    batch number; a batch that is run again finds its entries stored and adds
    none, or may be told by its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        append(ingest(batch, read_entries(), now()).entries, number)

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_state(
    events: DataFrame, checkpoint: str, read_state: Callable[[], DataFrame], entries: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], **trigger
) -> StreamingQuery:
    """Folds a stream of flag events into the state table; ``write_state`` gets the
    new snapshot under the batch number."""

    def run(batch: DataFrame, number: int) -> None:
        write_state(apply_state_events(read_state(), batch, entries()), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keyed_state(events: DataFrame, before: DataFrame | None = None, late: timedelta = timedelta(days=7)) -> DataFrame:
    """Rows of the state table (schemas.STATE) that a stream of flag events changes,
    kept as keyed state; for update mode, a row for each entry that a batch changes.

    Over all batches the rows are those of :func:`.operators.state.apply_state_events`
    over all events at once, in the order (ts, seq), repeated and late ones included:
    a flag holds its events of the last ``late`` before its newest one, and what they
    started from.  Events later than that are left out, so the state of an entry is
    bounded by the events of that time.  ``before`` is the state to start from (a row an
    entry): it meets the events of a batch, and an entry's row is taken with its first
    event, so entries without events cost no Python and no state.  Events without time or value or with an unknown flag are left out; those
    on unknown entries should be filtered first (``valid_events``).  Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    valid = events.where(F.col("flag").isin(*FLAGS) & F.col("value").isNotNull() & F.col("ts").isNotNull() & F.col("entry_id").isNotNull())
    if before is not None:
        own = before.select("entry_id", *(F.col(f).alias(f"old_{f}") for f in FLAGS), F.unix_micros("updated_at").alias("old_at"))
        valid = valid.join(own, "entry_id", "left")
    else:
        valid = valid.withColumns({**{f"old_{f}": F.lit(None).cast("boolean") for f in FLAGS}, "old_at": F.lit(None).cast("long")})
    return valid.groupBy("entry_id").transformWithStateInPandas(FlagState(late), STATE, "Update", "None")


class Flag(NamedTuple):
    """What a flag was, and since when, before the newest event that was let go
    (``cut``), and the events after it in order."""

    value: bool = False
    since: int | None = None
    cut: int | None = None
    events: tuple[tuple[int, int, bool], ...] = ()

    def with_events(self, new: set[tuple[int, int, bool]], late: int) -> "Flag":
        every = sorted(set(self.events) | {e for e in new if self.cut is None or e[0] > self.cut})
        value, since, cut, k = self.value, self.since, self.cut, 0
        while every[k:] and every[k][0] < every[-1][0] - late:
            cut = every[k][0]
            value, since = (every[k][2], cut) if every[k][2] != value else (value, since)
            k += 1
        return Flag(value, since, cut, tuple(every[k:]))

    def now(self) -> tuple[bool, int | None]:
        """Its value, and the time of its last change (None if it never changed)."""
        value, since = self.value, self.since
        for ts, _, v in self.events:
            if v != value:
                value, since = v, ts
        return value, since


class FlagState(StatefulProcessor):
    """The flags of an entry and the time of the row it started from, as one value."""

    def __init__(self, late: timedelta) -> None:
        self.late = late // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        flag = "struct<value: boolean, since: bigint, cut: bigint, ts: array<bigint>, seq: array<bigint>, set: array<boolean>>"
        self.state = handle.getValueState("flags", f"first bigint, {', '.join(f'{name} {flag}' for name in FLAGS)}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new: dict[str, set] = {}
        held, first, before = self.state.get(), None, None
        if held is not None:
            first = held[0]
            before = {name: Flag(value, since, cut, tuple(zip(*events))) for name, (value, since, cut, *events) in zip(FLAGS, held[1:])}
        for part in rows:
            if before is None:
                row = part.iloc[0]
                first = None if pd.isna(row["old_at"]) else int(row["old_at"])
                before = {name: Flag(False if pd.isna(row[f"old_{name}"]) else bool(row[f"old_{name}"])) for name in FLAGS}
            for ts, seq, name, value in zip(part["ts"], part["seq"], part["flag"], part["value"]):
                new.setdefault(name, set()).add((_micros(ts), int(seq), bool(value)))
        after = {name: flag.with_events(new[name], self.late) if name in new else flag for name, flag in before.items()}
        self.state.update((first, *((f.value, f.since, f.cut, *([e[k] for e in f.events] for k in range(3))) for f in after.values())))
        was, now = ([flag.now() for flag in flags.values()] for flags in (before, after))
        if was == now:
            return
        at = max((since for _, since in now if since is not None), default=first)
        yield pd.DataFrame({"entry_id": [key[0]], **{name: [value] for name, (value, _) in zip(FLAGS, now)}, "updated_at": pd.to_datetime([at], unit="us")})

    def close(self) -> None:
        pass


def _micros(at) -> int | None:
    return None if pd.isna(at) else int(pd.Timestamp(at).value // 1000)


def run_progress(events: DataFrame) -> DataFrame:
    """Events by source and type: how many, and what they inserted and skipped;
    for streams in update or complete mode."""
    return events.groupBy("source_id", "type").agg(
        F.count("*").alias("events"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.max("ts").alias("last_at")
    )


def windowed_progress(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same by tumbling windows, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "source_id", "type").agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), "source_id", "type", "events"
    )
