"""A refresh round: landed documents to entries, cursors, log and health at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import CURSOR, ENTRY, FETCH_LOG
from millrace.sources.registry import registered, with_sources

from . import known
from .ingest import ingest
from .store import Store, Table
from .tables import with_ids, written

SEEN = "source_id long, base_url string, etag string, last_modified string, digest string, fetched_at timestamp"
HEALTH = "source_id long, fail_count int, last_error string, updated_at timestamp"
RUN = "stream string, batch long, sources long, inserted long, skipped long, errors long, unchanged long, first_id long, last_id long"
#: Tables of a refresh store.  ``seen`` holds what was last read under each address.
TABLES = {
    "entries": Table(ENTRY), "cursors": Table(CURSOR, ("source_id",)), "health": Table(HEALTH, ("source_id",)),
    "seen": Table(SEEN, ("source_id", "base_url")), "log": Table(FETCH_LOG), "runs": Table(RUN), **known.TABLES,
}
#: A document: where it comes from, when it was fetched, its name and its digest.
DOC = ["source_id", "fetched_at", "doc_id", "digest"]


class Round(NamedTuple):
    """What a round found: new entries, rejected items with reasons, one row a document
    (log) and one row in all (run)."""

    entries: DataFrame
    rejected: DataFrame
    log: DataFrame
    run: DataFrame


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, TABLES)


def distinct_docs(raw_docs: DataFrame) -> DataFrame:
    """raw_docs with the digest of the body, each document once.  A document without
    a name is named by its digest; two bodies under one name are two documents."""
    digest = F.sha2(F.coalesce("body", F.lit("")), 256)
    named = raw_docs.withColumn("digest", digest).withColumns({"doc_id": F.coalesce("doc_id", "digest"), "base_url": F.coalesce("base_url", F.lit(""))})
    return named.dropDuplicates(DOC)


def changed_docs(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """docs with ``unchanged``: whether what was last read under their address has
    their digest or etag, or, where there is no etag, their time of modification.
    Bodies are not compared and unchanged ones are never parsed."""
    last = seen.select("source_id", "base_url", *(F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "digest")))
    etag, modified = F.coalesce("etag", F.lit("")), F.coalesce("last_modified", F.lit(""))
    same = (F.col("digest") == F.col("_digest")) | ((etag != "") & (etag == F.col("_etag")))
    same |= (etag == "") & (F.coalesce("_etag", F.lit("")) == "") & (modified != "") & (modified == F.col("_last_modified"))
    joined = docs.join(last, ["source_id", "base_url"], "left")
    return joined.withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("_etag", "_last_modified", "_digest")


def refresh(raw_docs: DataFrame, store: Store, sources: DataFrame, now, stream: str = "refresh", batch: int | None = None, details: DataFrame | None = None) -> Round | None:
    """Reads landed documents (schemas.RAW_DOC) of active sources into the store and
    commits entries, cursors, health, log, what was seen and the run together.

    A batch that the store holds changes nothing and gives None; without a number the
    next one is taken.  A document that can't be read is an error of its source: its
    cursor stays, the failure is counted, and the document is read again when it
    lands again.  Unchanged documents (see :func:`changed_docs`) have no items and
    leave the cursor.  Null and empty bodies are errors.  ``details`` fill in new items.

    Documents are shuffled once, by their address; items meet the store by their keys
    only, in the buckets whose filters they pass (see :mod:`.known`).  Cursors, health and what was seen are written
    for the buckets that the batch touches.
    """
    batch = store.batches.get(stream, -1) + 1 if batch is None else batch
    if store.holds(stream, batch):
        return None
    stamp = F.lit(now).cast("timestamp")
    cursors = store.read("cursors").select("source_id", "cursor")
    docs = changed_docs(distinct_docs(raw_docs), store.read("seen")).withColumn("body", F.when(~F.col("unchanged"), F.col("body")))
    docs = with_sources(docs, sources).join(cursors, "source_id", "left")
    docs = written(docs, "landed")
    heads, items = [docs.where("unchanged").select(*DOC, "base_url", "etag", "last_modified", F.lit("").alias("error"), F.lit(True).alias("unchanged"), F.lit(None).cast("string").alias("next"))], []
    for name, kind in registered().items():
        read = written(kind.read(docs.where((F.col("type") == name) & ~F.col("unchanged"))), f"read-{name}")
        heads.append(read.select(*DOC, "base_url", "etag", "last_modified", "error", "unchanged", F.when(F.col("error") == "", kind.cursor()).alias("next")))
        items.append(kind.items(read.where("error = ''"), keep=("digest",)))
    heads = written(reduce(DataFrame.unionByName, heads), "heads")
    items = written(reduce(DataFrame.unionByName, items), "items")
    last = store.read("runs").agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]
    got = ingest(items, store.read("entries"), now, details, known=lambda cands: known.reject_known_in(cands, store), last_id=last)
    rejected = written(got.rejected, "rejected")

    change = store.change()
    entries = change.append("entries", got.entries)
    known.add_keys(change, entries)
    log = change.append("log", _log(heads, items, rejected, store))
    change.upsert("seen", heads.where("error = '' AND NOT unchanged").groupBy("source_id", "base_url").agg(F.max_by(F.struct("etag", "last_modified", "digest", "fetched_at"), F.struct(*DOC)).alias("l")).select("source_id", "base_url", "l.*"))
    _move_cursors(change, heads, stamp)
    change.upsert("health", _health(heads, store.read("health"), stamp))
    run = change.append("runs", _run(heads, entries, rejected, stream, batch))
    change.compact("runs")
    change.compact("log")
    change.compact("entries", 256)
    change.commit(stream, batch)
    return Round(entries, rejected, log, run)


def _log(heads: DataFrame, items: DataFrame, rejected: DataFrame, store: Store) -> DataFrame:
    """A row of the fetch log for each document, numbered on from the last one."""
    n = items.groupBy(*DOC).agg(F.count("*").alias("n"))
    skipped = rejected.groupBy(*DOC).agg(F.count("*").alias("skipped"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in DOC]
    joined = heads.alias("h").join(n.alias("n"), same("h", "n"), "left").join(skipped.alias("s"), same("h", "s"), "left")
    skip = F.coalesce("s.skipped", F.lit(0))
    rows = joined.select(*(F.col(f"h.{c}") for c in DOC), (F.coalesce("n.n", F.lit(0)) - skip).alias("inserted"), skip.alias("skipped"), F.col("h.error").alias("error"))
    last = store.read("log").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return with_ids(rows, DOC, last + 1).select("id", "source_id", F.date_trunc("second", "fetched_at").alias("started_at"), F.lit(0).alias("elapsed_ms"), "inserted", "skipped", (F.col("error") == "").alias("success"), "error")


def _move_cursors(change, heads: DataFrame, stamp) -> None:
    """The next cursor of each source after its last document that has one."""
    last = heads.where("next IS NOT NULL").groupBy("source_id").agg(F.max_by("next", F.struct(*DOC)).alias("cursor"))
    last = written(last, "cursors")
    change.upsert("cursors", last.where("cursor <> ''").withColumn("updated_at", stamp), last.where("cursor = ''").select("source_id"))


def _health(heads: DataFrame, health: DataFrame, stamp) -> DataFrame:
    """Failures since the last document of a source that was read, and the last error."""
    at, failed = F.struct(*DOC), F.col("error") != ""
    ends = heads.groupBy("source_id").agg(F.max(F.when(~failed, at)).alias("ok"), F.max(F.when(failed, F.struct(at.alias("at"), "error"))).alias("bad"))
    late = heads.join(ends, "source_id").where(failed & (F.col("ok").isNull() | (at > F.col("ok")))).groupBy("source_id").agg(F.count("*").alias("n"))
    before = health.select("source_id", F.col("fail_count").alias("old"))
    joined = ends.join(late, "source_id", "left").join(before, "source_id", "left")
    n = F.coalesce("n", F.lit(0))
    total = F.when(F.col("ok").isNull(), n + F.coalesce("old", F.lit(0))).otherwise(n)
    return joined.select("source_id", total.cast("int").alias("fail_count"), F.when(n > 0, F.col("bad.error")).otherwise(F.lit("")).alias("last_error"), stamp.alias("updated_at"))


def _run(heads: DataFrame, entries: DataFrame, rejected: DataFrame, stream: str, batch: int) -> DataFrame:
    """One row: sources with a document, what came of the items, documents that
    couldn't be read or were unchanged, and the ids of the new entries, which follow
    each other."""
    seen = heads.agg(F.countDistinct("source_id").alias("sources"), F.count_if(F.col("error") != "").alias("errors"), F.count_if("unchanged").alias("unchanged"))
    new = entries.agg(F.count("*").alias("inserted"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    old = rejected.agg(F.count("*").alias("skipped"))
    return seen.join(new).join(old).withColumns({"stream": F.lit(stream), "batch": F.lit(batch)})  # a row each
