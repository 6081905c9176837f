from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.state import apply_state_events
from millrace.schemas import ENTRY, EVENT, FLAGS, ITEM, STATE
from millrace.streaming import streams

NOW = "2024-06-01 00:00:00"


def test_stream_of_items(spark, tmp_path):
    store = tmp_path / "store"
    row = lambda pos, guid: (1, pos, guid, "", f"title {guid}", "", None, False, "", guid, "text/plain", [], {}, None)

    def read():
        return spark.read.schema(ENTRY).parquet(str(store)) if store.exists() else spark.createDataFrame([], ENTRY)

    def append(new, number):
        new.write.mode("append").parquet(str(store))

    for k, guids in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([row(i, g) for i, g in enumerate(guids)], ITEM).write.mode("append").parquet(str(tmp_path / "in"))
        items = spark.readStream.schema(spark.createDataFrame([], ITEM).schema).parquet(str(tmp_path / "in"))
        streams.stream_ingest(items, str(tmp_path / "check"), read, append, lambda: NOW).awaitTermination()
        assert sorted(r.guid for r in read().collect()) == (["a", "b"] if k == 0 else ["a", "b", "c"])
    assert sorted(r.id for r in read().collect()) == [1, 2, 3]


def test_stream_of_flags(spark, tmp_path):
    entries = spark.createDataFrame([(i, 1, "", "", "", "", "", None, "", "", "", [], {}, None, None, None, False) for i in (1, 2)], ENTRY)
    snapshots = {0: spark.createDataFrame([], STATE)}
    paths = []

    def write(df, number):
        paths.append(str(tmp_path / f"state-{len(paths)}"))
        df.write.parquet(paths[-1])

    read = lambda: spark.read.parquet(paths[-1]) if paths else snapshots[0]
    for events in ([(1, 1, "read", True), (2, 2, "favorite", True)], [(3, 1, "read", False), (4, 9, "read", True)]):
        df = spark.createDataFrame([(s, None, e, f, v) for s, e, f, v in events], EVENT).withColumn("ts", F.timestamp_seconds(F.col("seq")))
        df.write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
        streams.stream_state(stream, str(tmp_path / "check"), read, lambda: entries, write).awaitTermination()
    assert sorted((r.entry_id, r.read, r.favorite) for r in read().collect()) == [(1, False, False), (2, False, True)]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def entries_of(spark, n):
    return spark.createDataFrame([(i, 1, "", "", "", "", "", None, "", "", "", [], {}, None, None, None, False) for i in range(n)], ENTRY)


def folded(spark, base, batches, before, late):
    """Rows after a stream of batches, each by a query of its own that goes on from the
    checkpoint."""
    rows = {r.entry_id: r for r in before.collect()}
    for k, events in enumerate(batches):
        events.coalesce(1).write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        changed = []
        q = streams.keyed_state(stream, before, late).writeStream.outputMode("update").foreachBatch(lambda df, n: changed.extend(df.collect()))
        q.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
        rows |= {r.entry_id: r for r in changed}
    return sorted(tuple(r[c] for c in ("entry_id", *FLAGS, "updated_at")) for r in rows.values())


def test_keyed_flags_equal_a_fold_of_all_events(spark, tmp_path, rocksdb):
    """Three batches of which each has late and repeated events, with a restart between."""
    drawn = np.random.default_rng(5)
    n = 240
    when = np.arange(n) + drawn.integers(-90, 90, n)
    rows = [(k, int(t), int(e), str(f), bool(v)) for k, t, e, f, v in zip(range(n), when, drawn.integers(0, 6, n), drawn.choice([*FLAGS, "other"], n), drawn.integers(0, 2, n))]
    as_events = lambda x: spark.createDataFrame(x, EVENT.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds(F.lit(10_000) + F.col("ts")))
    before = spark.createDataFrame([(0, True, False, True, False), (5, False, False, False, True)], "entry_id long, read boolean, favorite boolean, archive boolean, read_later boolean").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    batches = [as_events(rows[:100]), as_events(rows[60:170]), as_events(rows[170:] + rows[:20])]
    want = apply_state_events(before, as_events(rows), entries_of(spark, 6))
    assert folded(spark, tmp_path, batches, before, timedelta(days=1)) == sorted(tuple(r) for r in want.select("entry_id", *FLAGS, "updated_at").collect())


def test_flags_hold_the_events_of_a_time_only():
    flag = streams.Flag()
    for k in range(1000):
        flag = flag.with_events({(k, k, k % 3 == 0)}, 10)
    assert len(flag.events) == 11 and flag.cut == 988 and flag.now() == (True, 999)
    assert flag.with_events({(5, 0, False), (988, 0, True)}, 10) == flag
    late = flag.with_events({(998, 2000, True)}, 10)
    assert late.now() == (True, 998)
