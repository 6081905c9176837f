import pytest
from pyspark.sql import functions as F

from millrace.operators import known
from millrace.operators.dedup import entry_keys, reject_known
from millrace.operators.store import Store

ENTRIES = "id long, source_id long, guid string, url string, content_hash string, deleted boolean"
CANDS = "source_id long, pos int, guid string, url string, content_hash string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), known.TABLES)


def entries(spark, ids):
    return spark.createDataFrame([(i, i % 3, f"g{i}", f"u{i}", f"h{i}" if i % 2 else "", i % 10 == 0) for i in ids], ENTRIES)


def add(store, rows):
    change = store.change()
    known.add_keys(change, rows)
    change.commit()


@pytest.mark.parametrize("few", [True, False])
def test_reasons_equal_those_of_a_join_with_all_keys(spark, store, monkeypatch, few):
    monkeypatch.setattr(known, "BROADCAST_KEYS", 10**6 if few else 0)
    add(store, entries(spark, range(300)))
    add(store, entries(spark, range(300, 500)))
    rows = [(i % 4, i, f"g{i}", f"u{i + 7}" if i % 5 == 0 else "", f"h{i + 1}" if i % 7 == 0 else f"new{i}") for i in range(0, 900, 3)] + [(1, 1000, None, "", None)]
    cands = spark.createDataFrame(rows, CANDS).withColumn("ord", F.struct("source_id", "pos"))
    got, want = (sorted(map(tuple, df.select("source_id", "pos", "reason", "entry_id").collect())) for df in (known.reject_known_in(cands, store), reject_known(cands, entry_keys(entries(spark, range(500))))))
    assert got == want and len({r for *_, r, _ in got}) == 4


def test_few_keys_read_few_buckets_and_the_store_is_not_shuffled(spark, store, monkeypatch):
    add(store, entries(spark, range(2000)))
    passed = known.may_be_known(spark.createDataFrame([(1, "u1"), (1, "strange"), (2, "h3"), (2, "other")], "layer int, key string"), store)
    assert {(r.layer, r.key) for r in passed.collect()} >= {(1, "u1"), (2, "h3")} and passed.count() <= 3
    read, plans = [], []
    whole, write = Store.read, known.written
    monkeypatch.setattr(Store, "read", lambda self, name, *a, **b: read.append((name, b.get("buckets"))) or whole(self, name, *a, **b))
    monkeypatch.setattr(known, "written", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or write(df, tag))
    cands = spark.createDataFrame([(9, 1, "g", "u1", "h3")], CANDS).withColumn("ord", F.struct("source_id", "pos"))
    assert known.reject_known_in(cands, store).first().reason == "url"
    assert [len(b) for name, b in read if name == "keys"] == [2]
    plan = dict(plans)["known-keys"]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_strange_keys_seldom_pass(spark, store):
    add(store, entries(spark, range(3000)))
    strange = spark.range(5000).selectExpr("1 AS layer", "concat('strange', id) AS key")
    assert known.may_be_known(strange, store).count() < 50


def test_deleted_entries_stop_blocking(spark, store):
    add(store, entries(spark, range(1, 40)))
    change = store.change()
    known.drop_keys(change, entries(spark, [7]))
    change.commit()
    cands = spark.createDataFrame([(1, 0, "g7", "u7", "h7"), (1, 1, "", "u8", "")], CANDS).withColumn("ord", F.struct("source_id", "pos"))
    assert [r.reason for r in known.reject_known_in(cands, store).orderBy("pos").collect()] == [None, "url"]


def test_an_empty_store_knows_nothing(spark, store):
    cands = spark.createDataFrame([(1, 0, "g", "u", "h")], CANDS).withColumn("ord", F.struct("source_id", "pos"))
    assert known.reject_known_in(cands, store).first().reason is None
