import contextlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import refresh, store
from millrace.operators.store import Change
from millrace.schemas import RAW_DOC
from millrace.streaming import streams

NOW = "2024-06-01 00:00:00"
SOURCES = "id long, type string, config string, enabled boolean, deleted boolean"


def feed(*guids):
    return json.dumps({"items": [{"id": g, "title": f"title {g}", "content_text": f"body {g}"} for g in guids]})


def page(*links):
    return "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links) + "</ul>"


def landed(spark, rows):
    """(source, doc, minute, body[, etag[, last modified]]) as documents."""
    full = [(s, d, f"https://s{s}.example/", f"2024-01-01 00:{m:02}:00", b, *rest, *[""] * (2 - len(rest))) for s, d, m, b, *rest in rows]
    return spark.createDataFrame(full, RAW_DOC.replace("timestamp", "string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


@pytest.fixture
def sources(spark):
    selector = json.dumps({"selector": "li a"})
    rows = [(1, "feed", "{}", True, False), (2, "webpage", selector, True, False), (3, "webpage", json.dumps({"selector": "a["}), True, False), (4, "feed", "{}", False, False), (5, "bilibili", json.dumps({"mode": "favorites"}), True, False)]
    return spark.createDataFrame(rows, SOURCES)


def state(s, version=None):
    """All tables of a store as plain rows, without times of writing."""
    drop = {"created_at", "updated_at"}
    return {t: sorted((repr({k: v for k, v in r.asDict().items() if k not in drop}) for r in s.read(t, version).collect())) for t in refresh.TABLES}


def test_a_round_changes_all_tables(spark, tmp_path, sources):
    s = refresh.open_store(spark, str(tmp_path))
    favorites = json.dumps({"ok": True, "data": json.dumps([{"bvid": "B1", "title": "v"}])})
    got = refresh.refresh(
        landed(spark, [(1, "a", 0, feed("x", "y", "x"), "e1"), (1, "b", 1, "<rss><bad", "e2"), (2, "p", 0, page("3", "2")), (3, "q", 0, page("1")), (4, "off", 0, feed("z")), (5, "v", 0, favorites), (1, None, 2, None)]), s, sources, NOW
    )
    assert sorted(r.guid for r in s.read("entries").collect()) == ["B1", "https://s2.example/2", "https://s2.example/3", "x", "y"]
    assert sorted(r.id for r in s.read("entries").collect()) == [1, 2, 3, 4, 5]
    assert [r.reason for r in got.rejected.collect()] == ["guid"]
    assert {r.source_id: json.loads(r.cursor) for r in s.read("cursors").collect()} == {1: {"etag": "e1"}, 2: {"newest_url": "https://s2.example/3"}}
    health = {r.source_id: (r.fail_count, r.last_error != "") for r in s.read("health").collect()}
    assert health == {1: (2, True), 2: (0, False), 3: (1, True), 5: (0, False)}
    log = [(r.id, r.source_id, r.inserted, r.skipped, r.success) for r in s.read("log").orderBy("id").collect()]
    assert log == [(1, 1, 2, 1, True), (2, 1, 0, 0, False), (3, 1, 0, 0, False), (4, 2, 2, 0, True), (5, 3, 0, 0, False), (6, 5, 1, 0, True)]
    run = s.read("runs").first()
    assert (run.sources, run.inserted, run.skipped, run.errors, run.unchanged, run.first_id, run.last_id) == (4, 5, 1, 3, 0, 1, 5)


def test_unchanged_documents_are_not_parsed_and_keep_the_cursor(spark, tmp_path, sources):
    s = refresh.open_store(spark, str(tmp_path))
    refresh.refresh(landed(spark, [(1, "a", 0, feed("x"), "e1"), (2, "p", 0, page("2", "1"))]), s, sources, NOW)
    refresh.refresh(landed(spark, [(1, "b", 1, "not even a feed", "e1"), (2, "p", 1, page("2", "1"))]), s, sources, NOW)
    runs = s.read("runs").orderBy("batch").collect()
    assert [(r.inserted, r.skipped, r.errors, r.unchanged) for r in runs] == [(3, 0, 0, 0), (0, 0, 0, 2)]
    refresh.refresh(landed(spark, [(1, "c", 2, feed("y", "x"), "", "Mon"), (2, "p", 2, page("4", "3", "2", "1"))]), s, sources, NOW)
    assert sorted(r.guid.rsplit("/", 1)[-1] for r in s.read("entries").collect()) == ["1", "2", "3", "4", "x", "y"]
    last = s.read("runs").where("batch = 2").first()
    assert (last.inserted, last.skipped) == (3, 1)  # the page is cut before 2, the feed is not
    assert {r.source_id: json.loads(r.cursor) for r in s.read("cursors").collect()} == {1: {"last_modified": "Mon"}, 2: {"newest_url": "https://s2.example/4"}}
    refresh.refresh(landed(spark, [(1, "d", 3, "other", "", "Mon"), (1, "e", 4, feed())]), s, sources, NOW)
    assert {r.source_id for r in s.read("cursors").collect()} == {2}
    assert [(r.errors, r.unchanged) for r in s.read("runs").where("batch = 3").collect()] == [(0, 1)]


def test_failures_add_up(spark, tmp_path, sources):
    s = refresh.open_store(spark, str(tmp_path))
    for k, bodies in enumerate((["bad", "worse"], ["bad"])):
        refresh.refresh(landed(spark, [(1, str(i), 10 * k + i, b) for i, b in enumerate(bodies)]), s, sources, NOW)
        row = s.read("health").first()
        assert (row.fail_count, row.last_error != "") == [(2, True), (3, True)][k]


def test_equal_documents_count_once_and_one_name_may_have_two_bodies(spark, tmp_path, sources):
    s = refresh.open_store(spark, str(tmp_path))
    refresh.refresh(landed(spark, [(1, "a", 0, feed("x")), (1, "a", 0, feed("x")), (1, "a", 0, feed("y")), (1, None, 0, feed("z")), (1, None, 0, feed("w"))]), s, sources, NOW)
    assert sorted(r.guid for r in s.read("entries").collect()) == ["w", "x", "y", "z"]
    assert s.read("log").count() == 4


RAW = [[(1, "a", 0, feed("x", "y"), "e1"), (2, "p", 0, page("1"))], [(1, "b", 1, feed("y", "z"), "e2"), (1, "c", 2, "bad"), (2, "p", 1, page("2", "1"))]]


def streamed(spark, base, sources, batches, fail=None):
    """A store after a stream of batches, the last of which ``fail`` may stop at first."""
    s = refresh.open_store(spark, f"{base}/store")
    for k, rows in enumerate(batches):
        landed(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        docs = spark.readStream.schema(landed(spark, rows).schema).parquet(f"{base}/in")
        start = lambda: streams.stream_refresh(docs, f"{base}/check", s, lambda: sources, lambda: NOW).awaitTermination()
        if fail and k == len(batches) - 1:
            with fail(), pytest.raises(Exception, match="stopped here"):
                start()
            s = refresh.open_store(spark, f"{base}/store")  # a new driver
        start()
    return s


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """State after one and after both batches, without failures."""
    selector = json.dumps({"selector": "li a"})
    sources = spark.createDataFrame([(1, "feed", "{}", True, False), (2, "webpage", selector, True, False)], SOURCES)
    s = streamed(spark, tmp_path_factory.mktemp("plain"), sources, RAW)
    assert [(r.inserted, r.skipped, r.errors) for r in s.read("runs").orderBy("batch").collect()] == [(3, 0, 0), (2, 1, 1)]
    return sources, {v: state(s, v) for v in (1, 2)}


@pytest.mark.parametrize("step", ["upsert", "after"])
def test_a_batch_that_fails_between_writes_is_run_again(spark, tmp_path, plain, step):
    """Stopped at the third upsert, before the commit, or after the commit but before
    the stream has noted the batch (the second one)."""
    sources, want = plain
    name, calls = "commit" if step == "after" else step, []
    whole = getattr(Change, name)

    def broken(self, *a, **b):
        calls.append(1)
        if step == "after":
            whole(self, *a, **b)
        if step != "upsert" or len(calls) == 3:
            raise RuntimeError("stopped here")
        return whole(self, *a, **b)

    @contextlib.contextmanager
    def fail():
        setattr(Change, name, broken)
        try:
            yield
        finally:
            setattr(Change, name, whole)

    batches = RAW if step == "after" else RAW[:1]
    again = streamed(spark, tmp_path, sources, batches, fail)
    assert again.version == len(batches) and state(again) == want[len(batches)]


# -- the store itself ------------------------------------------------------------------


def test_upserts_rewrite_only_touched_buckets_and_old_versions_stay(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), {"t": store.Table("k long, v string", ("k",), 16), "log": store.Table("n int")})
    whole = spark.range(1000).selectExpr("id AS k", "'old' AS v")
    c = s.change()
    c.upsert("t", whole)
    c.commit()
    before = {p.bucket: p.path for p in s.parts}
    c = s.change()
    touched = c.upsert("t", spark.createDataFrame([(5, "new"), (5000, "more")], "k long, v string"), spark.createDataFrame([(7,)], "k long"))
    c.append("log", spark.createDataFrame([(1,)], "n int"))
    assert s.read("t").where("v <> 'old'").count() == 0 and s.read("log").count() == 0  # nothing yet
    c.commit()
    after = {p.bucket: p.path for p in s.parts if p.name == "t"}
    assert 1 <= len(touched) <= 3 and {b for b in after if before[b] != after[b]} == set(touched)
    rows = {r.k: r.v for r in s.read("t").collect()}
    assert rows == {k: "new" if k == 5 else "old" for k in range(1000) if k != 7} | {5000: "more"}
    assert s.read("t", version=1).count() == 1000 and s.read("t", version=1).where("v <> 'old'").count() == 0
    assert store.Store(spark, str(tmp_path), s.tables).read("t").count() == 1000
    c = s.change()
    c.upsert("t", whole.limit(0), s.read("t").select("k"))
    c.commit()
    assert s.read("t").count() == 0 and not [p for p in s.parts if p.name == "t"]
    with pytest.raises(ValueError):
        s.read("t", version=9)


def test_appended_parts_are_compacted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), {"log": store.Table("n int")})
    for k in range(4):
        c = s.change()
        c.append("log", spark.createDataFrame([(k,)], "n int"))
        c.compact("log", 3)
        c.commit("x", k)
    assert len(s.parts) == 1 and sorted(r.n for r in s.read("log").collect()) == [0, 1, 2, 3]
    assert s.holds("x", 3) and not s.holds("x", 4) and not s.holds("y", 0)
