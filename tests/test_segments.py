import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import bigram_tokenize, collapse_white
from millrace.operators import search, segments

from .test_state_search_export import entries

WORDS = ["oak", "Elm", "ash-bay", "Über", "山路", "很滑", "山路牌子", "k7", "p.q", "oak oak"]


@pytest.fixture
def index(spark, tmp_path):
    return segments.open_index(spark, str(tmp_path / "index"), buckets=3)


def told(rng, ids):
    return [{"id": i, "title": " ".join(rng.choices(WORDS, k=3)), "content": " ".join(rng.choices(WORDS, k=6)), "author": rng.choice(WORDS)} for i in ids]


def by_fts5(spark, e, terms):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, summary, content, author)")
    for r in e.where("NOT deleted").select("id", *(bigram_tokenize(c).alias(c) for c in search.COLUMNS)).collect():
        con.execute("INSERT INTO t(rowid, title, summary, content, author) VALUES (?, ?, ?, ?, ?)", tuple(r))
    out = set()
    for r in terms.select("query_id", collapse_white(bigram_tokenize("q")).alias("b")).collect():
        phrases = " ".join('"' + p.replace('"', '""') + '"' for p in r.b.split(" "))
        out |= {(r.query_id, i) for (i,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (phrases,))}
    return out


def found(terms, index, version=None):
    rows = [tuple(r) for r in search_rows(terms, index, version)]
    assert len(rows) == len(set(rows))
    return set(rows)


def search_rows(terms, index, version=None):
    return segments.search_segments(terms, index, version).collect()


def postings(df):
    """Every (token, entry, column, position) of blocks."""
    each = df.select("token", "chunk", F.explode("places").alias("p"))
    return sorted(tuple(r) for r in each.select("token", F.col("chunk") * 128 + F.col("p.id"), "p.col", F.explode("p.pos")).collect())


def test_segments_agree_with_fts5_after_changes_and_merges(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    monkeypatch.setattr(segments, "CHUNK_BITS", 2)
    rng = random.Random(11)
    asked = [" ".join(rng.choices(WORDS + ["oak-elm", "山路很滑", "elm oak", "oak-oak", "nowhere"], k=rng.choice([1, 1, 2, 3]))) for _ in range(20)]
    terms = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    now = {r["id"]: r for r in told(rng, range(60))}
    segments.add_segment(index, entries(spark, list(now.values())))
    first = by_fts5(spark, entries(spark, list(now.values())), terms)
    assert found(terms, index) == first and first
    for _ in range(3):
        changed = told(rng, rng.sample(range(70), 8))
        for r in changed[:2]:
            r["deleted"] = True
        now |= {r["id"]: r for r in changed}
        segments.add_segment(index, entries(spark, changed))
        assert index.read("segments").count() <= 2
    last = entries(spark, list(now.values()))
    assert found(terms, index) == by_fts5(spark, last, terms)
    assert found(terms, index, version=1) == first  # older versions stay readable


def test_a_full_merge_equals_a_rebuilt_index(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 1)
    rng = random.Random(3)
    old, new = told(rng, range(20)), told(rng, range(12))
    new[0]["deleted"] = True
    segments.add_segment(index, entries(spark, old))
    segments.add_segment(index, entries(spark, new))
    assert index.read("dead").isEmpty() and index.read("segments").count() == 1
    assert postings(index.read("blocks")) == postings(segments.segment_blocks(entries(spark, [*new, *old[12:]]), 1))


def test_a_change_writes_its_own_postings_only(spark, index):
    rng = random.Random(4)
    segments.add_segment(index, entries(spark, told(rng, range(200))))
    segments.add_segment(index, entries(spark, [{"id": 7, "title": "one new title"}]))
    sizes = {r.seg: r.postings for r in index.read("segments").collect()}
    assert sizes[2] == 3 and sizes[1] > 1000 and index.read("dead").count() == 1


def test_empty_and_repeated_changes(spark, index):
    none = entries(spark, [{"id": 1}]).limit(0)
    terms = spark.createDataFrame([(1, "oak"), (2, ""), (3, "+"), (4, None)], "query_id long, q string")
    assert search_rows(terms, index) == []
    segments.add_segment(index, none)
    segments.add_segment(index, entries(spark, [{"id": 1, "title": "oak"}, {"id": -5, "content": "oak oak"}, {"id": 3, "deleted": True, "title": "oak"}]), "s", 0)
    at = index.version
    assert segments.add_segment(index, entries(spark, [{"id": 9, "title": "oak"}]), "s", 0) == at
    assert found(terms, index) == {(1, 1), (1, -5)}
    segments.add_segment(index, entries(spark, [{"id": 1, "deleted": True}]))  # a change without postings
    assert found(terms, index) == {(1, -5)}
    assert search_rows(terms.limit(0), index) == []


def test_a_rare_word_keeps_frequent_postings_unread(spark, index):
    e = entries(spark, [{"id": 0, "title": "seed"}]).crossJoin(spark.range(4000).withColumnRenamed("id", "k"))
    e = e.withColumns({"id": F.col("k"), "title": F.when(F.col("k") == 1234, F.lit("the zebra")).otherwise(F.lit("the"))}).drop("k")
    segments.add_segment(index, e)
    blocks = index.read("blocks").where("token = 'the'")
    assert blocks.count() == 32
    terms = spark.createDataFrame([(1, "the zebra")], "query_id long, q string")
    hits = segments.search_segments(terms, index)
    assert [tuple(r) for r in hits.collect()] == [(1, 1234)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk#" in plan and "= 9)" in plan  # 1234 >> 7: the scan is told the one chunk
