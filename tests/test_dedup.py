from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.operators.dedup import dedup_first_wins, entry_keys, reject_known
from millrace.operators.ingest import ingest
from millrace.operators.tables import written
from millrace.schemas import ENTRY, ITEM

CAND = "source_id long, pos int, guid string, url string, content_hash string"


def one_by_one(rows):
    """Accepted positions and reasons by the plain loop."""
    held, out = {}, {}
    for source, pos, guid, url, hash_ in sorted(rows):
        keys = [k for k in (("guid", (source, guid)) if guid else None, ("url", url) if url else None, ("hash", hash_) if hash_ else None) if k]
        hits = [k for k in keys if k in held]
        if not keys:
            out[source, pos] = (False, "no_identity", None)
        elif hits:
            out[source, pos] = (False, hits[0][0], held[hits[0]])
        else:
            out[source, pos] = (True, None, None)
            held |= {k: (source, pos) for k in keys}
    return out


def judged(spark, rows, **kw):
    df = dedup_first_wins(spark.createDataFrame(rows, CAND), ["source_id", "pos"], **kw)
    return {(r.source_id, r.pos): (r.accepted, r.reason, tuple(r.winner) if r.winner else None) for r in df.collect()}


key = st.sampled_from(["", "a", "b", "c", "d", "e", "f"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), key, key, key), min_size=1, max_size=60))
def test_matches_the_plain_loop(spark, items):
    dedup.SPAN = 7 if len(items) % 2 else 1000  # several ranges, or one
    rows = [(s, i, g, u, h) for i, (s, g, u, h) in enumerate(items)]
    try:
        assert judged(spark, rows) == one_by_one(rows)
    finally:
        dedup.SPAN = 200_000


def counted(monkeypatch, span):
    tables = []
    monkeypatch.setattr(dedup, "written", lambda df, tag: tables.append(tag) or written(df, tag))
    monkeypatch.setattr(dedup, "SPAN", span)
    return tables


def test_chains_of_keys(spark, monkeypatch):
    tables = counted(monkeypatch, 1000)
    rows = [(1, i, f"g{i}", f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(200)]
    want = one_by_one(rows)
    assert sum(a for a, *_ in want.values()) == 100
    assert judged(spark, rows) == want and len(tables) == 5
    branches = [(2, i, "x7" if i % 5 == 0 else "", f"u{i // 3}", f"h{(i + 1) // 2 + 40}") for i in range(40)]
    assert judged(spark, rows + branches) == one_by_one(rows + branches)


def test_items_that_depend_on_two_earlier_ones(spark, monkeypatch):
    """Item i shares a key with i - 1 and one with i - 2, over four ranges: at most a
    round a range, two tables a round."""
    tables = counted(monkeypatch, 60)
    rows = [(1, i, f"a{i // 2}", f"b{(i + 1) // 2}", f"c{i // 4 * 2 + i % 2}") for i in range(240)]
    got = judged(spark, rows)
    assert got == one_by_one(rows) and len({r for _, r, _ in got.values()}) > 2
    assert tables.count("decided") <= 4 and len(tables) <= 5 + 2 * 4


def test_one_layer_takes_no_rounds(spark, monkeypatch):
    tables = counted(monkeypatch, 10)
    rows = [(1, i, "", "", f"h{i % 50}") for i in range(500)]
    assert judged(spark, rows, layers=("hash",)) == one_by_one(rows) and tables == ["candidates"]


def test_one_layer_with_rows_that_have_no_key(spark):
    rows = [(1, i, "g", f"u{i}", f"h{i % 5}" if i % 4 else "") for i in range(40)] + [(2, 0, "", "", "h1")]
    want = one_by_one([(s, i, "", "", h) for s, i, _, _, h in rows])
    assert judged(spark, rows, layers=("hash",)) == want and sum(r == "no_identity" for _, r, _ in want.values()) == 10


def test_scopes_and_hot_keys(spark):
    rows = [(1, 0, "g", "u1", "h1"), (2, 0, "g", "u2", "h2")] + [(3, i, "", "", "same") for i in range(3000)]
    got = judged(spark, rows)
    assert got[1, 0][0] and got[2, 0][0] and sum(a for a, *_ in got.values()) == 3


ITEMS = [
    (1, 0, "g1", "https://E.com/a/", "T", "", None, False, "", "<p>x</p><script>1</script>", "text/html", None, None, None),
    (1, 1, "g1", "https://e.com/b", "T2", "", None, False, "", "y", "text/html", None, None, None),
    (2, 0, "g1", "https://e.com/a#f", "T3", "", None, False, "", "z", "text/html", None, None, None),
    (2, 1, "g3", "https://e.com/c", "T", "", None, False, "", "<p>x</p>", "text/html", None, None, None),
    (2, 2, None, None, None, None, None, False, None, None, "text/html", None, None, None),
    (2, 3, "g5", "", "a < b && c > d", "", None, False, "", "a < b && c > d", "text/plain", ["t"], {"k": "v"}, None),
    (3, 0, "g6", "https://e.com/p", "Deleted before", "", None, False, "", "q", "text/plain", None, None, None),
]


def test_ingest(spark):
    items = spark.createDataFrame(ITEMS, ITEM).withColumn("fetched_at", F.lit("2024-05-01 01:02:03.7").cast("timestamp"))
    old = [(7, 3, "g6", "https://e.com/p", "hh", "D", "", None, "", "", "text/plain", [], {}, None, None, None, True)]
    store = spark.createDataFrame(old, ENTRY)
    got = ingest(items, store, "2024-06-01 00:00:00")
    rows = {r.id: r for r in got.entries.collect()}
    assert [(i, rows[i].source_id, rows[i].url) for i in sorted(rows)] == [(8, 1, "https://e.com/a"), (9, 2, ""), (10, 3, "https://e.com/p")]
    assert rows[8].content == "<p>x</p>" and rows[9].content == "a < b && c > d" and rows[8].tags == [] and rows[9].extra == {"k": "v"}
    assert str(rows[8].published_at) == "2024-05-01 01:02:03"
    assert {(r.source_id, r.pos): r.reason for r in got.rejected.collect()} == {(1, 1): "guid", (2, 0): "url", (2, 1): "hash", (2, 2): "no_identity"}
    assert tuple(got.summary.first()) == (3, 3, 4, 0)
    again = ingest(items, store.unionByName(got.entries), "2024-06-02 00:00:00")
    assert tuple(again.summary.first()) == (3, 0, 7, 0)
    assert ingest(items.limit(0), store, "2024-06-01 00:00:00").entries.count() == 0


def test_known_keys_of_the_first_layer(spark):
    store = spark.createDataFrame([(1, 1, "g", "u", "h", *([None] * 5), "", [], {}, None, None, None, False)], ENTRY)
    cands = spark.createDataFrame([(1, 0, "g", "x", "h"), (2, 0, "g", "u", "h"), (2, 1, "", "", "h"), (2, 2, "z", "z", "z")], CAND).withColumn("ord", F.struct("source_id", "pos"))
    assert [r.reason for r in reject_known(cands, entry_keys(store)).orderBy("ord").collect()] == ["guid", "url", "hash", None]
