import io
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import export, health, listing, search, state, tables
from millrace.schemas import CURSOR, ENTRY, EVENT, FETCH_LOG, STATE


def entries(spark, rows):
    """rows: id, source_id, title, content, published, deleted and more by name."""
    full = []
    for r in rows:
        full.append((r["id"], r.get("source_id", 1), r.get("guid", ""), r.get("url", ""), "", r.get("title", ""), r.get("author", ""), r.get("published"), r.get("summary", ""), r.get("content", ""), r.get("content_type", "text/plain"), r.get("tags", []), r.get("extra", {}), r.get("fetched"), None, None, r.get("deleted", False)))
    schema = ENTRY.replace("published_at timestamp", "published_at string").replace("fetched_at timestamp", "fetched_at string")
    return spark.createDataFrame(full, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "fetched_at")})


def sources(spark, names):
    return spark.createDataFrame([(i, n, False) for i, n in names], "id long, name string, deleted boolean")


# -- state ------------------------------------------------------------------------------


def fold(old, events, live):
    out = {k: dict(v) for k, v in old.items()}
    for seq, ts, entry, flag, value in sorted(events, key=lambda e: (e[1], e[0])):
        if entry not in live or flag not in ("read", "favorite", "archive", "read_later"):
            continue
        if out.get(entry, {}).get(flag, False) != value:
            row = out.setdefault(entry, {"at": ts})
            row[flag] = value
            row["at"] = ts
    return {k: (*(v.get(f, False) for f in ("read", "favorite", "archive", "read_later")), v["at"]) for k, v in out.items()}


def test_state_events_match_a_loop(spark):
    rng = random.Random(3)
    for _ in range(4):
        stamps = [f"2024-01-01 00:{m:02d}:00" for m in range(10, 60)]
        events = [(i, rng.choice(stamps), rng.randint(1, 8), rng.choice(["read", "favorite", "archive", "read_later", "other"]), rng.random() < 0.5) for i in range(120)]
        old = {i: {"read": i % 2 == 0, "read_later": i % 3 == 0, "at": "2024-01-01 00:00:00"} for i in (1, 2, 3, 7)}
        es = spark.createDataFrame(events, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        st = spark.createDataFrame([(i, v["read"], False, False, v["read_later"], v["at"]) for i, v in old.items()], STATE.replace("timestamp", "string")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        live = entries(spark, [{"id": i, "deleted": i == 6} for i in range(1, 8)])
        got = {r.entry_id: (r.read, r.favorite, r.archive, r.read_later, str(r.updated_at)) for r in state.apply_state_events(st, es, live).collect()}
        assert got == fold(old, events, {1, 2, 3, 4, 5, 7})


def test_no_ops_and_read_later(spark):
    live = entries(spark, [{"id": i, "published": "2024-01-01"} for i in (1, 2, 3)])
    empty = spark.createDataFrame([], STATE)
    event = lambda rows: spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    st = state.apply_state_events(empty, event([(1, "2024-01-01", 1, "read_later", True), (2, "2024-01-02", 3, "read_later", True), (3, "2024-01-03", 2, "read", False)]), live)
    assert [r.id for r in state.read_later(live, st).collect()] == [3, 1] and st.count() == 2
    st = state.apply_state_events(st, event([(4, "2024-01-05", 1, "read_later", True), (5, "2024-01-06", 3, "read_later", False)]), live)
    assert [r.id for r in state.read_later(live, st).collect()] == [1]
    assert str(st.where("entry_id = 1").first().updated_at)[:10] == "2024-01-01"
    assert [r.id for r in listing.list_entries(live, st, read=False).collect()] == [3, 2, 1]


# -- tables, lists, health ----------------------------------------------------------------


def test_cursors(spark):
    rows = lambda x: spark.createDataFrame(x, CURSOR.replace("timestamp", "string")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    c = tables.advance_cursors(rows([(1, "a", "2024-01-01"), (2, "b", "2024-01-01")]), rows([(1, "", "2024-01-03"), (1, "x", "2024-01-02"), (3, "n", "2024-01-02")]))
    assert sorted((r.source_id, r.cursor) for r in c.collect()) == [(2, "b"), (3, "n")]


def test_pages(spark):
    e = entries(spark, [{"id": i, "published": "2024-01-01"} for i in range(1, 121)])
    assert listing.list_entries(e).count() == 50 and listing.list_entries(e, page_size=500).count() == 50 and listing.list_entries(e, page=3).count() == 20
    assert [r.id for r in listing.list_entries(e, page=0, page_size=2).collect()] == [120, 119]
    assert [r.id for r in listing.list_entries(e, page_size=2, after=("2024-01-01 00:00:00", 119)).collect()] == [118, 117]


def test_fetch_log(spark):
    rows = [(1, 1, "2024-01-01 01:00:00", 100, 1, 0, True, ""), (2, 1, "2024-01-01 02:00:00", 120, 0, 0, True, ""), (3, 1, "2024-01-01 03:00:00", 150, 0, 0, False, "boom"), (4, 2, "2024-01-01 04:00:00", 5, 0, 0, False, "x")]
    log = spark.createDataFrame(rows, FETCH_LOG.replace("timestamp", "string")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    s = {r.source_id: r for r in health.fetch_stats(log).collect()}
    assert (s[1].total, s[1].success, str(s[1].last_success_at), s[1].last_elapsed_ms, s[2].total, s[2].last_success_at) == (3, 2, "2024-01-01 02:00:00", 150, 1, None)
    assert {r.source_id: (r.fail_count, r.last_error) for r in health.source_health(log).collect()} == {1: (1, "boom"), 2: (1, "x")}
    assert [r.id for r in listing.recent_fetch_logs(log, 0, 2).collect()] == [4, 3]


# -- search ---------------------------------------------------------------------------------


def test_search_examples(spark):
    told = [{"id": 1, "title": "山路很滑", "content": "雨后山路 Warning 牌"}, {"id": 2, "title": "湖面结冰", "content": "湖面已结冰"}, {"id": 3, "title": "山路", "deleted": True}]
    e = entries(spark, [*told, *({"id": 20 + i, "title": f"河流记录{i}"} for i in range(3))])
    find = lambda q: sorted(r.id for r in search.matching_entries(e, q).collect())
    assert find("山路 很滑") == [1] and find("结冰") == [2] and find("沙漠") == [] and find("WARNING") == [1] and find("+ 湖面") == [2] and find("+") == []
    page, total = search.search_entries(e, "流记", page=2, page_size=2)
    assert (page.count(), total.first().total) == (1, 3)
    with pytest.raises(ValueError):
        search.search_entries(e, " \t")


def test_search_agrees_with_fts5(spark):
    rng = random.Random(5)
    words = ["oak", "Elm", "ash-bay", "Über", "山路", "很滑", "山路牌子", "k7", "p.q", "ΜΣ"]
    rows = [{"id": i, "title": " ".join(rng.choices(words, k=3)), "content": " ".join(rng.choices(words, k=6)), "author": rng.choice(words)} for i in range(60)]
    e = entries(spark, rows)
    terms = spark.createDataFrame([(i, " ".join(rng.choices(words + ["oak-elm", "山路很滑", "elm oak", "+"], k=k))) for i, k in enumerate([1, 1, 1, 2, 2, 2, 3, 1, 2, 1, 1, 1])], "query_id long, q string")
    from millrace.functions.text import bigram_tokenize, collapse_white

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, summary, content, author)")
    for r in e.select("id", *(bigram_tokenize(c).alias(c) for c in search.COLUMNS)).collect():
        con.execute("INSERT INTO t(rowid, title, summary, content, author) VALUES (?, ?, ?, ?, ?)", tuple(r))
    want = set()
    queries = terms.select("query_id", "q", collapse_white(bigram_tokenize("q")).alias("b")).collect()
    for r in queries:
        phrases = " ".join('"' + p.replace('"', '""') + '"' for p in r.b.split(" "))
        want |= {(r.query_id, i) for (i,) in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (phrases,))}
    index = search.build_search_index(e)
    assert {tuple(r) for r in search.search_batch(terms, index).collect()} == want and want
    for r in queries[:3]:
        assert {x.id for x in search.matching_entries(e, r.q).collect()} == {i for q, i in want if q == r.query_id}


def test_index_follows_changes(spark):
    e = entries(spark, [{"id": 1, "title": "old one"}, {"id": 2, "title": "gone"}])
    changed = entries(spark, [{"id": 1, "title": "new one"}, {"id": 2, "title": "gone", "deleted": True}, {"id": 3, "title": "three"}])
    index = search.update_search_index(search.build_search_index(e), changed)
    assert sorted((r.entry_id, r.token) for r in index.collect()) == sorted((r.entry_id, r.token) for r in search.build_search_index(changed).collect())


# -- exports ----------------------------------------------------------------------------------


def names_by_loop(bases):
    taken, out = set(), []
    for base in bases:
        name, k = base, 1
        while name in taken:
            k += 1
            name = f"{base}-{k}"
        taken.add(name)
        out.append(name)
    return out


def test_file_names_match_a_loop(spark):
    rng = random.Random(7)
    for pool in (["a"], ["a", "a-2", "a-2-2", "b"], ["a", "a-3", "b-1", "b", "a-02"]):
        bases = [rng.choice(pool) for _ in range(30)]
        rows = spark.createDataFrame([("d", b, 1, 30 - i) for i, b in enumerate(bases)], "dir string, base string, source_id long, id long").withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
        got = [r.name for r in export.unique_file_names(rows).orderBy(F.col("id").desc()).collect()]
        assert got == names_by_loop(bases)


EXPORTED = [
    {"id": 1, "source_id": 1, "title": "Ferns", "content": "text body", "published": "2023-01-05", "tags": ["t1", "t2"], "extra": {"b": "2", "a": '"x"'}, "url": "https://e.com/1", "guid": "g", "author": "Ann"},
    {"id": 2, "source_id": 1, "title": "Only a summary", "summary": "summed up\n", "published": "2023-01-06"},
    {"id": 3, "source_id": 1, "title": "Ferns", "content": "c", "published": "2023-02-01"},
    {"id": 4, "source_id": 2, "title": "Unlinked", "content": "d", "published": "2023-01-07"},
]


def test_markdown(spark, tmp_path):
    e, s = entries(spark, EXPORTED), sources(spark, [(1, "North"), (2, "South/")])
    files = {r.path: r.text for r in export.export_markdown(e, s).collect()}
    assert sorted(files) == ["North/2023-01/Ferns.md", "North/2023-01/Only a summary.md", "North/2023-02/Ferns.md", "South_/2023-01/Unlinked.md"]
    one = files["North/2023-01/Ferns.md"]
    assert one.startswith('---\ntitle: "Ferns"\nauthor: "Ann"\nurl: "https://e.com/1"\nsource: "North"\n') and one.endswith('tags:\n    - "t1"\n    - "t2"\nextra:\n    "a": "\\"x\\""\n    "b": "2"\n---\n\ntext body\n')
    assert "url:" not in files["South_/2023-01/Unlinked.md"] and files["North/2023-01/Only a summary.md"].endswith("summed up\n")
    assert tuple(export.export_summary(e).first()) == (4, 2)
    for _ in range(2):
        export.write_markdown(e, s, str(tmp_path / "md"))
    assert {r.path: r.text for r in spark.read.parquet(str(tmp_path / "md")).collect()} == files


def test_json(spark):
    rows = {r.id: json.loads(r.line) for r in export.export_json(entries(spark, EXPORTED), sources(spark, [(1, "North")])).collect()}
    assert rows[1]["tags"] == ["t1", "t2"] and list(rows[1]["extra"]) == ["a", "b"] and "url" not in rows[2] and "source" not in rows[4]


def test_parts_of_chapters_and_books(spark):
    """Every article once and in order, chapters and books within their bytes."""
    rng = random.Random(11)
    days = ["2021-03-01", "2021-03-09", "2021-04-02", None]
    rows = [{"id": i, "source_id": 1 if i % 3 else 2, "title": f"t{i}", "content": "w" * rng.choice([1, 90, 700]), "published": rng.choice(days), "fetched": "2021-05-01"} for i in range(90)]
    e, s = entries(spark, rows), sources(spark, [(1, "North")])
    parts = export.export_epub_chapters(e, s, chapter_bytes=1000).orderBy("source_id", "chapter").collect()
    for source in (1, 2):
        own = [p for p in parts if p.source_id == source]
        assert [p.chapter for p in own] == list(range(1, len(own) + 1)) and len({p.file_name for p in own}) == len(own)
        told = [int(x.split("</h2>")[0][1:]) for p in own for x in p.xhtml.split("<h2>")[1:]]
        # month by month, the months in the order of their newest entry
        newest = sorted((r for r in rows if r["source_id"] == source), key=lambda r: (r["published"] or "", r["id"]), reverse=True)
        months = list(dict.fromkeys((r["published"] or r["fetched"])[:7] for r in newest))
        assert told == [r["id"] for m in months for r in newest if (r["published"] or r["fetched"])[:7] == m]
        assert max(len(p.xhtml) for p in own) < 1000 + 1200 and len(own) > len(months)
    ids = [i for r in export.month_chapters(e, ids_a_row=4).where("source_id = 1").orderBy("chapter", "part").collect() for i in r.ids]
    assert sorted(ids) == [r["id"] for r in rows if r["source_id"] == 1]
    books = export.export_epub(e, s, chapter_bytes=1000, book_bytes=5000).collect()
    assert sum(x.filename.startswith("OEBPS/chapter-") for b in books for x in zipfile.ZipFile(io.BytesIO(b.content)).infolist()) == len(parts)
    assert len(books) == len({b.file_name for b in books}) > 4 and export.export_epub(e.limit(0), s).count() == 0


def test_epub(spark, tmp_path):
    e, s = entries(spark, EXPORTED), sources(spark, [(1, "North"), (2, "South/")])
    assert [(r.month, r.chapter, r.ids) for r in export.month_chapters(e).where("source_id = 1").orderBy("chapter").collect()] == [("2023-02", 1, [3]), ("2023-01", 2, [2, 1])]
    book = export.export_epub(e, s).where("source_id = 1").first()
    z = zipfile.ZipFile(io.BytesIO(book.content))
    first = z.infolist()[0]
    assert (first.filename, first.compress_type, z.read("mimetype")) == ("mimetype", zipfile.ZIP_STORED, b"application/epub+zip")
    opf = z.read("OEBPS/content.opf").decode()
    assert all(f"chapter-2023-0{m}.xhtml" in opf for m in (1, 2)) and "<h2>Ferns</h2>" in z.read("OEBPS/chapter-2023-01.xhtml").decode()
    assert book.file_name == "North.epub" and export.export_epub(e, s, book_bytes=1).where("source_id = 1").count() == 2
    export.write_json_lines(e, s, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 4
