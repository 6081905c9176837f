import html
import json

import pytest
from pyspark.sql import functions as F

from millrace.schemas import RAW_DOC
from millrace.sources import feeds, pages, personal, registry

BAD = ["<rss><channel><item></rss>", "", None, "hello", "<html></html>", '{"items": [{"id": 5}]}', "[1]"]


def rows(n):
    """What the items of a feed of n should hold, by rules: every third has no link,
    every second full content, and tags by number."""
    return [{"id": f"k{i}", "link": "" if i % 3 == 2 else f"https://h{i}.test/p{i}", "title": f"N{i}", "by": f"w{i % 2}", "brief": f"b{i}", "full": f"<i>{i}</i>" if i % 2 else "", "tags": [f"t{j}" for j in range(i % 3)], "day": i + 1} for i in range(n)]


def rss(n):
    one = lambda r: f"<item><guid>{r['id']}</guid><title> {r['title']} </title><link>{r['link']}</link><dc:creator>{r['by']}</dc:creator><description>{r['brief']}</description><content:encoded><![CDATA[{r['full']}]]></content:encoded><pubDate>Mon, {r['day']:02} Mar 2021 06:00:00 GMT</pubDate>{''.join(f'<category>{t}</category>' for t in r['tags'])}</item>"
    return f"<?xml version='1.0'?><rss xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><title> R{n} </title>{''.join(map(one, rows(n)))}</channel></rss>"


def atom(n):
    one = lambda r: f"<entry><id>{r['id']}</id><title>{r['title']}</title><link rel='enclosure' href='no'/><link href='{r['link']}'/><author><name>{r['by']}</name></author><summary>{r['brief']}</summary><content>{html.escape(r['full'])}</content><updated>2021-03-{r['day']:02}T06:00:00Z</updated>{''.join(f'<category term=%r/>' % t for t in r['tags'])}</entry>"
    return f"<feed xmlns='http://www.w3.org/2005/Atom'><title>A{n}</title>{''.join(map(one, rows(n)))}</feed>"


def json_feed(n):
    one = lambda r: {"id": r["id"], "url": r["link"], "title": r["title"], "author": {"name": r["by"]}, "summary": r["brief"], "content_html": r["full"], "tags": r["tags"], "date_published": f"2021-03-{r['day']:02}T06:00:00Z"}
    return json.dumps({"title": f"J{n}", "items": list(map(one, rows(n)))})


def raw(spark, bodies):
    return spark.createDataFrame([(1, str(i), "https://e.com/list", None, b, "", "") for i, b in enumerate(bodies)], RAW_DOC)


def test_three_formats(spark):
    got = {(r.doc_id, r.pos): r for r in feeds.parse_feed(raw(spark, [rss(5), atom(4), json_feed(6)])).collect()}
    assert len(got) == 15
    for doc, n in (("0", 5), ("1", 4), ("2", 6)):
        for i, r in enumerate(rows(n)):
            x = got[doc, i]
            # RSS: the guid stands in for a link, the description for content, and the last category is the tag
            url, content, tags = (r["link"] or r["id"], r["full"] or r["brief"], r["tags"][-1:]) if doc == "0" else (r["link"], r["full"], r["tags"])
            assert (x.guid, x.url, x.title, x.author, x.summary, x.content) == (r["id"], url, r["title"], r["by"], r["brief"], content)
            assert x.tags == tags and str(x.published_at) == f"2021-03-{r['day']:02} 06:00:00" and not x.inferred_time
    assert [r.title for r in feeds.feed_titles(raw(spark, [rss(5), atom(4), json_feed(6)])).orderBy("doc_id").collect()] == ["R5", "A4", "J6"]


def test_broken_documents_fail_as_a_whole(spark):
    docs = raw(spark, BAD)
    assert feeds.parse_feed(docs).count() == 0
    assert feeds.feed_errors(docs).count() == len(BAD)


def test_limit(spark):
    many = json.dumps({"items": [{"id": str(i)} for i in range(250)]})
    assert feeds.parse_feed(raw(spark, [many])).count() == 200
    assert feeds.parse_feed(raw(spark, [many]), 0).count() == 250


def shelf(n, kind="s"):
    """A page of n links in shelves, with white space, other hosts and odd links by rule."""
    link = lambda i: ("//other.test/z" if i % 4 == 3 else f"/{kind}/{i}") if i % 2 else f"{kind}{i}"
    cells = "".join(f'<dd data-n="{i}"><b>{i}</b><a href="{link(i)}"> L{i}\n x </a></dd>' for i in range(n))
    odd = "".join(f'<em><a href="{h}">o</a></em>' for h in ("javascript:f()", "mailto:q@r.s", "#here", "", "ftp://f.test/"))
    return f"<html><head><title> T{n} </title></head><body><dl id={kind} class='left {kind}-box'>{cells}<dd>none</dd></dl>{odd}</body></html>"


def links(n, kind="s", base="https://e.com/"):
    return [("https://other.test/z" if i % 4 == 3 else f"{base}{kind}/{i}" if i % 2 else f"{base}{kind}{i}", f"L{i} x") for i in range(n)]


def test_lists_of_links(spark):
    get = lambda selector: [(r.url, r.title) for r in pages.parse_page_list(raw(spark, [shelf(6)]), selector).orderBy("pos").collect()]
    for selector in ("dl.s-box > dd", "dd a", "#s a", ".left dd > a", "dl dd[data-n]"):
        assert get(selector) == links(6), selector
    assert get("em a") == [] and get("em") == [] and get("dd[data-n='2'] a") == links(6)[2:3] and len(get("a[href^='/'], b")) == 3
    assert pages.page_titles(raw(spark, [shelf(2), None])).orderBy("doc_id").collect()[0].title == "T2"
    for bad in ("p[", "", "p >", "p:active", "p,,q"):
        with pytest.raises(ValueError):
            pages.parse_page_list(raw(spark, [shelf(1)]), bad)


def test_cursor_cut(spark):
    items = pages.parse_page_list(raw(spark, [shelf(3)]), "dd")
    cursor = lambda url: spark.createDataFrame([(1, json.dumps({"newest_url": url}))], "source_id long, cursor string")
    first = links(3)[0][0]
    for url, n in ((links(3)[1][0], 1), (first, 0), ("gone", 3)):
        kept, moved = pages.cut_at_cursor(items, cursor(url))
        assert kept.count() == n and json.loads(moved.first().cursor) == {"newest_url": first}


def test_pages_are_cut_inside_the_document_without_a_shuffle(spark):
    docs = raw(spark, [shelf(5)] * 4 + [shelf(0)]).withColumn("config", F.lit('{"selector": "dd"}'))
    cursors = [links(5)[2][0], links(5)[0][0], "gone", None, "gone"]
    cursor = F.element_at(F.array(*(F.lit(json.dumps({"newest_url": c})) if c else F.lit(None).cast("string") for c in cursors)), F.col("doc_id").cast("int") + 1)
    read = pages.read_pages(docs.withColumn("cursor", cursor))
    items = pages.items_of(read)
    assert {r.doc_id: r.n for r in items.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"0": 2, "2": 5, "3": 5}
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
    moved = {r.doc_id: r.c and json.loads(r.c)["newest_url"] for r in read.select("doc_id", pages.next_cursor().alias("c")).collect()}
    assert moved == {"0": links(5)[0][0], "1": None, "2": links(5)[0][0], "3": links(5)[0][0], "4": None}
    broken = docs.withColumns({"config": F.lit("{}"), "cursor": F.lit(None).cast("string")})
    assert {r.error[:8] for r in pages.read_pages(broken).collect()} == {"webpage:"}


def test_personal_video_data(spark):
    history = [{"id": "1", "bvid": "BV1", "title": " a ", "viewed_at": "2024-01-01T08:00:00"}, {"id": "2", "title": "b", "viewed_at": "late"}, {"id": "3"}]
    favorites = [{"id": "1", "bvid": "BV1", "title": "f", "duration_seconds": 11, "duration": "00:11", "upper": {"name": "Up"}}]
    detail = {"video": {"bvid": "BV1", "title": "v", "description": " d ", "cover": "http://i/x", "owner": {"name": "o"}, "stats": {"view": 100, "like": 3}}, "subtitle": {"text": "t"}}
    envelopes = [json.dumps({"ok": True, "data": x}) for x in (history, favorites, detail)] + [json.dumps({"ok": False, "error": {"code": "E1", "message": "no"}}), "garbage"]
    df = personal.unpack_envelope(raw(spark, envelopes))
    assert [r.error for r in df.orderBy("doc_id").collect()] == ["", "", "", "no（E1）", "invalid envelope"]
    h = personal.map_history(df.where("doc_id = '0'"), "Asia/Shanghai").orderBy("pos").collect()
    assert [(r.guid, r.inferred_time, r.extra) for r in h] == [("BV1", False, {}), ("2", True, {"viewed_at": "late"}), ("3", True, {})]
    assert h[0].url.endswith("/BV1") and str(h[0].published_at) == "2024-01-01 00:00:00"
    f = personal.map_favorites(df.where("doc_id = '1'")).first()
    assert (f.author, f.extra, f.inferred_time) == ("Up", {"duration_seconds": "11", "duration": "00:11"}, True)
    d = personal.parse_video_detail(df.where("doc_id = '2'"))
    assert (d.first().description, d.first().view, d.first().like, d.first().cover, d.first().subtitle) == ("d", 100, 3, "https://i/x", "t")
    new = personal.enrich_new(personal.map_history(df.where("doc_id = '0'")), d).orderBy("pos").collect()
    assert new[0].summary == "d" and new[0].extra == {"bili_view": "100", "bili_like": "3", "cover": "https://i/x"} and new[1].extra == {"viewed_at": "late"}


def test_kinds_of_sources(spark):
    selector, favorites = json.dumps({"selector": "dd"}), json.dumps({"mode": "favorites"})
    sources = [(1, "feed", "{}", True, False), (2, "webpage", selector, True, False), (3, "feed", "{}", False, False), (4, "feed", "{}", True, True), (5, "bilibili", "{}", True, False), (6, "bilibili", favorites, True, False), (7, "paper", "{}", True, False)]
    sources = spark.createDataFrame(sources, "id long, type string, config string, enabled boolean, deleted boolean")
    watched = json.dumps({"ok": True, "data": json.dumps([{"id": str(i), "bvid": f"V{i}", "upper": {"name": "u"}} for i in range(4)])})
    bodies = {1: rss(2), 2: shelf(3), 3: rss(2), 4: rss(2), 5: watched, 6: watched, 7: "x"}
    docs = spark.createDataFrame([(k, f"d{k}", "https://e.com", None, b, "", "") for k, b in bodies.items()], RAW_DOC)
    got = registry.parse_all(docs, sources).groupBy("source_id").agg(F.count("*").alias("n"), F.max("author").alias("by"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "w1"), (2, 3, ""), (5, 4, ""), (6, 4, "u")] and list(registry.registered()) == ["bilibili", "feed", "webpage"]
    registry.register_kind("paper", registry.registered()["feed"])
    try:
        assert registry.with_sources(docs, sources).where("source_id = 7").count() == 1
    finally:
        registry._kinds.pop("paper")


def test_details_are_read_once_and_entries_filled_in_place(spark):
    body = lambda bvid, said: json.dumps({"ok": True, "data": json.dumps({"video": {"bvid": bvid, "description": said, "stats": {"view": 3}}})})
    details = personal.parse_video_detail(personal.unpack_envelope(raw(spark, [body("a", "said"), body("b", ""), body("d", "said")])).where("error = ''"))
    plan = details.where("description <> ''").select("bvid", "description", "view")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2
    rows = [(1, 1, "a", "", None, False), (2, 1, "b", None, None, False), (3, 1, "d", "", {"k": "v"}, True), (4, 2, "d", "", {"k": "v"}, False), (5, 1, "a", "own", None, None), (6, 1, None, "", None, False)]
    entries = spark.createDataFrame(rows, "id long, source_id long, guid string, summary string, extra map<string,string>, deleted boolean").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    whole, counts = personal.backfill(entries, details, None, "2024-02-01")
    extra = {"bili_view": "3", "bili_like": "0"}
    assert sorted((r.id, r.summary, r.extra, r.updated_at.month) for r in whole.collect()) == [(1, "said", extra, 2), (2, None, None, 1), (3, "", {"k": "v"}, 1), (4, "said", {"k": "v"} | extra, 2), (5, "own", None, 1), (6, "", None, 1)]
    assert tuple(counts.first()) == (2, 3)
    assert tuple(personal.backfill(entries, details, 2, "2024-02-01")[1].first()) == (1, 1)
