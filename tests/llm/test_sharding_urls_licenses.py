import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import license_scan, sharding, url_filter
from millrace.llm.common import new_path

SF = "/root/testdata/sf0.01"


def test_shards_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by_shard.setdefault(r.shard, []).append(r)
    assert sorted(by_shard) == list(range(16))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in own) for own in by_shard.values()]
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 16


def test_shards_of_odd_rows(spark):
    schema = "doc_id long, text string, shard string, slot string"
    rows = [(None, "a", "s", "t"), (None, None, "s", None), (1, "x", "s", "t"), (1, "x", "s", "t"), (2, "é" * 40_000, None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, schema), shards=3).collect()
    assert sorted(r.size for r in got) == [1, 2, 2, 2, 80_001] and len({(r.shard, r.slot) for r in got}) == 5
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0


def test_a_new_shard_only_takes(spark):
    sizes = {s: (s * 7919 % 100) + 1 for s in range(4096)}
    old = sharding.balanced_map(sizes, 16)
    new = sharding.grown_map(old, sizes)
    assert all(new[s] in (old[s], 16) for s in old)
    load = [sum(sizes[s] for s in new if new[s] == h) for h in range(17)]
    assert max(load) < 1.1 * sum(load) / 17
    path = new_path(spark, "map")
    sharding.write_map(spark, path, 1, old)
    sharding.write_map(spark, path, 2, new)
    assert {r.virtual_slot: r.shard for r in sharding.read_map(spark, path).collect()} == new
    assert {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 1).collect()} == old


def test_a_stored_map_is_kept_and_edited(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = new_path(spark, "map")
    first = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(docs, map_path=path).collect()}
    assert {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(docs, map_path=path).collect()} == first
    assert sharding.add_shard(docs, path) == 2
    grown = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_documents(docs, map_path=path).collect()}
    moved = [i for i in grown if grown[i][0] != first[i][0]]
    assert moved and {v for _, v in grown.values()} <= {2, 3} and len(moved) < 0.2 * len(grown)
    # other rows: only what has to moves, and a version is added
    drifted = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.repeat("text", F.lit(3))).otherwise(F.col("text")))
    rows = sharding.shard_documents(drifted, map_path=path).collect()
    loads = [sum(r.size for r in rows if r.shard == h) for h in range(17)]
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 17 and {r.map_version for r in rows} == {max(v for _, v in grown.values()) + 1}
    with pytest.raises(ValueError):
        sharding.add_shard(docs, new_path(spark, "none"))


def test_evened_maps_move_little():
    old = {s: s % 4 for s in range(40)}
    assert sharding.evened_map(old, dict.fromkeys(old, 5)) == old
    sizes = {s: 30 if s % 4 == 0 else 10 for s in old}
    new = sharding.evened_map(old, sizes)
    load = [sum(sizes[s] for s in new if new[s] == h) for h in range(4)]
    assert max(load) - min(load) <= 30 and sum(new[s] != old[s] for s in old) <= 8  # five at least
    assert sharding.evened_map(old, {0: 100}) == {**old, 0: old[0]}  # one slot can't be split


URLS = [
    ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/"),
    ("ftp://org", "org", "", None),
    ("https://a.com/de/?x", "a.com", "/de/", "com/de/"),
    ("https://a.com/fr/x://y", "a.com", "/fr/x://y", "com/fr/"),
    ("//a.com/fr/", "", "", None),
    (None, "", "", None),
    ("x://u@H:80?q", "u@h:80", "", None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == ({r: v for v, r in url_filter.RULES}.get(rule, "allow"))
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_reputation_is_shrunk(spark):
    pages = [(i, f"http://{h}/{i}") for i, h in enumerate(["bad.spam.net"] * 60 + ["new.spam.net"] * 5 + ["one.good.net"] * 200 + ["x.other.net"])]
    labels = [(i, 0 if i < 60 else 1, 0) for i in range(60)] + [(i, 1, 0) for i in range(65, 265)] + [(265, 0, None), (265, None, 1), (None, 0, 1)]
    args = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rep = {r.host: r for r in url_filter.host_reputation(*args).collect()}
    assert (rep["bad.spam.net"].n, rep["bad.spam.net"].bad, rep["x.other.net"].bad) == (60, 60, 1)
    assert rep["bad.spam.net"].mean > 0.9 and rep["one.good.net"].mean < 0.1 < rep["new.spam.net"].mean
    verdicts = {r.host: r.verdict for r in url_filter.judge_urls(*args, rules=[("allow", "zz/")]).collect()}
    assert verdicts["bad.spam.net"] == "block" and verdicts["one.good.net"] == verdicts["x.other.net"] == "allow"


def test_registered_domains(spark):
    hosts = {
        "a.b.shop.co.uk": ("shop.co.uk", "co.uk"), "taco.uk": ("taco.uk", "uk"), "co.uk": ("co.uk", "co.uk"), "x.example.com": ("example.com", "com"), "u@www.site.org:8080": ("site.org", "org"),
        "10.0.0.7:80": ("10.0.0.7", "10.0.0.7"), "[::1]:80": ("[::1]", "[::1]"), "site.net.": ("site.net", "net"), "localhost": ("localhost", "localhost"), "": ("", ""), "m.gov.example": ("gov.example", "example"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.host_name(F.col("host")).alias("n"))
    got = {r.host: (r.d, r.s) for r in df.select("host", url_filter.domain_of(F.col("n")).alias("d"), url_filter.suffix_of(F.col("n")).alias("s")).collect()}
    assert got == hosts


def test_posterior_of_whole_counts_is_a_binomial_tail(spark):
    cases = [(a, b, t) for a in (1, 3, 40) for b in (1, 7, 200) for t in (0.05, 0.5, 0.9)]
    for t in (0.05, 0.5, 0.9):
        own = [(float(a), float(b)) for a, b, x in cases if x == t]
        df = spark.createDataFrame(own, "a double, b double").select("a", "b", url_filter.share_below(F.col("a"), F.col("b"), t).alias("p"))
        for r in df.collect():
            a, n = int(r.a), int(r.a + r.b) - 1
            want = sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(a, n + 1))
            assert abs(r.p - want) < 1e-3
    tiny = spark.createDataFrame([(1e-3, 5.0), (1e6, 9e6)], "a double, b double").select(url_filter.share_below(F.col("a"), F.col("b"), 0.5).alias("p")).collect()
    assert all(r.p > 0.999 for r in tiny)


def test_few_pages_decide_by_the_quantile(spark):
    """Repeats count once; the verdict is that of the posterior in plain floats."""
    pages = [(i, f"http://h{i % 8}.d{i % 4}.net/{i}") for i in range(160)]
    labels = [(i, 0 if (i % 8) * 20 > i * 7 % 160 else 1, 0) for i in range(160)]
    make = lambda p: (spark.createDataFrame(p, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    once = {r.host: r for r in url_filter.host_reputation(*make(pages)).collect()}
    assert {r.host: r for r in url_filter.host_reputation(*make(pages * 3)).collect()} == once
    assert {r.blocked for r in once.values()} == {True, False} and all(r.mean > 0.5 for r in once.values() if r.blocked)


def test_sql_agrees_where_the_method_blocks(spark):
    import duckdb

    pages = [(i, f"http://h{i % 9}.d{i % 3}.co.uk:80/{i}") for i in range(400)] + [(None, None), (1, "http://h1.d1.co.uk:80/1")]
    labels = [(i, 0 if (i % 9) * 50 > i * 7 % 400 else 1, 0) for i in range(0, 400, 2)] + [(4, None, 1)]
    p, d = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("pages", p.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", d.toPandas().astype("Int64"))
    want = sorted(map(str, con.execute(f"SELECT page_id, host, verdict FROM ({url_filter.ORACLE_SQL})").fetchall()))
    got = sorted(str(tuple(r)) for r in url_filter.judge_urls(p, d).select("page_id", "host", "verdict").collect())
    assert got == want and {x.split("'")[-2] for x in got} == {"allow", "block"}


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split())
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_license_places_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 0
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_texts(spark):
    texts = {
        1: None, 2: "", 3: "MIT License, mit-license! MIT LICENSE", 4: "apache\x7flicense general public licenses é", 5: "x " * 50_000 + "General  Public\nLicense",
        6: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\ncode", 7: "spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", 8: "SPDX-License-Identifier: (MIT", 9: "licensed under CC BY-NC 4.0",
    }
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in texts.items()], "doc_id long, text string, labels string, score string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in texts.items():
        assert tuple(got[i])[1:6] == brute(t)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].score) == (3, 0, 4, 1.0)
    assert got[6].labels == "bsd,gpl,mit" and got[6].score == 1.0 and got[7].labels == "gpl" and got[8].labels == "" and got[9].labels == "cc-by,cc-by-nc"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


MIT_OPENING = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
NOTICE_CASES = {
    MIT_OPENING: ("mit", 1.0),
    "Redistribution and use in source and binary forms, with or without": ("bsd", 1.0),
    "Permission to use, copy, modify, and/or distribute this software for any purpose with": ("isc", 1.0),
    "Creative Commons Attribution-ShareAlike 4.0": ("cc-by,cc-by-sa", 0.6),
    "SPDX-License-Identifier: 0BSD": ("0bsd", 1.0),
    "# spdx license identifier : Zlib or Unlicense": ("unlicense,zlib", 1.0),
    "SPDX-License-Identifier: MIT AND LicenseRef-house": ("licenseref-house,mit", 0.5),
    "x\nSPDX-License-Identifier:\nMIT": ("", 0.0),
    "é SPDX-License-Identifier: GPL-3.0-only\r\nSPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception)": ("apache,gpl", 0.3),
    "SPDX-License-Identifier MIT": ("", 0.0),
    "All rights reserved. mit license": ("mit,proprietary", 0.0),
}


def test_notices_openings_and_tags(spark):
    rows = [(i, t) for i, t in enumerate(NOTICE_CASES)] * 2 + [(99, "p " * 200_000 + MIT_OPENING)]
    got = [(r.doc_id, (r.labels, r.score)) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(i, w) for i, w in enumerate(NOTICE_CASES.values())]
    assert sorted(got) == sorted(want * 2 + [(99, ("mit", 1.0))])
    import duckdb

    con = duckdb.connect()
    plain = sorted({(i, t) for i, t in rows if "dentifier" not in t})
    con.register("documents", spark.createDataFrame(plain, "doc_id long, text string").toPandas())
    said = {(i, (labels, score)) for i, labels, score in con.execute(f"SELECT doc_id, labels, score FROM ({license_scan.ORACLE_SQL})").fetchall()}
    assert said == {(i, w) for i, w in got if i in {p[0] for p in plain}}


@pytest.mark.parametrize(
    ("expression", "order"),
    [("mit or gpl and bsd", "mit gpl bsd and or"), ("(mit or gpl) and bsd", "mit gpl or bsd and"), ("gpl with x and mit", "gpl x with mit and"), ("mit */", "mit"), ("mit and", None), ("(mit", None), ("mit)", None), ("", None), ("or mit", None)],
)
def test_postfix(expression, order):
    assert license_scan.postfix(expression) == (order.split() if order else None)


def test_documents_agree_with_columns_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = url_filter.judge_urls(pages, spark.read.parquet(f"{SF}/labels.parquet"))
    assert got.count() == pages.count() and got.where(F.col("verdict").isin("allow", "block")).count() == pages.count()
