"""Queries on inputs where they once failed or differed from their SQL."""

import random
from datetime import timedelta
from functools import partial

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import sliced
from millrace.operators import export, search, segments
from millrace.operators.tables import written
from millrace.plans import catalog
from millrace.streaming import streams

from .test_state_search_export import entries

SF = "/root/testdata/sf0.001"


def by_sql(name: str, **tables: str) -> list[tuple]:
    """The sorted rows of a query's SQL over Parquet tables, columns by name."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    rel = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    return sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall())


def by_query(spark, name: str, path: str) -> list[tuple]:
    df = catalog.QUERIES[name](spark, path)
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_articles_of_months_with_several_files(spark, monkeypatch):
    monkeypatch.setattr(export, "export_epub_chapters", partial(export.export_epub_chapters, chapter_bytes=2000))
    want = by_sql("epub_chapters", documents=f"{SF}/documents.parquet")
    assert by_query(spark, "epub_chapters", SF) == want


def test_titles_that_end_inside_a_reference(spark, tmp_path):
    html = [f"<html><title> a &lt;b&gt; &amp;lt; {end}</title></html>" for end in ("&amp", "x &amp;", "&lt", "&copy 1", "&", "&am")]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = by_sql("page_title_probe", pages=str(tmp_path / "pages.parquet" / "*.parquet"))
    assert by_query(spark, "page_title_probe", str(tmp_path)) == want


def test_a_phrase_that_many_queries_share_is_looked_up_once(spark, monkeypatch):
    """Words and phrases of up to five tokens against plain loops; 300 queries for one
    phrase meet the index as one."""
    rng = random.Random(5)
    words = ["oak", "elm", "ash"]
    texts = {i: rng.choices(words, k=rng.choice([1, 3, 12, 40])) for i in range(400)}
    index = spark.createDataFrame([(i, c, p, t) for i, tokens in texts.items() for c in ("title",) for p, t in enumerate(tokens)], "entry_id long, col string, pos int, token string")
    index = index.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(search.BUCKETS)).cast("int"))
    asked = ["oak-elm", "oak", "oak oak", "elm-elm elm-elm", "oak-elm-ash", "ash-ash-elm-oak", "oak-oak-oak-oak-oak elm", "elm-oak ash", "fir", "oak-fir", " "]
    holds = lambda tokens, p: any(tokens[k : k + len(p)] == p for k in range(len(tokens)))
    want = {(q, i) for q, text in enumerate(asked) if text.strip() for i, tokens in texts.items() if all(holds(tokens, p.split("-")) for p in text.split())}
    rows = search.search_batch(spark.createDataFrame(list(enumerate(asked)), "query_id long, q string"), index).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert not search.search_batch(spark.createDataFrame([(1, " ")], "query_id long, q string"), index).collect()
    looked_up = {}
    monkeypatch.setattr(search, "written", lambda df, tag: looked_up.setdefault(tag, written(df, tag)))
    queries = spark.createDataFrame([(k, "oak-elm-ash") for k in range(300)], "query_id long, q string")
    assert search.search_batch(queries, index).count() == 300 * sum(holds(tokens, ["oak", "elm", "ash"]) for tokens in texts.values())
    assert looked_up["asked"].count() == 1


def test_queries_with_the_same_tokens_share_their_candidates(spark, tmp_path, monkeypatch):
    index = segments.open_index(spark, str(tmp_path / "index"), buckets=3)
    segments.add_segment(index, entries(spark, [{"id": i, "title": "oak" if i % 2 else "elm", "content": "ash oak"} for i in range(200)]))
    segments.add_segment(index, entries(spark, [{"id": i, "title": "elm", "deleted": i % 4 == 0} for i in range(0, 200, 10)]))
    kept = {}
    monkeypatch.setattr(segments, "written", lambda df, tag: kept.setdefault(tag, written(df, tag)))
    terms = spark.createDataFrame([(k, "oak elm" if k % 2 else "elm oak elm") for k in range(50)] + [(50, "elm"), (51, "ash-oak elm")], "query_id long, q string")
    rows = [tuple(r) for r in segments.search_segments(terms, index).collect()]
    both = {i for i in range(200) if i % 2 == 0 and i % 10}
    elm = both | {i for i in range(0, 200, 10) if i % 4}
    assert len(rows) == len(set(rows)) and set(rows) == {(k, i) for k in range(50) for i in both} | {(50, i) for i in elm} | {(51, i) for i in both}
    assert kept["sets"].count() == 3


def test_python_functions_hold_a_slice_of_a_batch():
    texts, more = pa.array(["a" * 10, None, "b" * 25, "", "cc", "dd"]), pa.array(["", "x", "y", None, "z", "zz"])
    assert list(sliced.slices((texts, more), 12)) == [(0, 2), (2, 3), (3, 6)]
    seen = []

    def read(text, other):
        seen.append(text)
        return f"{text}/{other}"

    got = sliced.sliced_udf(read, T.StringType(), 12).func(iter([(texts, more), (texts[:0], more[:0])]))
    assert next(got).to_pylist() == ["aaaaaaaaaa/", "None/x"] and len(seen) == 2  # the rest is not yet read
    assert [v for part in got for v in part.to_pylist()] == [f"{a}/{b}" for a, b in zip(texts[2:].to_pylist(), more[2:].to_pylist())]


def with_empty_texts(spark, folder) -> str:
    """A copy of the documents, sources and parts in which texts of even and odd,
    deleted and other entries are empty, blank or null."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    k = F.col("doc_id") % 23
    text = F.when(k.isin(0, 1, 7), F.lit("")).when(k == 2, F.lit(" \n")).when(k == 3, F.lit(None)).otherwise(F.col("text"))
    documents.withColumn("text", text).write.parquet(f"{folder}/documents.parquet")
    for t in ("supplier", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def on_empty_texts(spark, folder, name: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of a query, and of its SQL, over :func:`with_empty_texts`."""
    path = with_empty_texts(spark, folder)
    return by_query(spark, name, path), by_sql(name, **{t: f"{path}/{t}.parquet/*.parquet" for t in ("documents", "supplier", "part")})


def test_first_of_empty_texts_wins(spark, tmp_path):
    got, want = on_empty_texts(spark, tmp_path, "first_wins_latest")
    assert got == want


def test_only_even_entries_lack_a_summary(spark, tmp_path):
    got, want = on_empty_texts(spark, tmp_path, "backfill_counts")
    assert got == want


def test_json_without_content_is_read_back_as_empty(spark, tmp_path):
    got, want = on_empty_texts(spark, tmp_path, "exported_json")
    assert got == want


def test_json_with_a_very_long_text_is_read_back(spark, tmp_path):
    """Beyond 20,000,000 characters JSON readers give up unless told otherwise."""
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS doc_id, repeat('abc ', 5100000) AS text, 'en' AS lang, 'src1' AS source, 20400000::BIGINT AS n_chars) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    got = by_query(spark, "exported_json", str(tmp_path))
    assert got == by_sql("exported_json", documents=f"{tmp_path}/documents.parquet", supplier=f"{tmp_path}/supplier.parquet/*.parquet")


def test_an_empty_text_is_ingested_once(spark, tmp_path):
    got, want = on_empty_texts(spark, tmp_path, "ingested_entries")
    assert got == want


def test_identity_of_empty_texts_with_a_blank_title(spark, tmp_path):
    got, want = on_empty_texts(spark, tmp_path, "text_keys")
    assert got == want


class Held:
    """A value state that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_an_entry_asks_for_its_flags_once_and_writes_them_once():
    held, fold = Held(), streams.FlagState(timedelta(days=1))
    fold.init(held)
    old = {"old_read": True, "old_favorite": False, "old_archive": False, "old_read_later": True, "old_at": 7}
    at = lambda k: pd.Timestamp(k, unit="us")
    event = lambda ts, flag, value, seq=1: pd.DataFrame([{"ts": at(ts), "seq": seq, "flag": flag, "value": value, **old}])
    assert list(fold.handleInputRows((5,), iter([event(10, "read", True)]), None)) == [] and held.calls == 2
    (row,) = fold.handleInputRows((5,), iter([event(20, "read", False), event(30, "favorite", True)]), None)
    assert held.calls == 4
    assert row.iloc[0].to_dict() == {"entry_id": 5, "read": False, "favorite": True, "archive": False, "read_later": True, "updated_at": at(30)}
