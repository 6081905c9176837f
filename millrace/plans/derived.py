"""The library's tables, derived from the test tables by Spark, and the same in
SQL: each function here has a common table expression of its name in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import content_hash
from millrace.operators.ingest import with_keys

NOW = "2024-06-01 00:00:00"
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '{_WHITE}+', ' ', 'g'), ' '))"


def hash_sql(title: str, content: str) -> str:
    return f"substr(sha256({norm_sql(title)} || chr(0) || {norm_sql(content)}), 1, 32)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items: one a document, by its source; titles are the first 60 characters."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(
        (F.substring("source", 4, 10).cast("long") + 1).alias("source_id"), F.col("doc_id").cast("int").alias("pos"), F.concat(F.lit("doc-"), "doc_id").alias("guid"),
        F.concat(F.lit("HTTPS://Example.com/Post/"), "doc_id", F.lit("/#top")).alias("url"), F.left("text", F.lit(60)).alias("title"), F.lit("").alias("author"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("published_at"), F.lit(False).alias("inferred_time"), F.left("text", F.lit(200)).alias("summary"),
        F.col("text").alias("content"), F.lit("text/plain").alias("content_type"), F.array("lang").alias("tags"), F.create_map(F.lit("chars"), F.col("n_chars").cast("string")).alias("extra"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries: one a document, each tenth deleted."""
    keyed = with_keys(items(spark, sf_dir))
    return keyed.select(
        F.col("pos").cast("long").alias("id"), "source_id", "guid", "url", content_hash("title", "content").alias("content_hash"), "title", "author", "published_at", "summary", "content", "content_type",
        "tags", "extra", "fetched_at", F.col("fetched_at").alias("created_at"), F.col("fetched_at").alias("updated_at"), (F.col("pos") % 10 == 9).alias("deleted"),
    )


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_events(table(spark, sf_dir, "events"))


def flag_events(e: DataFrame) -> DataFrame:
    flag = F.element_at(F.create_map(*(F.lit(x) for p in (("view", "read"), ("click", "favorite"), ("purchase", "archive"), ("signup", "read_later")) for x in p)), F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("entry_id"), flag.alias("flag"), (F.col("event_id") % 3 != 0).alias("value")).where("flag IS NOT NULL")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of entries, of every third one none."""
    e = entries(spark, sf_dir).where("id % 3 <> 0")
    return e.select(
        F.col("id").alias("entry_id"), (F.col("id") % 2 == 0).alias("read"), (F.col("id") % 5 == 0).alias("favorite"), (F.col("id") % 7 == 0).alias("archive"), (F.col("id") % 4 == 1).alias("read_later"),
        F.timestamp_seconds(F.lit(1706745600) + (F.col("id") * 7919 % 1000) * 60).alias("updated_at"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20 + 1).alias("source_id"), F.date_trunc("second", "ts").alias("started_at"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"),
        F.when(ok, (F.col("event_id") % 4).cast("int")).otherwise(F.lit(0)).alias("inserted"), (F.col("event_id") % 3).cast("int").alias("skipped"), ok.alias("success"),
        F.when(ok, F.lit("")).otherwise(F.concat(F.lit("failed at "), "event_id")).alias("error"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources from suppliers; every eleventh is deleted, every fifth disabled."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("long")
    return s.select(
        k.alias("id"), F.concat("s_name", F.when(k % 4 == 0, F.lit("/x:")).otherwise(F.lit(""))).alias("name"), F.lit("feed").alias("type"), F.lit("{}").alias("config"), (k % 7 * 600).cast("int").alias("interval"),
        (k % 5 != 0).alias("enabled"), (k % 9).cast("int").alias("fail_count"), F.lit("").alias("last_error"), F.lit(NOW).cast("timestamp").alias("created_at"), F.lit(NOW).cast("timestamp").alias("updated_at"),
        (k % 11 == 0).alias("deleted"),
    )


SQL = {
    "items": f"""items AS (SELECT substr(source, 4)::BIGINT + 1 AS source_id, doc_id::INT AS pos, 'doc-' || doc_id AS guid, 'https://example.com/Post/' || doc_id AS url, left(text, 60) AS title, '' AS author,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, left(text, 200) AS summary, text AS content, 'text/plain' AS content_type, lang, n_chars, TIMESTAMP '{NOW}' AS fetched_at FROM documents WHERE text IS NOT NULL)""",
    "entries": f"""entries AS (SELECT *, pos::BIGINT AS id, {hash_sql("title", "content")} AS content_hash, pos % 10 = 9 AS deleted FROM items)""",
    "state": """state AS (SELECT id AS entry_id, id % 2 = 0 AS read, id % 5 = 0 AS favorite, id % 7 = 0 AS archive, id % 4 = 1 AS read_later, TIMESTAMP '2024-02-01' + to_minutes(id * 7919 % 1000) AS updated_at FROM entries WHERE id % 3 <> 0)""",
    "state_events": """state_events AS (SELECT event_id AS seq, ts, user_id AS entry_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'favorite' WHEN 'purchase' THEN 'archive' WHEN 'signup' THEN 'read_later' END AS flag, event_id % 3 <> 0 AS value
        FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup'))""",
    "fetch_log": """fetch_log AS (SELECT event_id AS id, user_id % 20 + 1 AS source_id, date_trunc('second', ts) AS started_at, floor(value * 100)::BIGINT AS elapsed_ms, event_type <> 'error' AS success,
        CASE WHEN event_type <> 'error' THEN (event_id % 4)::INT ELSE 0 END AS inserted, (event_id % 3)::INT AS skipped, CASE WHEN event_type <> 'error' THEN '' ELSE 'failed at ' || event_id END AS error FROM events)""",
    "sources": """sources AS (SELECT s_suppkey::BIGINT AS id, s_name || CASE WHEN s_suppkey % 4 = 0 THEN '/x:' ELSE '' END AS name, (s_suppkey % 7 * 600)::INT AS "interval", s_suppkey % 5 <> 0 AS enabled, (s_suppkey % 9)::INT AS fail_count, s_suppkey % 11 = 0 AS deleted FROM supplier)""",
}
_NEEDS = {"entries": ["items"], "state": ["items", "entries"]}


def with_sql(names: str, body: str) -> str:
    """A statement over derived tables (names between spaces)."""
    order: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + body
