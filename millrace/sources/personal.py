"""Personal video data: JSON envelopes, watch history, favourites, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text, trim_white
from millrace.functions.times import parse_viewed_at

_ENVELOPE = "ok boolean, schema_version string, data string, error struct<code: string, message: string>"
_HISTORY = "array<struct<id: string, bvid: string, title: string, author: string, viewed_at: string>>"
_FAVORITES = "array<struct<id: string, bvid: string, title: string, duration_seconds: bigint, duration: string, upper: struct<name: string>>>"
_DETAIL = (
    "video struct<bvid: string, title: string, description: string, cover: string, owner: struct<name: string>, "
    "stats: struct<view: bigint, danmaku: bigint, like: bigint, coin: bigint, favorite: bigint, share: bigint>>, subtitle struct<text: string>"
)

#: Where a video stands, and history rows taken from a document.
VIDEO_URL, HISTORY_LIMIT = "https://www.bilibili.com/video/", 100


def unpack_envelope(df: DataFrame) -> DataFrame:
    """df (with ``body``) and data, error: the payload if ok, else ''; the error as
    message (code), or that the body is no envelope.

    The explode of one element keeps later filters and projections from reading the
    bodies again for each of their columns."""
    df = df.select("*", F.explode(F.array(F.from_json("body", _ENVELOPE))).alias("_e"))
    e = F.col("_e")
    broken = e.isNull() | e["ok"].isNull()
    said = F.concat(text(e["error"]["message"]), F.lit("（"), text(e["error"]["code"]), F.lit("）"))
    return df.withColumns(
        {
            "data": F.when(~broken & e["ok"], text(e["data"])).otherwise(F.lit("")),
            "error": F.when(broken, F.lit("invalid envelope")).when(e["ok"], F.lit("")).otherwise(said),
        }
    ).drop("_e")


def _item(df: DataFrame, guid: Column, author: Column, published: Column, extra: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        "source_id", "doc_id", *keep, "pos", guid.alias("guid"), F.when(guid == "", F.lit("")).otherwise(F.concat(F.lit(VIDEO_URL), guid)).alias("url"),
        trim_white("i.title").alias("title"), author.alias("author"), published.alias("published_at"), published.isNull().alias("inferred_time"),
        F.lit("").alias("summary"), F.lit("").alias("content"), F.lit("text/plain").alias("content_type"), F.array().cast("array<string>").alias("tags"),
        extra.alias("extra"), "fetched_at",
    )


def _guid() -> Column:
    return F.coalesce(F.nullif(trim_white("i.bvid"), F.lit("")), trim_white("i.id"))


def _entries(*pairs: tuple[str, Column, Column]) -> Column:
    """A map of the (key, value, wanted) that are wanted."""
    every = F.array(*(F.when(wanted, F.struct(F.lit(key), value.cast("string"))) for key, value, wanted in pairs))
    return F.map_from_entries(F.filter(every, lambda x: x.isNotNull())).cast("map<string,string>")


def map_history(df: DataFrame, tz: str = "UTC", keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of the watch histories in ``data``, 100 of a document at most."""
    rows = F.slice(F.from_json("data", _HISTORY), F.lit(1), F.lit(HISTORY_LIMIT))
    each = df.select("source_id", "doc_id", *keep, "fetched_at", F.posexplode(rows).alias("pos", "i"))
    viewed = parse_viewed_at("i.viewed_at", tz)
    raw = trim_white("i.viewed_at")
    return _item(each, _guid(), trim_white("i.author"), viewed, _entries(("viewed_at", raw, viewed.isNull() & (raw != ""))), keep)


def map_favorites(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of the favourites in ``data``."""
    each = df.select("source_id", "doc_id", *keep, "fetched_at", F.posexplode(F.from_json("data", _FAVORITES)).alias("pos", "i"))
    seconds, shown = F.coalesce("i.duration_seconds", F.lit(0)), text("i.duration")
    extra = _entries(("duration_seconds", seconds, seconds > 0), ("duration", shown, shown != ""))
    return _item(each, _guid(), trim_white("i.upper.name"), F.lit(None).cast("timestamp"), extra, keep)


def items_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of envelopes by the mode in their source's config: favorites, else the
    watch history."""
    favorites = F.coalesce(F.get_json_object("config", "$.mode"), F.lit("")) == "favorites"
    return map_history(docs.where(~favorites), keep=keep).unionByName(map_favorites(docs.where(favorites), keep))


def https_cover(c: Column | str) -> Column:
    return F.regexp_replace(text(c), "^http://", "https://")


def parse_video_detail(df: DataFrame) -> DataFrame:
    """df and bvid, title, description, owner, cover, view, danmaku, like, coin,
    favorite, share, subtitle of the video in ``data``, which is read once (see
    :func:`unpack_envelope`)."""
    d = df.select("*", F.explode(F.array(F.from_json("data", _DETAIL))).alias("_d"))
    counts = {n: F.coalesce(f"_d.video.stats.{n}", F.lit(0)) for n in ("view", "danmaku", "like", "coin", "favorite", "share")}
    out = {
        "bvid": trim_white("_d.video.bvid"), "title": trim_white("_d.video.title"), "description": trim_white("_d.video.description"),
        "owner": trim_white("_d.video.owner.name"), "cover": https_cover("_d.video.cover"), "subtitle": trim_white("_d.subtitle.text"),
    }
    return d.withColumns(out | counts).drop("_d")


def enrich_new(accepted: DataFrame, details: DataFrame) -> DataFrame:
    """Items with what is known of their guid (details: bvid, description, view,
    like, cover): the description becomes the summary unless empty, counts and
    cover go into extra."""
    joined = _with_details(accepted, details)
    return joined.withColumns(_filled(F.coalesce("extra", F.create_map().cast("map<string,string>")))).select(accepted.columns)


def _with_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """items and ``_d``, what is known of their guid, else null."""
    d = details.select(F.col("bvid").alias("guid"), F.struct("description", "view", "like", "cover").alias("_d"))
    return items.join(d.groupBy("guid").agg(F.max("_d").alias("_d")), "guid", "left")


def _filled(unknown: Column) -> dict[str, Column]:
    """summary and extra after ``_d``; ``unknown`` is extra where that is null."""
    new = _entries(("bili_view", F.col("_d.view"), F.lit(True)), ("bili_like", F.col("_d.like"), F.lit(True)), ("cover", F.col("_d.cover"), text("_d.cover") != ""))
    known = F.col("_d").isNotNull()
    old = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return {"summary": F.when(known & (text("_d.description") != ""), F.col("_d.description")).otherwise(F.col("summary")), "extra": F.when(known, merged).otherwise(unknown)}


def _without_summary(source_id: int | None) -> Column:
    """Whether an entry is undeleted and has a guid and no summary, in the source."""
    found = (~F.col("deleted")) & (text("guid") != "") & (text("summary") == "")
    return F.coalesce(found if not source_id else found & (F.col("source_id") == source_id), F.lit(False))


def backfill_candidates(entries: DataFrame, source_id: int | None = None) -> DataFrame:
    """Undeleted entries with a guid and no summary, newest first."""
    return entries.where(_without_summary(source_id)).orderBy(F.col("id").desc())


def backfill(entries: DataFrame, details: DataFrame, source_id: int | None, now) -> tuple[DataFrame, DataFrame]:
    """(entries, counts): candidates whose details have a description get it as
    summary, with extra and updated_at; counts are backfilled and total.  Details are
    joined once, with the candidates only."""
    asked = _with_details(entries.where(_without_summary(source_id)), details.where(text("description") != ""))
    stamped = F.when(F.col("_d").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    new = asked.withColumns(_filled(F.col("extra")) | {"updated_at": stamped}).select(entries.columns)
    counts = asked.agg(F.count("_d").alias("backfilled"), F.count("*").alias("total"))
    return entries.where(~_without_summary(source_id)).unionByName(new), counts
