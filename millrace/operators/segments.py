"""A search index of immutable segments, and search by the rarest token.

A segment holds the postings of the entries of one change, in blocks: those of a token
in ``2 ** CHUNK_BITS`` entry ids, as offsets in them (Parquet's delta encoding packs
these and the positions).  Blocks lie in buckets by token, sorted by token and chunk.
A frequent token is no single group, neither when it is built nor when it is read, and
an entry finds its block of a token by one equality.  Entries that a change holds,
deleted ones too, are dead in all segments before it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import search_terms

from .search import BUCKETS, COLUMNS, column_tokens
from .store import Change, Part, Store, Table
from .tables import written

CHUNK_BITS = 7
#: Segments beyond which the newest ones are merged.
MOST_SEGMENTS = 8
#: Chunks that a reader names to the scan; where candidates fall into more, blocks are
#: joined without that filter, with the same result.
LISTED_CHUNKS = 1000
_PLACES = "array<struct<id: int, col: int, pos: array<int>>>"
TABLES = {
    "blocks": Table(f"seg long, token string, chunk long, n int, places {_PLACES}", ("token",), BUCKETS, ("token", "chunk")),
    "dead": Table("entry_id long, seg long"),
    "segments": Table("seg long, postings long, path string"),
}


class Segment(NamedTuple):
    seg: int
    postings: int
    path: str


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    """The index under a folder, always opened with the same buckets; empty if there
    is none yet."""
    return Store(spark, path, TABLES | {"blocks": TABLES["blocks"]._replace(buckets=buckets)})


def _chunk(entry_id: str) -> Column:
    return F.shiftright(F.col(entry_id), CHUNK_BITS)


def _entry(offset: Column) -> Column:
    return F.shiftleft("chunk", CHUNK_BITS) + offset


def _blocks(postings: DataFrame, seg: int) -> DataFrame:
    """Blocks of postings (token, chunk, entry_id, col, pos), gathered by token and chunk."""
    place = F.struct((F.col("entry_id") - _entry(F.lit(0))).cast("int").alias("id"), "col", "pos")
    lists = postings.groupBy("token", "chunk").agg(F.sort_array(F.collect_list(place)).alias("places"))
    return lists.select(F.lit(seg).cast("long").alias("seg"), "token", "chunk", F.size("places").alias("n"), "places")


def segment_blocks(entries: DataFrame, seg: int) -> DataFrame:
    """Blocks of the undeleted entries: one shuffle of their tokens."""
    live = entries.where(~F.col("deleted"))
    columns = F.array(*(F.struct(F.lit(k).alias("col"), column_tokens(c).alias("tokens")) for k, c in enumerate(COLUMNS)))
    lists = live.select(F.col("id").alias("entry_id"), F.explode(columns).alias("x"))
    each = lists.select("entry_id", "x.col", F.posexplode("x.tokens").alias("pos", "token")).withColumn("chunk", _chunk("entry_id"))
    by_token = each.repartition("token", "chunk")
    return _blocks(by_token.groupBy("token", "chunk", "entry_id", "col").agg(F.sort_array(F.collect_list("pos")).alias("pos")), seg)


def _segments(rows: DataFrame) -> list[Segment]:
    return [Segment(*r) for r in rows.orderBy("seg").select("seg", "postings", "path").collect()]  # at most MOST_SEGMENTS + 1


def _folder(parts: list[Part]) -> str:
    return parts[0].path.rsplit("/", 1)[0] if parts else ""


def _listed(store: Store, change: Change, listed: list[Segment]) -> None:
    old = [p for p in change.parts if p.name == "segments"]
    rows = store.spark.createDataFrame(listed, TABLES["segments"].schema).coalesce(1)
    if old:
        change.replace(old, rows)
    else:
        change.append("segments", rows)


def add_segment(store: Store, changed: DataFrame, stream: str | None = None, batch: int = 0) -> int:
    """Takes changed entries (ENTRY; one row an id) into the index, new, edited and
    deleted ones: a segment of the size of the change and one new version, which is
    given back.  Once there are more than ``MOST_SEGMENTS`` the newest are merged in
    the same version.  With a stream's name a batch that is committed is left out."""
    if stream and store.holds(stream, batch):
        return store.version
    listed, seg = _segments(store.read("segments")), store.version + 1
    change, before = store.change(), set(store.parts)
    rows = change.append("blocks", segment_blocks(changed, seg))
    path = _folder([p for p in change.parts if p not in before])
    postings = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if path else 0
    if listed:
        change.append("dead", changed.select(F.col("id").alias("entry_id"), F.lit(seg).alias("seg")).distinct())
    if path:
        listed.append(Segment(seg, postings, path))
    listed = _merged(store, change, listed)
    if listed:
        _listed(store, change, listed)
    return change.commit(stream, batch)


def _merged(store: Store, change: Change, listed: list[Segment]) -> list[Segment]:
    """Merges the newest segments, up to the first that is over twice as large as
    those after it together: a posting is rewritten a logarithmic number of times."""
    if len(listed) <= MOST_SEGMENTS:
        return listed
    at = len(listed) - 2
    while at > 0 and listed[at - 1].postings <= 2 * sum(s.postings for s in listed[at:]):
        at -= 1
    folders = {s.path for s in listed[at:]}
    parts = [p for p in change.parts if p.name == "blocks" and _folder([p]) in folders]
    seg = listed[-1].seg
    each = store._rows("blocks", parts).select("seg", "token", "chunk", F.explode("places").alias("p"))
    each = each.select("seg", "token", "chunk", _entry(F.col("p.id")).alias("entry_id"), "p.col", "p.pos")
    dead = store._rows("dead", [p for p in change.parts if p.name == "dead"])
    new = change.replace(parts, _blocks(_alive(each, dead).drop("seg"), seg))
    postings = store._rows("blocks", new).agg(F.sum("n")).first()[0] if new else 0
    if at == 0:  # what is dead is gone from all segments
        change.parts = [p for p in change.parts if p.name != "dead"]
    else:
        change.compact("dead", MOST_SEGMENTS, lambda rows: rows.groupBy("entry_id").agg(F.max("seg").alias("seg")))
    return listed[:at] + ([Segment(seg, postings, _folder(new))] if new else [])


def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """rows (entry_id, seg) of entries that no later change holds."""
    last = dead.groupBy("entry_id").agg(F.max("seg").alias("_dead"))
    return rows.join(last, "entry_id", "left").where("_dead IS NULL OR _dead <= seg").drop("_dead")


def _phrase_tokens(queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.array_distinct(search_terms("q")).alias("terms")).where(F.size("terms") > 0)
    phrases = terms.select("query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("term", "tokens"))
    return phrases.select("query_id", "n_terms", "term", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("nth", "token"))


def _bits(blocks: DataFrame) -> DataFrame:
    """token, seg, chunk and which entries of the chunk hold the token: a bit each, the
    first 64 in lo, the others in hi."""
    ids = F.col("places.id")
    mask = lambda half: F.aggregate(F.filter(ids, lambda i: (i < 64) == half), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseOR(_bit(i)))
    return blocks.select("token", "seg", "chunk", mask(F.lit(True)).alias("lo"), mask(F.lit(False)).alias("hi"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))  # of a long: modulo 64


def _alive_bits(bits: DataFrame, dead: DataFrame) -> DataFrame:
    """bits without entries that a later change holds."""
    last = dead.groupBy("entry_id").agg(F.max("seg").alias("_dead")).select(_chunk("entry_id").alias("chunk"), "entry_id", "_dead")
    offset = F.col("entry_id") - _entry(F.lit(0))
    gone = bits.select("seg", "chunk").distinct().join(last, "chunk").where("_dead > seg").groupBy("seg", "chunk")
    gone = gone.agg(*(F.bit_or(F.when((offset < 64) == half, _bit(offset)).otherwise(F.lit(0).cast("long"))).alias(name) for name, half in (("_lo", F.lit(True)), ("_hi", F.lit(False)))))
    left = lambda c: F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"_{c}", F.lit(0).cast("long")))).alias(c)
    return bits.join(gone, ["seg", "chunk"], "left").select("token", "seg", "chunk", left("lo"), left("hi")).where("lo <> 0 OR hi <> 0")


def _holding(sets: DataFrame, rarest: DataFrame, others: DataFrame) -> DataFrame:
    """set, seg, chunk, entry_id of the entries that hold all tokens of a set (set,
    token, others: of its other tokens), from bits of rarest and of other tokens."""
    own = rarest.join(sets, "token").select("set", "others", "seg", "chunk", "lo", "hi")
    alone = own.where("size(others) = 0").select("set", "seg", "chunk", "lo", "hi")
    both = own.where("size(others) > 0").select("set", F.size("others").alias("n"), "seg", "chunk", "lo", "hi", F.explode("others").alias("token"))
    both = both.join(others.select("token", "seg", "chunk", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), ["token", "seg", "chunk"])
    both = both.select("set", "n", "seg", "chunk", *(F.col(c).bitwiseAND(F.col(f"_{c}")).alias(c) for c in ("lo", "hi"))).where("lo <> 0 OR hi <> 0")
    more = both.where("n > 1").groupBy("set", "n", "seg", "chunk").agg(F.count("*").alias("_n"), F.bit_and("lo").alias("lo"), F.bit_and("hi").alias("hi")).where("n = _n")
    every = alone.unionByName(both.where("n = 1").select(alone.columns)).unionByName(more.select(alone.columns))
    offsets = F.filter(F.sequence(F.lit(0), F.lit((1 << CHUNK_BITS) - 1)), lambda i: F.when(i < 64, F.col("lo")).otherwise(F.col("hi")).bitwiseAND(_bit(i)) != 0)
    return every.select("set", "seg", "chunk", F.explode(offsets).alias("offset")).select("set", "seg", "chunk", _entry(F.col("offset")).alias("entry_id"))


def search_segments(queries: DataFrame, store: Store, version: int | None = None) -> DataFrame:
    """query_id, entry_id of all matches of many queries (query_id, q; one row an id)
    in the index as it is, or was at a version.

    Queries with the same tokens are answered together.  The rarest token of a set
    gives its candidates, as bits of a chunk; the other tokens are read only in
    buckets and chunks that a candidate falls into, and take bits away.  Positions are
    read for phrases alone, where all tokens are.
    """
    asked = written(_phrase_tokens(queries), "asked")
    buckets = sorted(r[0] for r in asked.select(store.bucket("blocks")).distinct().collect())  # at most BUCKETS
    blocks = store.read("blocks", version, buckets)
    counts = blocks.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("postings"))
    each = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"), (F.max("n_tokens") > 1).alias("phrased"))
    each = written(each, "queries")
    rated = each.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
    least = rated.groupBy("tokens").agg(F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "token")).alias("least"))
    # a token that no entry has ends its set here
    sets = least.where("least.postings > 0").select("tokens", F.col("least.token").alias("token"), F.array_remove("tokens", F.col("least.token")).alias("others"))
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    rarest = written(_alive_bits(_bits(blocks.join(sets.select("token").distinct(), "token", "left_semi")), store.read("dead", version)), "rarest")
    with_others = rarest.join(sets.where("size(others) > 0").select("token").distinct(), "token", "left_semi")
    chunks = [r[0] for r in with_others.select("chunk").distinct().limit(LISTED_CHUNKS + 1).collect()]
    near = blocks.where(F.col("chunk").isin(chunks)) if len(chunks) <= LISTED_CHUNKS else blocks
    others = _bits(near.join(sets.select(F.explode("others").alias("token")).distinct(), "token", "left_semi"))
    asking = written(each.join(sets.select("tokens", "set"), "tokens").select("query_id", "set", "phrased"), "asking")
    of = lambda some: asking.where(some).join(_holding(sets.join(asking.where(some).select("set").distinct(), "set", "left_semi"), rarest, others), "set")
    plain = of("NOT phrased").select("query_id", "entry_id")
    if asking.where("phrased").isEmpty():
        return plain
    return plain.unionByName(_with_phrases(asked.where("n_tokens > 1"), written(of("phrased"), "candidates"), near))


def _with_phrases(asked: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, entry_id of the candidates (query_id, seg, chunk, entry_id) that hold
    all phrases of their query."""
    met = asked.join(candidates, "query_id").join(blocks, ["token", "seg", "chunk"])
    offset = (F.col("entry_id") - _entry(F.lit(0))).cast("int")
    places = met.select("query_id", "term", "n_tokens", "nth", "entry_id", F.explode(F.filter("places", lambda p: p["id"] == offset)).alias("p"))
    places = places.select("query_id", "term", "n_tokens", "nth", "entry_id", "p.col", F.explode("p.pos").alias("pos"))
    starts = places.groupBy("query_id", "term", "n_tokens", "entry_id", "col", (F.col("pos") - F.col("nth")).alias("start"))
    phrases = starts.agg(F.count("*").alias("n")).where("n = n_tokens").select("query_id", "term", "entry_id").distinct()
    wanted = asked.groupBy("query_id").agg(F.countDistinct("term").alias("wanted"))
    return phrases.groupBy("query_id", "entry_id").agg(F.count("*").alias("n")).join(wanted, "query_id").where("n = wanted").select("query_id", "entry_id")
