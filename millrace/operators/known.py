"""Keys of all entries ever stored, in buckets by hash beside a Bloom filter each.

A batch of items asks the filters first.  Only keys that pass meet the store, and
only buckets that such keys fall into are read; the store itself is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import LAYERS, entry_keys, key_array, layer_name
from .store import Change, Store, Table
from .tables import written

#: Buckets, 64-bit words of a bucket's filter (all parts of a bucket share one shape
#: and are combined by or), and bits set a key.  About 10 bits a key let one in a
#: hundred strange keys pass: 256 buckets of 16,384 words do for 27 million keys, and
#: beyond that more keys are looked up than need be, with the same result.
BUCKETS, WORDS, BITS = 256, 1 << 14, 4
#: Keys that passed are broadcast up to this number (about 100 bytes each); more are
#: joined by shuffle with the buckets they fall into.
BROADCAST_KEYS = 200_000
TABLES = {"keys": Table("layer int, key string, entry_id long", ("layer", "key"), BUCKETS), "filters": Table("bucket int, word int, bits long")}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("layer", "key"), F.lit(BUCKETS)).cast("int")


def _probes() -> Column:
    """The words, and the bits in them, of a key (layer, key)."""
    each = []
    for k in range(1, BITS + 1):
        h = F.xxhash64(F.lit(k), "key", "layer")
        bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
        each.append(F.struct(F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int").alias("word"), bits.alias("bits")))
    return F.array(*each)


def filter_words(keys: DataFrame) -> DataFrame:
    """bucket, word, bits of the filters over keys (layer, key)."""
    probes = keys.select(_bucket().alias("bucket"), F.explode(_probes()).alias("p"))
    return merged_words(probes.select("bucket", "p.word", "p.bits"))


def merged_words(words: DataFrame) -> DataFrame:
    return words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def add_keys(change: Change, entries: DataFrame, layers: tuple[str, ...] = LAYERS) -> None:
    """Adds the keys of new entries, which hold none that the store has."""
    keys = written(entry_keys(entries, layers), "new-keys")
    change.append("keys", keys)
    change.append("filters", filter_words(keys))
    change.compact("keys", 16)
    change.compact("filters", 16, merged_words)


def drop_keys(change: Change, entries: DataFrame) -> None:
    """Takes the keys of entries that were deleted away, so that they no longer block;
    their bits stay in the filters and only cost a look-up."""
    gone = entries.select(F.explode(key_array()).alias("k")).select("k.layer", "k.key").distinct()
    change.upsert("keys", gone.limit(0).withColumn("entry_id", F.lit(0)), gone)


def may_be_known(keys: DataFrame, store: Store) -> DataFrame:
    """Of distinct keys (layer, key) those that pass their bucket's filter, with it."""
    probes = keys.withColumn("bucket", _bucket()).select("layer", "key", "bucket", F.explode(_probes()).alias("p")).select("layer", "key", "bucket", "p.word", F.col("p.bits").alias("asked"))
    words = merged_words(store.read("filters"))
    passed = probes.join(words, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked"))
    return passed.groupBy("layer", "key", "bucket").agg(F.count("*").alias("n")).where(f"n = {BITS}").drop("n")


def reject_known_in(cands: DataFrame, store: Store, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """As :func:`.dedup.reject_known`, against the keys of a store: cands (with
    ``ord``) and reason and entry_id, null where no key is known."""
    own = cands.select("ord", F.explode(key_array(layers)).alias("k")).select("ord", "k.layer", "k.key")
    passed = written(may_be_known(own.select("layer", "key").distinct(), store), "passed-keys")
    asked = sorted(r[0] for r in passed.select("bucket").distinct().collect())  # at most BUCKETS
    few = passed.count() <= BROADCAST_KEYS
    stored = store.read("keys", buckets=asked)
    found = stored.join(F.broadcast(passed.select("layer", "key")) if few else passed.select("layer", "key"), ["layer", "key"])
    found = written(found, "known-keys")
    hit = own.join(found, ["layer", "key"]).groupBy("ord").agg(F.min(F.struct("layer", "entry_id")).alias("h"))
    joined = cands.join(hit, "ord", "left")
    return joined.select(*cands.columns, layer_name(F.col("h.layer")).alias("reason"), F.col("h.entry_id").alias("entry_id"))
