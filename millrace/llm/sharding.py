"""Sharding by fixed virtual slots.

Records are hashed by id into some thousand slots whose number never changes.
Bytes are summed by slot, and a versioned table maps slots to shards.  A map that is
there is read and only edited: slots move where shards drift apart or one is added,
and each edit is a version of its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, written

SLOTS = 4096
#: Parts of a slot in which places are counted.
PARTS = 8


def balanced_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: the largest slots first, each to the shard with least bytes.

    One entry a slot whatever the data, so it is made in the driver.
    """
    heap = [(0, 0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda x: (-slot_bytes.get(x, 0), x)):
        total, number, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (total + slot_bytes.get(slot, 0), number + 1, shard))
    return placed


def grown_map(old: dict[int, int], slot_bytes: dict[int, int]) -> dict[int, int]:
    """An edit of ``old`` with one more shard: slots move only to the new one,
    from the fullest shards, until it has its share of the bytes."""
    new, shards = dict(old), max(old.values()) + 1
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in sorted(old.items()):
        held[shard].append(slot)
    load = {s: sum(slot_bytes.get(x, 0) for x in held[s]) for s in held}
    share, got = sum(load.values()) / (shards + 1), 0
    for own in held.values():
        own.sort(key=lambda x: (slot_bytes.get(x, 0), x))
    while got < share:
        fullest = max(load, key=lambda s: (load[s], -s))
        fits = [x for x in held[fullest] if 0 < slot_bytes.get(x, 0) <= share - got]
        if not fits:
            break
        slot = fits[-1]
        held[fullest].remove(slot)
        new[slot] = shards
        load[fullest] -= slot_bytes[slot]
        got += slot_bytes[slot]
    return new


def evened_map(old: dict[int, int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> dict[int, int]:
    """An edit of ``old`` for bytes that have drifted: while the fullest shard is more
    than ``tolerance`` of the mean above the least, it gives it the largest slot that
    narrows their distance.  Few slots move; ``old`` comes back if none has to."""
    new, held = dict(old), {s: [] for s in set(old.values())}
    for slot, shard in sorted(old.items()):
        held[shard].append((slot_bytes.get(slot, 0), slot))
    for own in held.values():
        own.sort()
    load = {s: sum(b for b, _ in own) for s, own in held.items()}
    most = tolerance * sum(load.values()) / len(load)
    while True:
        full, least = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        apart = load[full] - load[least]
        if apart <= most:
            break
        at = bisect_left(held[full], (apart, -1)) - 1  # smaller than the distance, so that it narrows
        if at < 0 or not held[full][at][0]:
            break
        size, slot = held[full].pop(at)
        insort(held[least], (size, slot))
        load[full], load[least], new[slot] = load[full] - size, load[least] + size, least
    return new


def write_map(spark: SparkSession, path: str, version: int, slot_to_shard: dict[int, int]) -> None:
    """Adds a version to the map table at ``path``; older ones stay readable, and a
    version that is there is not written again."""
    rows = [(s, h) for s, h in sorted(slot_to_shard.items())]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard of one version (the latest by default)."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("virtual_slot", "shard")


def latest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The latest version at ``path`` and its map; (0, {}) if there is none."""
    try:
        every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
        version = every.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    return (version, {r[0]: r[1] for r in read_map(spark, path, version).collect()}) if version else (0, {})  # a row a slot


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> dict[int, int]:
    """Bytes of each virtual slot that has rows."""
    return {r[0]: r[1] for r in slotted(docs, slots).groupBy("virtual_slot").agg(F.sum("size")).collect()}  # a row a slot


def add_shard(docs: DataFrame, map_path: str, slots: int = SLOTS) -> int:
    """Writes the next version of the map at ``map_path`` with one more shard, which
    takes slots from the others by the bytes of ``docs``; the version's number."""
    spark = docs.sparkSession
    version, old = latest_map(spark, map_path)
    if not version:
        raise ValueError(f"no map at {map_path}")
    write_map(spark, map_path, version + 1, grown_map(old, slot_sizes(docs, slots)))
    return version + 1


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shards with near equal bytes (law ``bytes``), one row per row of docs:
    doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from
    0), grown_shard (null), virtual_slot, map_version.

    A map at ``map_path`` is kept, with the number of shards it has, and edited by
    :func:`evened_map` if these rows need it; without one, version 1 is made.  Rows
    of one doc_id share a virtual slot, and so a shard; equal texts need not.  A null
    text has size 1 and the checksum of '', null ids share a slot, and an empty table
    gives no rows.  Places are counted in parts of a slot, so that null or repeated
    ids with many texts are no single group.  Only ids, sizes and checksums are
    shuffled.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int")
    rows = written(slotted(docs, slots).withColumn("part", part), "slotted")
    found = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # slots * PARTS rows at most
    sizes: dict[int, int] = {}
    for r in found:
        sizes[r["virtual_slot"]] = sizes.get(r["virtual_slot"], 0) + r["bytes"]
    path = map_path or new_path(spark, "slot-map")
    version, old = latest_map(spark, path) if map_path else (0, {})
    latest = evened_map(old, sizes) if version else balanced_map(sizes, shards, slots)
    if latest != old:
        version += 1
        write_map(spark, path, version, latest)
    before, firsts = dict.fromkeys(latest.values(), 0), []
    for slot, own, n in sorted((r["virtual_slot"], r["part"], r["n"]) for r in found):
        firsts.append((slot, own, latest[slot], before[latest[slot]]))
        before[latest[slot]] += n
    table = F.broadcast(spark.createDataFrame(firsts, "virtual_slot int, part int, shard int, first long"))  # slots * PARTS rows at most
    inside = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(table, ["virtual_slot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot", F.lit(version).alias("map_version"),
        )
    )
