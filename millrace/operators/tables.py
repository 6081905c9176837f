"""Snapshots: written tables, upserts, soft deletes and cursors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.  Only in a
    local session may it be unset: there one is taken for the application; elsewhere
    executors would lose what each of them writes, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="millrace-"))
    return spark.conf.get("spark.checkpoint.dir")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ids(rows: DataFrame, order_cols: list[str], first_id: int, name: str = "id") -> DataFrame:
    """rows with numbers from ``first_id`` in the order of the columns: partitions are
    ranges, and only their sizes are summed in order."""
    ranged = written(rows.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).withColumn("_n", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_n", 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())  # a row a partition
    starts, at = [], first_id
    for p, n in sizes:
        starts.append((p, at))
        at += n
    table = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return ranged.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + F.col("_n") - F.shiftleft("_p", 33)).drop("_n", "_p", "_start")


def merge_snapshot(base: DataFrame, delta: DataFrame, key: str | list[str]) -> DataFrame:
    """base with the rows of delta in place of those with the same key."""
    keys = [key] if isinstance(key, str) else key
    return base.join(delta.select(keys).distinct(), keys, "left_anti").select(base.columns).unionByName(delta.select(base.columns))


def soft_delete(table: DataFrame, ids: DataFrame, now: Column | object) -> DataFrame:
    """table with deleted set, and updated_at, on the undeleted rows in ids (id)."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    new = F.col("_hit").isNotNull() & ~F.col("deleted")
    now = now if isinstance(now, Column) else F.lit(now)
    return (
        table.join(hit, "id", "left")
        .withColumns({"updated_at": F.when(new, now.cast("timestamp")).otherwise(F.col("updated_at")), "deleted": F.col("deleted") | new})
        .select(table.columns)
    )


def advance_cursors(cursors: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors after updates (source_id, cursor, updated_at), the latest of each
    source; an empty cursor takes the row away."""
    last = updates.groupBy("source_id").agg(F.max_by(F.struct("cursor", "updated_at"), F.struct("updated_at", "cursor")).alias("n"))
    both = cursors.withColumn("o", F.struct("cursor", "updated_at")).select("source_id", "o").join(last, "source_id", "full")
    now = F.coalesce("n", "o")
    return both.select("source_id", now["cursor"].alias("cursor"), now["updated_at"].alias("updated_at")).where("cursor IS NOT NULL AND cursor <> ''")
