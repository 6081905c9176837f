"""First-wins dedup over several keys at once.

Items are taken in order; one is accepted unless an accepted earlier item, or the
store, holds one of its keys.  That is the first maximal independent set of the
graph whose cliques are the keys.  It is found by ranges of the order: each decides
what does not hang on earlier ranges, and what crosses ranges is settled by joins.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text

from .tables import with_ids, written

LAYERS = ("guid", "url", "hash")
#: Items that share keys with others and that one task decides.
SPAN = 200_000


def key_array(layers: tuple[str, ...] = LAYERS) -> Column:
    """(layer, key) of the keys that are not empty; a guid counts in its source."""
    parts = {
        "guid": F.when(text("guid") != "", F.struct(F.lit(0).alias("layer"), F.concat(text("source_id"), F.lit("\0"), text("guid")).alias("key"))),
        "url": F.when(text("url") != "", F.struct(F.lit(1).alias("layer"), text("url").alias("key"))),
        "hash": F.when(text("content_hash") != "", F.struct(F.lit(2).alias("layer"), text("content_hash").alias("key"))),
    }
    return F.filter(F.array(*(parts[x] for x in layers)), lambda k: k.isNotNull())


def layer_name(layer: Column) -> Column:
    name = F.lit(None).cast("string")
    for k, layer_k in enumerate(LAYERS):
        name = F.when(layer == k, F.lit(layer_k)).otherwise(name)
    return name


def entry_keys(entries: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """layer, key, entry_id of the undeleted entries: what blocks new items."""
    return entries.where(~F.col("deleted")).select(F.col("id").alias("entry_id"), F.explode(key_array(layers)).alias("k")).select("k.layer", "k.key", "entry_id")


def reject_known(cands: DataFrame, keys: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """cands (with ``ord``) and reason: the first layer that the store holds, else
    null; and entry_id, the least that holds it."""
    own = cands.select("ord", F.explode(key_array(layers)).alias("k")).select("ord", "k.layer", "k.key")
    stored = keys.groupBy("layer", "key").agg(F.min("entry_id").alias("entry_id"))
    hit = own.join(stored, ["layer", "key"]).groupBy("ord").agg(F.min(F.struct("layer", "entry_id")).alias("h"))
    joined = cands.join(hit, "ord", "left")
    return joined.select(*cands.columns, layer_name(F.col("h.layer")).alias("reason"), F.col("h.entry_id").alias("entry_id"))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """status of the items of one range, in order: 1 accepted, 0 rejected, -1 open,
    where an item of an earlier range, or an open one here, may hold one of its keys."""
    held, maybe, out = set(), set(), []
    rows = rows.sort_values("n")
    for keys, blocked in zip(rows["ks"], rows["blocked"]):
        if not held.isdisjoint(keys):
            out.append(0)
        elif blocked or not maybe.isdisjoint(keys):
            maybe.update(keys)
            out.append(-1)
        else:
            held.update(keys)
            out.append(1)
    return rows[["r", "n", "ks"]].assign(status=out)


def _rounds(items: DataFrame) -> DataFrame:
    """n of the accepted among items (n, ks), by ranges of SPAN items.

    A range knows which of its keys an open item of an earlier range holds, and
    decides all that doesn't hang on those; what it accepts then rejects items of
    later ranges by one join.  The first range that has open items is decided
    whole, so there are at most as many rounds as ranges."""
    items = written(items, "shared-items")
    if items.count() > SPAN:
        items = written(with_ids(items, ["n"], 0, "place").select(F.expr(f"place DIV {SPAN}").alias("r"), "n", "ks"), "ranges")
    else:
        items = items.select(F.lit(0).cast("long").alias("r"), "n", "ks")
    accepted = []
    while True:
        keys = items.select("r", "n", F.explode("ks").alias("k"))
        first = keys.groupBy("k").agg(F.min("r").alias("first"))
        ready = keys.join(first, "k").groupBy("r", "n").agg(F.collect_list("k").alias("ks"), F.max(F.col("first") < F.col("r")).alias("blocked"))  # a key a layer
        done = written(ready.groupBy("r").applyInPandas(_greedy, "r long, n long, ks array<long>, status int"), "decided")
        accepted.append(done.where("status = 1").select("n"))
        left = done.where("status = -1").drop("status")
        if left.isEmpty():
            return written(reduce(DataFrame.unionByName, accepted), "accepted")
        held = done.where("status = 1").select(F.explode("ks").alias("k"))
        gone = left.select("n", F.explode("ks").alias("k")).join(held, "k", "left_semi").select("n").distinct()
        items = written(left.join(gone, "n", "left_anti"), "open-items")


def dedup_first_wins(cands: DataFrame, order_cols: list[str], layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """cands with accepted, reason (layer) and winner (struct of the order columns
    of the accepted item that holds that key).

    cands has source_id, guid, url, content_hash; the order columns tell its rows
    apart.  Rows without any key are not accepted, reason ``no_identity``.  Items are
    numbered, and a key is known by the first item that holds it.  What shares no key
    is accepted at once; in one layer the first of a key is; else see :func:`_rounds`.
    Keys that all rows share cost no more than others: only counts and minima are
    taken over them, and a range rejects all but one by looking a key up.
    """
    own = written(cands.select(*order_cols, key_array(layers).alias("ks")), "candidates")
    verdict = _first_of_each(own, order_cols) if len(layers) == 1 else _judged(own, order_cols)
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"v.{c}")) for c in order_cols]
    return cands.alias("c").join(verdict.alias("v"), same).select("c.*", "v.accepted", "v.reason", "v.winner")


def _first_of_each(own: DataFrame, order_cols: list[str]) -> DataFrame:
    """The order columns, accepted, reason and winner of rows with one key at most."""
    at, key = F.struct(*order_cols), F.get("ks", F.lit(0))  # null without a key
    owners = own.where(F.size("ks") > 0).groupBy(key["key"].alias("key")).agg(F.min(at).alias("first"))
    joined = own.join(owners, key["key"] == F.col("key"), "left")
    lost, none = F.col("first") < at, F.col("first").isNull()
    reason = F.when(none, F.lit("no_identity")).when(lost, layer_name(key["layer"]))
    return joined.select(*order_cols, (~none & ~lost).alias("accepted"), reason.alias("reason"), F.when(lost, F.col("first")).alias("winner"))


def _judged(own: DataFrame, order_cols: list[str]) -> DataFrame:
    """The same of rows with several keys."""
    numbered = with_ids(own, order_cols, 0, "n")
    keys = numbered.select("n", F.explode("ks").alias("x")).select("n", "x.layer", "x.key")
    owners = keys.groupBy("layer", "key").agg(F.count("*").alias("uses"), F.min("n").alias("first")).where("uses > 1")
    shared = written(keys.join(owners, ["layer", "key"]).select("n", "layer", (F.col("first") * len(LAYERS) + F.col("layer")).alias("k")), "shared-keys")
    items = shared.groupBy("n").agg(F.collect_list("k").alias("ks"))  # a key a layer
    accepted = _rounds(items).withColumn("taken", F.lit(True))
    held = shared.join(accepted, "n").select("k", F.col("n").alias("winner"))
    why = shared.join(accepted, "n", "left_anti").join(held, "k").where("winner < n").groupBy("n").agg(F.min(F.struct("layer", "winner")).alias("why"))
    state = items.select("n", F.lit(True).alias("met")).join(accepted, "n", "left").join(why, "n", "left")
    names = numbered.select(F.col("n").alias("winner_n"), F.struct(*order_cols).alias("winner"))
    none = F.size("ks") == 0
    return numbered.join(state, "n", "left").join(names, F.col("why.winner") == F.col("winner_n"), "left").select(
        *order_cols, (~none & (F.col("met").isNull() | F.coalesce("taken", F.lit(False)))).alias("accepted"),
        F.when(none, F.lit("no_identity")).otherwise(layer_name(F.col("why.layer"))).alias("reason"), "winner",
    )
