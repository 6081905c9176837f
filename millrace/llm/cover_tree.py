"""Exact top-k search by inner product over cover trees of queries and data.

The upper level is common to both sides: covers around pivots, cut into blocks of
bounded size.  A pair of blocks is looked at only if the most that its centers
and covering radii allow reaches the worst k-th score of the query block.  Inside
a pair both blocks become cover trees and pairs of nodes are pruned the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of a data block and of a query block, about; query blocks of one task;
#: pivots at least and most (one a data block in between), and vectors among which
#: they are chosen.
DATA_BLOCK, QUERY_BLOCK, QUERY_BLOCKS_TOGETHER = 4096, 256, 16
PIVOTS, MOST_PIVOTS, PIVOT_SAMPLE = 64, 512, 8192
_LEAF, _FAN_OUT = 64, 16
_FOUND = "query long, query_id long, vec_id long, score long"


class Node:
    """A cover: center, radius that holds all its rows, and its children."""

    def __init__(self, x: np.ndarray, rows: np.ndarray) -> None:
        self.rows = rows
        self.center = x[rows[0]]
        away = np.sqrt(((x[rows] - self.center) ** 2).sum(axis=1))
        self.radius = float(away.max())
        self.norm = float(np.sqrt((self.center**2).sum()))
        self.children: list[Node] = []
        if len(rows) <= _LEAF or self.radius == 0:
            return
        nearest, owner, k = away, np.zeros(len(rows), dtype=np.int64), 1
        while k < _FAN_OUT and nearest.max() > self.radius / 2:  # the next level halves the radius where fan-out allows
            far = int(nearest.argmax())
            d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(axis=1))
            closer = d < nearest
            owner[closer], nearest = k, np.minimum(nearest, d)
            owner[far], k = k, k + 1
        for child in range(k):
            own = rows[owner == child]
            if len(own) == len(rows):
                return
            if len(own):
                self.children.append(Node(x, own))

    def leaves(self) -> Iterator["Node"]:
        if not self.children:
            yield self
        for child in self.children:
            yield from child.leaves()


def most_score(q: Node, d: Node) -> float:
    """No inner product between the rows of two covers is above this."""
    top = float(q.center @ d.center) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return top + 1e-9 * abs(top) + 1e-6


def dual_search(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data row, score) of each query's best k rows, its own row left out,
    ties to smaller ids; rows below a query's ``floor`` (a k-th score it has
    elsewhere) may lack.

    Both trees are descended together, the wider node first and its children by
    what they may reach at most; a pair of nodes is left once that is below the worst
    k-th score under the query node.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
    worst = floor.astype(float).copy()

    def compare(a: Node, b: Node) -> None:
        scores = q[a.rows] @ x[b.rows].T
        for row, own in zip(a.rows, scores):
            ok = (own >= worst[row]) & (x_rows[b.rows] != q_rows[row])
            if not ok.any():
                continue
            s, r = np.concatenate([found[row][0], own[ok]]), np.concatenate([found[row][1], b.rows[ok]])
            order = np.lexsort((x_ids[r], -s))[:k]
            found[row] = s[order], r[order]
            if len(order) == k:
                worst[row] = max(worst[row], s[order][-1])

    waiting = [(np.inf, Node(q, np.arange(len(q))), Node(x, np.arange(len(x))))]
    while waiting:
        bound, a, b = waiting.pop()
        if bound < worst[a.rows].min():
            continue
        if not a.children and not b.children:
            compare(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            waiting += sorted(((most_score(a, c), a, c) for c in b.children), key=lambda e: e[0])  # the best is popped first
        else:
            waiting += [(most_score(c, b), c, b) for c in a.children]
    n = np.array([len(s) for s, _ in found])
    return np.repeat(np.arange(len(q)), n), np.concatenate([r for _, r in found]).astype(np.int64), np.concatenate([s for s, _ in found])


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x), x as double) of the rows that take part: null
    ids, and vectors null or with null or non-finite components, do not.  Rows that
    repeat an id stay rows of their own."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(fine & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _pivots(vectors: DataFrame) -> np.ndarray:
    """Pivots far apart, more of them for more rows, from a bounded sample spread by a
    hash of the id."""
    most = min(MOST_PIVOTS, max(PIVOTS, vectors.count() // DATA_BLOCK))
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).collect()], dtype=float)
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``row``, a number of its own for each row, ``cover``, the nearest pivot, and
    ``away``, the distance to it; to be written before use, as rows are numbered where
    they lie."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).astype(float).reshape(batch.num_rows, -1)
            square = (v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T + (pivots**2).sum(axis=1)
            cover = square.argmin(axis=1)
            away = np.sqrt(((v - pivots[cover]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cover.astype(np.int32)), pa.array(away)], names=["vec_id", "v", "cover", "away"])

    return vectors.mapInArrow(place, "vec_id long, v array<long>, cover int, away double").withColumn("row", F.monotonically_increasing_id())


def _blocks(placed: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block (cover, part), and block, n, radius of the blocks: a
    cover with many rows is cut by a hash of the id."""
    n = placed.groupBy("cover").agg(F.count("*").alias("n")).collect()  # a row a pivot
    parts = F.create_map(F.lit(-1), F.lit(1), *(F.lit(x) for r in n for x in (r["cover"], -(-r["n"] // size))))  # -1: no cover, so that there is one entry
    rows = placed.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("cover")]).cast("int"))
    return rows, rows.groupBy("cover", "part").agg(F.max("away").alias("radius"))


def _search(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int, bundles: int) -> DataFrame:
    """Best k rows of each query in each pair of blocks (q_cover, q_part, cover,
    part).  queries: query (its row), query_id, q, q_cover, q_part, floor.  Query blocks that look
    at one data block meet it in ``bundles`` tasks at most."""
    units = pairs.withColumn("bundle", F.pmod(F.xxhash64("q_cover", "q_part"), F.lit(bundles)).cast("int"))
    keys = ["cover", "part", "bundle"]
    left = queries.join(units, ["q_cover", "q_part"]).select(*keys, "query", "query_id", "q", "floor")
    right = data.join(units.select(*keys).distinct(), ["cover", "part"]).select(*(F.col(c).alias(c) for c in (*keys, "row", "vec_id", "v")))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        a, b = (np.stack(c.to_numpy()).astype(float) for c in (q["q"], x["v"]))
        row, at, score = dual_search(a, q["query"].to_numpy(), b, x["row"].to_numpy(), x["vec_id"].to_numpy(), k, q["floor"].to_numpy())
        return pd.DataFrame({"query": q["query"].to_numpy()[row], "query_id": q["query_id"].to_numpy()[row], "vec_id": x["vec_id"].to_numpy()[at], "score": score.astype(np.int64)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product
    for each row where ``is_query`` holds, the row itself left out, ties to the
    smaller vec_id; all rows if there are fewer than k.

    ``vectors`` is vec_id, v (array<long>); rows that repeat an id are queries and
    candidates each.  Vectors are compared with those of their own length only.  Scores are exact while the squared
    length times 2 is below 2**53.  Repeated vectors are cut into blocks like any
    cover and pruned as one.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    lengths = [r[0] for r in vectors.select(F.size("v")).distinct().collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for length in sorted(lengths):
        out = out.unionByName(_top_k(vectors.where(F.size("v") == length), is_query, k))
    return out


def _top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    pivots = _pivots(vectors)
    placed = written(_placed(vectors, pivots), "placed")
    data, blocks = _blocks(placed, DATA_BLOCK)
    blocks = written(blocks, "blocks")
    asked, q_blocks = _blocks(placed.where(is_query), QUERY_BLOCK)
    names = {"cover": "q_cover", "part": "q_part"}
    asked = asked.select("row", "vec_id", "v", "cover", "part").withColumnsRenamed(names | {"row": "query", "vec_id": "query_id", "v": "q"})
    q_blocks = written(q_blocks.withColumnsRenamed(names | {"radius": "q_radius"}), "query-blocks")
    bundles = -(-q_blocks.count() // QUERY_BLOCKS_TOGETHER) or 1
    own = q_blocks.join(blocks.where("part = 0"), F.col("q_cover") == F.col("cover")).select("q_cover", "q_part", "cover", "part")
    low = F.lit(float("-inf")).alias("floor")
    first = written(_search(asked.select("*", low), data, own, k, bundles), "first-blocks")
    floors = _best(first, k).where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("floor"))
    asked = written(asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "asked")
    worst = asked.groupBy("q_cover", "q_part").agg(F.min("floor").alias("worst"))
    norms = np.sqrt((pivots**2).sum(axis=1))
    product = pivots @ pivots.T
    near = vectors.sparkSession.createDataFrame(
        [(i, j, float(product[i, j]), float(norms[i]), float(norms[j])) for i in range(len(pivots)) for j in range(len(pivots))],
        "q_cover int, cover int, product double, q_norm double, norm double",
    )  # pivots squared
    bound = F.col("product") + F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius") + F.col("radius") * F.col("q_radius")
    pairs = q_blocks.join(worst, ["q_cover", "q_part"]).join(F.broadcast(near), "q_cover").join(blocks, "cover")
    pairs = pairs.where((bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("worst")) & ~((F.col("q_cover") == F.col("cover")) & (F.col("part") == 0)))
    rest = _search(asked, data, written(pairs.select("q_cover", "q_part", "cover", "part"), "pairs"), k, bundles)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM fine),
s AS (SELECT q.row, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
    FROM n q JOIN n d ON q.vec_id % 50 = 0 AND q.row <> d.row AND len(q.v) = len(d.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
