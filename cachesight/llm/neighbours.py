"""Nearest neighbours by blocks: tiles of 8-bit products with error bounds, then exact products of what the bounds leave.

Vectors are quantised to integers q with x = s * (q + e), |e| <= 1/2 in each component, so for a query x and a candidate
y, |<x, y> - s_x s_y <q_x, q_y>| <= s_x / 2 * |y|_1 + s_x |q_x|_1 * s_y / 2. Whatever may be among a query's ``k`` nearest
by these bounds is computed again in double precision, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import partitions, table

TILE = 2048
#: Candidates of one task, and queries of one block.
STRIPE, QUERIES = 2 * TILE, 1024
PACKED = "stripe int, kind int, block int, size int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(key, b: pd.DataFrame) -> pd.DataFrame:
    ids = b["vec_id"].to_numpy("<i8")
    order = np.argsort(ids, kind="stable")
    own = [b["embedding"].iloc[k] for k in order]
    vectors = np.zeros((len(own), max(map(len, own))), "<f8")
    for row, v in zip(vectors, own, strict=True):
        row[: len(v)] = v
    return pd.DataFrame({"stripe": [0], "kind": [int(key[0])], "block": [int(key[1])], "size": [vectors.shape[1]], "ids": [ids[order].tobytes()], "vectors": [vectors.tobytes()]})


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit integers and a scale for each row."""
    s = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny) / 127
    return np.rint(x / s[:, None]).astype(np.int8), s


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component, so equal vectors have equal products."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * y[:, c]
    return total


class Tile:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        q, self.scale = quantise(vectors)
        # products of 8-bit integers are exact in single precision up to 1,040 components, in double precision always
        self.kind = np.float32 if vectors.shape[1] <= 1000 else np.float64
        self.q = q.astype(self.kind)
        self.norm = np.abs(vectors).sum(axis=1)

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of what can be among the ``k`` nearest; ``floor`` is each query's k-th score so far."""
        both = min(x.shape[1], self.vectors.shape[1])  # components beyond either count as zero
        x = x[:, :both]
        q, s = quantise(x)
        about = (q.astype(self.kind) @ self.q[:, :both].T) * s[:, None] * self.scale
        bound = np.outer(s / 2, self.norm) + np.outer(s * np.abs(q.astype(np.int32)).sum(axis=1) / 2, self.scale)
        bound = bound * (1 + 1e-9) + 1e-12 * np.abs(about)
        own = ids[:, None] == self.ids
        low = np.where(own, -np.inf, about - bound)
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        a, b = np.nonzero((about + bound >= floor[:, None]) & ~own)
        score = np.empty(len(a))
        for at in range(0, len(a), 1 << 17):
            part = slice(at, at + (1 << 17))
            score[part] = exact(x[a[part]], self.vectors[b[part], :both])
        return a, self.ids[b], score


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stripe, tiles = None, []
        for b in batches:
            for s, kind, size, ids, vectors in zip(b["stripe"], b["kind"], b["size"], b["ids"], b["vectors"], strict=True):
                if s != stripe:
                    stripe, tiles = s, []
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, size)
                if kind == 0:
                    tiles += [Tile(ids[a : a + TILE], x[a : a + TILE]) for a in range(0, len(ids), TILE)]
                    continue
                for at in range(0, len(ids), QUERIES):
                    q, own = ids[at : at + QUERIES], x[at : at + QUERIES]
                    heaps: list[list[tuple[float, int]]] = [[] for _ in q]  # smallest first: the k nearest by (score, -id)
                    for tile in tiles:
                        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
                        for n, i, score in zip(*(v.tolist() for v in tile.nearest(q, own, k, floor)), strict=True):
                            h = heaps[n]
                            if len(h) < k:
                                heapq.heappush(h, (score, -i))
                            elif (score, -i) > h[0]:
                                heapq.heapreplace(h, (score, -i))
                    rows = [(int(q[n]), -i, score) for n, h in enumerate(heaps) for score, i in h]
                    if rows:
                        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` candidates of the largest inner product, ties by vec_id.

    ``vectors`` has vec_id and embedding; further columns are ignored. Rows with a null id or an unusable vector take no part; of
    vectors of different lengths the shorter counts as if zeros followed. A candidate is each row whose id is not the query's;
    rows that repeat an id are each a candidate, and the least of their vectors is the query. Candidates cross the network once, query blocks once for each stripe of
    candidates. Each stripe gives ``k`` rows for a query.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = good.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stripes = -(-rows // STRIPE)
    queries = good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-queries.count() // QUERIES)
    place = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))).cast("int").alias("block"), "vec_id", "embedding")
    packed = place(good, 0, stripes).unionByName(place(queries, 1, blocks)).groupBy("kind", "block").applyInPandas(_pack, PACKED)
    candidates = packed.where("kind = 0").withColumn("stripe", F.col("block"))
    spread = packed.where("kind = 1").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    dealt = candidates.unionByName(spread).repartition(max(partitions(spark), stripes), "stripe").sortWithinPartitions("stripe", "kind", "block")
    found = dealt.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
