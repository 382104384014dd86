"""Order and dominance counts without a task that holds all rows of a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachesight.sources.shared import materialize

#: Rows of a block at least; longer groups have blocks of the square root of their rows, and as many of them.
BLOCK = 4096


def block_size(largest: int) -> int:
    return max(BLOCK, math.isqrt(largest) + 1)


def in_order(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds ``name``, from 0: each row's place in the order of ``columns``. Rows are dealt out by ranges, sorted in their range,
    and ranges start behind the rows of those before, so no range is larger than Spark's sample makes it, but for equal rows."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).sortWithinPartitions(*columns).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "order")
    counts = placed.groupBy("range").agg(F.count("*").alias("count"))  # one row for each partition
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return placed.join(F.broadcast(starts), "range").withColumn(name, F.col("start") + F.col("place")).drop("range", "place", "start")


def count_dominated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each point the number of points of a smaller x and of a y that is no larger. Merge counting: in each round the halves of
    twice as long runs meet."""
    order = np.lexsort((-y, x))  # points of equal x in falling order of y, so that none counts for another
    y = y[order]
    n = len(y)
    counts, by_y = np.zeros(n, np.int64), np.argsort(y, kind="stable")
    at, width = np.arange(n), 1
    while width < n:
        run = at // (2 * width)
        # places in order of their run and then of y: those of the left half count for later ones of the right half
        merged = by_y[np.argsort(run[by_y], kind="stable")]
        left = (merged // width) % 2 == 0
        seen = np.cumsum(left)
        begin = np.searchsorted(run[merged], run[merged], "left")
        before = seen - left - np.where(begin > 0, seen[begin - 1], 0)
        counts[merged[~left]] += before[~left]
        width *= 2
    out = np.empty(n, np.int64)
    out[order] = counts
    return out


def _counting(x: str, y: str, name: str, kept: list[str]):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        return b[kept].assign(**{name: count_dominated(b[x].to_numpy(np.int64), b[y].to_numpy(np.int64))})

    return run


def dominated(rows: DataFrame, by: list[str], x: str, y: str, size: int, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the same ``by`` have a smaller ``x`` and a ``y`` that is no larger.

    ``x`` are places, each once; ``y`` are places, each once at most, or -1, which any number of rows may have and for which
    nothing is counted (null). Counted are rows of the same block of x; of earlier blocks and the same block of y; and, from the
    blocks' histograms of y and their sums in both directions, of earlier blocks and lower blocks of y. Either kind of block has
    ``size`` rows, so the largest task follows ``size`` and not the group.
    """
    bx, by_y = f"{name}_bx", f"{name}_by"
    rows = materialize(rows.withColumn(bx, F.floor(F.col(x) / size)).withColumn(by_y, F.when(F.col(y) < 0, -1).otherwise(F.floor(F.col(y) / size)).cast("long")), "blocks")
    types = dict(rows.dtypes)
    schema = lambda columns: ", ".join(f"`{c}` {types[c]}" for c in columns)
    key = [*by, bx, x]
    inside = rows.groupBy(*by, bx).applyInPandas(_counting(x, y, "inside", rows.columns), f"{schema(rows.columns)}, inside long")
    beside = rows.where(F.col(by_y) >= 0).groupBy(*by, by_y).applyInPandas(_counting(bx, y, "beside", key), f"{schema(key)}, beside long")
    counts = rows.groupBy(*by, bx, by_y).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    cells = rows.groupBy(*by).agg(F.max(bx).alias("last_x"), F.max(by_y).alias("last_y")).select(*by, "last_y", F.explode(F.sequence(zero, "last_x")).alias(bx))
    cells = cells.select(*by, bx, F.explode(F.sequence(zero - 1, "last_y")).alias(by_y))
    earlier = lambda part, order: Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.join(counts, [*by, bx, by_y], "left").withColumn("before", F.coalesce(F.sum("n").over(earlier(by_y, bx)), F.lit(0)))
    sums = sums.withColumn("below", F.coalesce(F.sum("before").over(earlier(bx, by_y)), F.lit(0))).select(*by, bx, by_y, "below")
    out = inside.join(sums, [*by, bx, by_y]).join(beside, key, "left")
    return out.withColumn(name, F.when(F.col(y) >= 0, F.col("inside") + F.col("beside") + F.col("below"))).drop(bx, by_y, "inside", "beside", "below")
