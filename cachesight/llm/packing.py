"""Optimal length buckets and token-budget batches.

The histogram of lengths over all documents goes to a dynamic program that chooses the bucket bounds of the least padding.
Inside each bucket, batches take as many documents as the token budget allows when each is padded to the bucket's bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.llm.common import materialize, table, tidy
from cachesight.llm.token_counts import worker_pieces

BUCKETS, BUDGET = 16, 16_384
#: Parts of each bucket that are numbered apart.
SLOTS = 1024


def word_count(text: Column) -> Column:
    """Words that ASCII white space parts: a length for those who have no tokenizer."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")).cast("long")


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of the whole text, without any that mark its begin or end; null counts as empty. All executors have the file."""

    @tidy
    def run(batches):
        pieces = worker_pieces(tokenizer)
        for b in batches:
            yield pd.Series(pieces.many(b.tolist()), dtype="int64")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return count(F.coalesce(text, F.lit("")))


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the sorted ``lengths`` with the least sum of padding.

    Padding obeys the quadrangle inequality, so the best split of a prefix never moves left as the prefix grows, and each
    row of the program is found by halving, in O(n log n).
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(float)
    tokens = np.concatenate([[0.0], np.cumsum(counts.astype(float) * lengths)])
    cost = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  of lengths[i:j] in one bucket
    best = np.array([0.0, *(cost(0, j) for j in range(1, n + 1))])
    splits = []
    for _ in range(min(buckets, n) - 1):
        new, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            sums = best[i] + cost(i, j)
            k = int(np.argmin(sums))
            new[j], split[j] = sums[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = new
        splits.append(split)
    out, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(split[j])
    if j:
        out.append(int(lengths[j - 1]))
    return sorted(set(out))


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """For each row: doc_id, length, bucket (from 0), bucket_length, batch (from 0 in its bucket), place (from 0 in its
    batch) and padding.

    A batch holds budget // bucket_length documents, at least one, so a longer document is a batch of its own; only the
    last batch of a bucket may hold fewer. Null ids and repeated rows are packed like others. Rows are numbered within
    SLOTS parts of each bucket, and the parts by the sums before them, so no task needs a whole bucket.
    """
    sized = materialize(docs.select("doc_id", length.alias("length"), F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]).alias("mark")), "lengths")
    histogram = sized.groupBy("length").count().toPandas().sort_values("length")  # as many rows as there are lengths
    ends = bounds(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    if not ends:
        return docs.sparkSession.createDataFrame([], "doc_id long, length long, bucket int, bucket_length long, batch long, place int, padding long")
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], k).otherwise(bucket)
    end = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    placed = sized.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", end).withColumn("slot", F.pmod("mark", F.lit(SLOTS)).cast("int"))
    sizes = placed.groupBy("bucket", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # at most buckets x SLOTS rows
    own = Window.partitionBy("bucket", "slot").orderBy("mark", "doc_id")
    numbered = placed.withColumn("number", F.row_number().over(own) - 1).join(F.broadcast(bases), ["bucket", "slot"])
    number, room = F.col("base") + F.col("number"), F.greatest(F.lit(1), F.expr(f"{budget} div greatest(bucket_length, 1)"))
    numbered = numbered.select("doc_id", "length", "bucket", "bucket_length", number.alias("number"), room.cast("long").alias("room"))
    return numbered.select("doc_id", "length", "bucket", "bucket_length", F.expr("number div room").alias("batch"), F.expr("cast(number % room as int)").alias("place"), (F.col("bucket_length") - F.col("length")).alias("padding"))


def pack_tokens(docs: DataFrame) -> DataFrame:
    """``pack`` by the tokens of the public tokenizer that the token files use."""
    import public_tokenizers

    return pack(docs, token_count(F.col("text"), public_tokenizers.path("word_bpe_49k.json")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
