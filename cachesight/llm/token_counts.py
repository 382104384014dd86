"""Token counts through a digest cache.

A cache table holds (content_digest, tokenizer_digest, n_tokens). Texts are joined to it by digest; only distinct misses
are encoded, and what they give is appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import shared_dir, table
from cachesight.llm.pieces import Pieces

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
OVER = 1024


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = worker_pieces(path)
        for b in batches:
            yield pd.DataFrame({"content_digest": b["content_digest"], "n_tokens": pieces.many(b["content"].tolist())})

    return run


_held: dict = {}


def worker_pieces(path: str, dtype: str = "<u2", counts: bool = True) -> Pieces:
    """One encoder per worker process; a worker serves many tasks."""
    key = (path, dtype, counts)
    if key not in _held:
        _held[key] = Pieces(path, dtype, counts)
    return _held[key]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An empty cache if nothing was stored at ``path`` yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(texts: DataFrame, tokenizer: str, cache: str, column: str = "text", over: int = OVER) -> DataFrame:
    """``texts`` with content_digest, n_bytes, n_tokens and over_limit; misses are appended to the table at ``cache``.

    Content is the text itself, null counting as empty: any other normalisation could change the count. Equal texts are
    encoded once, however many rows hold them; a group of copies is reduced to one row before it is shuffled. A columns
    of ``texts`` of these names is replaced. An empty table gives an empty result and leaves the cache as it is.
    ``tokenizer`` is a path that all executors have.
    """
    spark = texts.sparkSession
    version = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(column), F.lit(""))
    keyed = texts.withColumns({"content_digest": F.unhex(F.sha2(content, 256)), "n_bytes": F.octet_length(content).cast("long")})
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    distinct = keyed.select("content_digest", content.alias("content")).groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known, "content_digest", "left_anti")
    found = misses.mapInPandas(_encode(tokenizer), "content_digest binary, n_tokens long")
    found.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    # two runs that met the same miss at once have both appended it
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.drop("n_tokens", "over_limit").join(known, "content_digest").withColumn("over_limit", F.col("n_tokens") > over)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
