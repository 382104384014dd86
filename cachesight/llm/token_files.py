"""Token ids in flat binary files.

A shard is two files: ``NAME.bin`` holds the ids of its documents one after another as unsigned little-endian integers,
16 bits wide if the vocabulary allows it and else 32; ``NAME.idx`` is a header of three 64-bit integers (version, bytes
an id, documents), then the doc_ids and then n+1 offsets in ids, all 64-bit. Both are memory-mapped when read. The shards
are in ascending order of doc_id. A shard's base is the sum of the ids in the shards before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import partitions, shared_dir, table
from cachesight.llm.token_counts import worker_pieces

VERSION = 1
SHARDS = "shard int, name string, n_docs long, n_ids long"
NULL_ID = np.iinfo(np.int64).min
READ_IDS = 1 << 20
END = 2


def local_path(folder: str) -> str:
    """The shared folder as the executors mount it."""
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return u.path


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path, shard = local_path(folder), TaskContext.get().partitionId()
        os.makedirs(path, exist_ok=True)
        encoder = None
        own = f"{path}/.{uuid.uuid4().hex}"  # of this attempt; a second attempt of the task makes its own
        ids, lengths, total = [], [], 0
        with open(f"{own}.bin", "wb", buffering=1 << 20) as out:
            for b in batches:
                if encoder is None:
                    import tokenizers

                    wide = tokenizers.Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
                    dtype = np.dtype("<u4" if wide else "<u2")
                    encoder = worker_pieces(tokenizer, dtype.str, counts=False)
                    end = np.array([end_id], dtype).tobytes()
                ids.append(b["doc_id"].fillna(NULL_ID).to_numpy(np.int64))
                texts = b["content"].tolist()
                for at in range(0, len(texts), 1024):
                    for data in encoder.many(texts[at : at + 1024]):
                        out.write(data)
                        out.write(end)
                        lengths.append(len(data) // dtype.itemsize + 1)
        if not ids:
            os.remove(f"{own}.bin")
            return
        n = len(lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<i8")])
        with open(f"{own}.idx", "wb") as out:
            out.write(np.array([VERSION, dtype.itemsize, n], "<i8").tobytes())
            out.write(np.concatenate(ids).astype("<i8").tobytes())
            out.write(offsets.astype("<i8").tobytes())
        name = f"shard-{shard:06d}"
        for kind in ("bin", "idx"):
            os.replace(f"{own}.{kind}", f"{path}/{name}.{kind}")
        yield pd.DataFrame({"shard": [shard], "name": [name], "n_docs": [n], "n_ids": [int(offsets[-1])]})

    return run


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = local_path(folder)
        for b in batches:
            for name, base in zip(b["name"], b["base"], strict=True):
                index = np.memmap(f"{path}/{name}.idx", "<i8", "r")
                _, width, n = index[:3].tolist()
                doc, offset = index[3 : 3 + n], index[3 + n : 4 + 2 * n]
                data = np.memmap(f"{path}/{name}.bin", f"<u{width}", "r")
                for at in range(0, n, 10_000):
                    to = min(n, at + 10_000)
                    crc = []
                    for k in range(at, to):
                        c = 0
                        for x in range(int(offset[k]), int(offset[k + 1]), READ_IDS):
                            c = zlib.crc32(data[x : min(x + READ_IDS, int(offset[k + 1]))].astype("<u4").tobytes(), c)
                        crc.append(c)
                    own = doc[at:to]
                    yield pd.DataFrame({"doc_id": pd.array(own, "Int64").copy(), "start": base + offset[at:to], "n_tokens": np.diff(offset[at : to + 1]), "ids_crc32": crc}).assign(doc_id=lambda x: x["doc_id"].mask(x["doc_id"] == NULL_ID))

    return run


def write_token_files(texts: DataFrame, folder: str, tokenizer: str, end_id: int = END, column: str = "text") -> DataFrame:
    """Write the shards and return them with their bases: (shard, name, n_docs, n_ids, base).

    Documents are dealt by ranges of doc_id, so a text crosses the network once. Only the number of ids of each shard
    comes to the driver. Null ids sort first; null texts have the end id only; repeated rows are written repeatedly, in
    order of their texts. A task that runs twice writes the same bytes and replaces its files as a whole.
    """
    spark = texts.sparkSession
    content = F.coalesce(F.col(column), F.lit(""))
    dealt = texts.select("doc_id", content.alias("content")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "content")
    shards = sorted(dealt.mapInPandas(_writer(folder, tokenizer, end_id), SHARDS).collect())
    bases = [0, *accumulate(s.n_ids for s in shards)]
    return spark.createDataFrame([(*s, b) for s, b in zip(shards, bases)], f"{SHARDS}, base long")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    n = max(1, shards.count())
    return shards.repartition(n).mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-files")
    shards = write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(shards, folder)
