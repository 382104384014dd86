"""Helpers that several operators of this subpackage share.

``shared_dir``/``materialize``  lineage cuts in the folder named by ``spark.checkpoint.dir``
``chunks``/``WordHashes``       words and word shingles of many texts as numpy arrays
``runs``                        rows of one key after another from sorted batches
``connected_components``        large-star/small-star on DataFrames
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only separators of the words of shingles.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster. Only in local mode, as in tests, it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_cachesight_shared", None)
        if root is None:
            root = spark.sparkContext._cachesight_shared = tempfile.mkdtemp(prefix="cachesight-")
    return f"{root.rstrip('/')}/cachesight/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later jobs start from the files, also after a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stand_in(*columns: str) -> Column:
    """What stands for a null doc_id: a digest of the columns that a decision on the row depends on. Null where there is an id."""
    return F.when(F.col("doc_id").isNull(), F.sha2(F.to_json(F.struct(*columns)), 256))


def without(docs: DataFrame, ids: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the first column of ``ids``. Rows of a null id are told apart by
    ``stand_in(*columns)``, the second column of ``ids``; without columns they all stay."""
    if not columns:
        out = ids.toDF("cachesight_out_id").distinct()
        return docs.join(out, docs["doc_id"] == out["cachesight_out_id"], "left_anti")
    out = ids.toDF("cachesight_out_id", "cachesight_out_digest").distinct()
    marked = docs.withColumn("cachesight_digest", stand_in(*columns))
    same = marked["doc_id"].eqNullSafe(out["cachesight_out_id"]) & marked["cachesight_digest"].eqNullSafe(out["cachesight_out_digest"])
    return marked.join(out, same, "left_anti").select(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """``run`` over batches, which gives memory back when the task ends: a worker process serves later tasks, too, beside others
    and the JVM."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return wrapped


# --- words and shingles -----------------------------------------------------------------------------------------------

#: Public constants of 64-bit mixers.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first bytes of eight


class WordHashes:
    """64-bit hashes of the words of some texts, in order; ``first[d]:first[d+1]`` are those of text d.

    Words are what ASCII white space separates, with A-Z as a-z. A word is hashed in pieces of eight bytes, each mixed with what
    came before it, for all words at once: words of one length up to eight have different hashes.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = _IS_SPACE):
        """``separators``: of each byte value whether it parts words; the newline has to."""
        buf = self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = separators[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        self._eight = np.lib.stride_tricks.sliding_window_view(_LOWER[np.append(buf, np.zeros(8, np.uint8))], 8)
        self.words = self.hashes(self.start, self.end)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])  # bytes before each text
        self.first = np.searchsorted(self.start, self.offset)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from ``start`` to ``end``."""
        size = end - start
        h = mix(size.astype(np.uint64) * _P + _Q)
        live, at = np.arange(len(size)), 0
        while len(live := live[size[live] > at] if at else live):
            piece = np.ascontiguousarray(self._eight[start[live] + at]).view("<u8").ravel() & _EIGHT[np.minimum(size[live] - at, 8)]
            h[live] = mix((h[live] ^ piece) * _P)
            at += 8
        return h

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes; apart from those of words and of other sizes."""
        return mix(self.hashes(self.start, np.minimum(self.start + size, self.end)) + np.uint64(size * int(_Q) % (1 << 64)))

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words and where each text's begin; a shorter text is one run, if it has words."""
        w, first = self.words, self.first
        n = np.diff(first)
        m = len(w)
        rolled = np.zeros(max(m - size + 1, 0), np.uint64)
        for k in range(size if len(rolled) else 0):
            rolled = rolled * _Q + w[k : m - size + 1 + k]
        counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begin[-1], np.uint64)
        inside = np.ones(len(rolled), bool)
        for d in np.flatnonzero(n):
            a, b = first[d], first[d + 1]
            inside[max(a, b - size + 1) : b] = False
            if n[d] < size:
                h = np.uint64(n[d])
                with np.errstate(over="ignore"):
                    for x in w[a:b]:
                        h = h * _Q + x + _P
                out[begin[d]] = h
        full = np.flatnonzero(n >= size)
        if len(full):
            kept = rolled[inside]
            where = np.repeat(begin[full] - np.concatenate([[0], np.cumsum(counts[full])])[:-1], counts[full])
            out[np.arange(len(kept)) + where] = kept
        return mix(out), begin


def chunks(texts: Iterable[str | bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lists of UTF-8 texts of about ``CHUNK_BYTES`` with the index of the first; null counts as empty."""
    at, held, size = 0, [], 0
    for t in texts:
        b = t.encode() if isinstance(t, str) else t if isinstance(t, bytes) else b""
        if held and size + len(b) > CHUNK_BYTES:
            yield at, held
            at, held, size = at + len(held), [], 0
        held.append(b)
        size += len(b)
    if held:
        yield at, held


def strings(**columns: list) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def rows_frame(rows: list[tuple], columns: list[str], nullable: list[str] = ()) -> pd.DataFrame:
    """Rows as a frame; ``nullable`` are integers that may be null, text stays as Python strings."""
    values = zip(*rows, strict=True) if rows else ([] for _ in columns)
    held = {c: list(v) for c, v in zip(columns, values, strict=True)}
    return pd.DataFrame({c: pd.array(v, "Int64") if c in nullable else pd.Series(v, dtype=object if not v or isinstance(v[0], (str, bytes)) else None) for c, v in held.items()})


# --- grouped streams --------------------------------------------------------------------------------------------------


def runs(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """From batches sorted by ``key``: frames that hold whole keys only (many keys to a frame).

    A key's rows are held together, so use it where a contract bounds them.
    """
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[key].to_numpy()
        if rest and rest[-1][key].iloc[-1] != k[0]:
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = []
        cut = int(np.flatnonzero(k == k[-1])[0]) if k[0] != k[-1] else 0
        if cut:
            rest.append(b.iloc[:cut])
            yield pd.concat(rest, ignore_index=True)
            rest = []
        rest.append(b.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


# --- connected components ---------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches; nodes that are roots are left out.

    Alternates the large-star and small-star steps. Each is a minimum by node, which is summed up before the shuffle,
    and an equi-join that Spark may split where a node has many edges. Only counts come to the driver.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs = e.join(least, "u")
        e = pairs.select("u", F.col("m").alias("v")).unionByName(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialize(e, name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (now.n, now.h)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
