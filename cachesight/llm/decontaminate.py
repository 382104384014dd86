"""Benchmark decontamination, in DataFrame functions only.

The benchmark's word windows, and their first words, are hashed into two bit sets that become literals of the scan over the
training texts. A window is hashed as a whole only where the bit of its first words is set; windows whose own bit is set are
joined to the benchmark by their words, which verifies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import stand_in, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words, after A-Z became a-z.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW = 10
#: Words of a window that are looked up first.
HEAD = 3
#: Bits of a literal for each counted window, and bounds of its size. Beyond the larger one more windows of the texts are joined.
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 22
#: Up to so many benchmark windows are broadcast for the join. Beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD + "+"), "")


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, length, key): each window once. An item of fewer words than ``size`` is one window of its own length."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(size)))
    at = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    keys = F.transform(at, lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))
    return w.select("item_id", "length", F.explode(keys).alias("key")).distinct()


def _bit(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(bits))


def bit_set(lengths: Column, hashed: Column, windows: DataFrame, bits: int) -> dict[int, Column]:
    """By window length, a literal of ``bits`` bits. The driver gets at most bits / 64 integers for each length."""
    bit = windows.select(lengths.alias("length"), _bit(hashed, bits).alias("bit"))
    longs = bit.groupBy("length", F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))
    held: dict[int, list[int]] = {}
    for r in longs.collect():
        held.setdefault(r.length, [0] * (bits // 64))[r.at] = r.bits
    return {n: F.split(F.lit(",".join(map(str, own))), ",").cast("array<long>") for n, own in sorted(held.items())}


def _places(w: Column, length: int, heads: Column, whole: Column, bits: int) -> Column:
    """Places of the windows of a text whose bits are set, with their words."""
    own = lambda i: F.slice(w, i, length)
    head = lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(min(length, HEAD))])
    is_set = lambda of, h: F.getbit(F.element_at(of, (F.floor(h / 64) + 1).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1
    at = F.filter(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: is_set(heads, _bit(head(i), bits)) & is_set(whole, _bit(F.xxhash64(own(i)), bits)))
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.array_join(own(i), " ").alias("key")))
    return F.when(F.size(w) >= length, found).otherwise(F.array().cast("array<struct<at:int,length:int,key:string>>"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, digest: Column | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, hit (its hit words' numbers from 1, sorted), items and
    ``digest``, by default what stands for a null id.

    Null texts have no words; null ids and repeated rows are kept, each row by itself; repeated item rows count once. An
    empty benchmark hits nothing. A row's number among the scanned rows carries it through, so it is the same when a lost
    task runs again.
    """
    windows = benchmark_windows(benchmark, size)
    n_windows = windows.count()
    bits = min(max(1 << (BITS_A_WINDOW * n_windows - 1).bit_length(), LEAST_BITS), MOST_BITS) if n_windows else LEAST_BITS
    w = F.split("key", " ")
    whole = bit_set(F.col("length"), F.xxhash64(w), windows, bits)
    # windows of fewer words than HEAD have heads of their own length
    heads = {}
    for n in whole:
        of = F.xxhash64(*[F.element_at(w, k + 1) for k in range(min(n, HEAD))])
        heads |= bit_set(F.col("length"), of, windows.where(F.col("length") == n), bits)
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (stand_in("text") if digest is None else digest).alias("digest"), words(F.col("text")).alias("w"))
    none = F.array().cast("array<struct<at:int,length:int,key:string>>")
    places = F.concat(*[_places(F.col("w"), n, heads[n], b, bits) for n, b in whole.items()]) if whole else none
    scanned = base.select("row", "doc_id", "digest", F.size("w").cast("long").alias("n_words"), F.explode_outer(places).alias("p"))
    keyed = scanned.select("row", "doc_id", "digest", "n_words", F.col("p.at").alias("at"), F.col("p.length").alias("length"), F.col("p.key").alias("key"))
    small = n_windows <= BROADCAST_WINDOWS
    known = windows.withColumn("known", F.lit(True))  # also where the item's id is null
    joined = keyed.join(F.broadcast(known) if small else known, ["length", "key"], "left")
    hit = F.when(F.col("known"), F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))
    found = joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(hit)))).alias("hit"), F.collect_set("item_id").alias("items"))
    return found.drop("row")


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    found = contamination(docs, benchmark, size)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; rows of one id stay or go together, those
    of a null id each by itself."""
    return without(docs, contamination(docs, benchmark, size).where(F.size("hit") > 0).select("doc_id", "digest"), ["text"])


def remove_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of their texts, each with what parts it from the next; other texts are as they were."""
    own = F.sha2(F.coalesce("text", F.lit("")), 256)  # rows of one id and text have the same hits
    hits = contamination(docs, benchmark, size, own).where(F.size("hit") > 0).groupBy(F.col("doc_id").alias("cachesight_hit_id"), F.col("digest").alias("cachesight_hit_digest")).agg(F.first("hit").alias("cachesight_hit"))
    marked = docs.withColumn("cachesight_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = marked["doc_id"].eqNullSafe(hits["cachesight_hit_id"]) & marked["cachesight_digest"].eqNullSafe(hits["cachesight_hit_digest"])
    joined = marked.join(hits, same, "left")
    any_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    any_gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    parts = F.regexp_extract_all("text", F.lit(f"{any_word}{any_gap}"), F.lit(0))
    lead = F.regexp_extract("text", f"^{any_gap}", 0)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("cachesight_hit", (i + 1).cast("int"))), "")
    text = F.when(F.col("cachesight_hit").isNull(), F.col("text")).otherwise(F.concat(lead, kept))
    return joined.withColumn("text", text).select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, length, array_to_string(w[i:i + length - 1], ' ') AS key
       FROM d, (SELECT DISTINCT length FROM bw), unnest(range(1, len(w) - length + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.length, item_id FROM dw JOIN bw ON dw.length = bw.length AND dw.key = bw.key),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + length)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
