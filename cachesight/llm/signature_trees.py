"""N-gram Jaccard join with signature trees.

1. Each text becomes its set of word shingles, a digest of the set and min-hashes. Texts of one set are one class; the join is
   between classes.
2. Min-hash bands say where trees are built: classes that share a band are tied to one of them of like size, the leader, so a
   bucket of m classes makes m - 1 ties. Two sets of similarity s share no band with probability (1 - s^ROWS)^BANDS: 5e-9 at
   0.75. Linked sets are therefore connected by ties, though most of the tied ones are not linked.
3. Blocks of a leader and classes that are tied to it most often are joined with themselves: a signature tree over the block
   (nodes hold OR-combined bitmaps and size ranges) is traversed against itself, node pairs are pruned by their largest
   possible overlap, and sets of what is left are compared exactly. Links make components.
4. Where ties still connect different components, their classes are cut into blocks by size range, and the trees of blocks of
   equal and neighbouring ranges are traversed against each other, but for blocks of the largest component among themselves.
   So all that ties connect is either in one component or was compared.
5. Components of the links of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.llm.common import WordHashes, chunks, connected_components, materialize, mix, partitions, runs, table, tidy

BANDS, ROWS = 50, 4
#: Similarity as a fraction, so that limits are exact.
NUMERATOR, DENOMINATOR = 75, 100
#: Sets and shingles of a block, about (a larger set is a block's alone); sets of a leaf, children of a node.
BLOCK, SHINGLES, LEAF, FAN = 512, 1 << 21, 16, 4
#: Leaders in whose blocks a class is compared first.
LEADERS = 2
#: Pairs whose sets are compared at once.
PAIRS = 8192
_MULTIPLIERS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALTS = mix(np.arange(1000, 1000 + BANDS * ROWS, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text its distinct shingles, sorted."""
    h, begin = WordHashes(texts).shingles()
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(k), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.split(k[new], np.searchsorted(d[new], np.arange(1, len(texts))))


def min_hashes(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima under different multiplications of the high halves."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MULTIPLIERS), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096] ^ _SALTS[:, None]) * _MULTIPLIERS[:, None]).min(axis=1))
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    m = min_hashes(s).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, c])
    return key


def required(a, b):
    """The least overlap of linked sets of sizes a and b: |A and B| >= s / (1 + s) * (a + b)."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, contents = b["doc_id"].astype("Int64"), b["content"]
        for at, part in chunks(b["text"]):
            sets = shingle_sets(part)
            yield pd.DataFrame({
                "doc_id": ids.iloc[at : at + len(part)].array, "content": contents.iloc[at : at + len(part)].to_numpy(), "n_shingles": [len(s) for s in sets],
                "digest": [_digest(s) for s in sets],
                "bands": [band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets],
            })


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set and band keys of each row; null texts are empty."""
    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("content"))
    return own.mapInPandas(tidy(_describe), "doc_id long, content long, n_shingles long, digest binary, bands array<long>")


def _bucket_ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (key, n, id) sorted by them: a tie of each member of a bucket but the first. One member and a leader are held.

    A member is tied to the leader, the smallest set before it that is large enough to be linked with it. Where the leader is
    too small, the member is the next leader and is tied to the member before it, if that one is large enough. If it is not, no
    set before it can be linked with one behind it.
    """
    key, leader, led, last, held = None, 0, 0, 0, 0
    for b in batches:
        k, n, ids = b["key"].to_numpy(), b["n"].to_numpy(), b["id"].to_numpy()
        if not len(k):
            continue
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        part = same.copy()
        part[:-1] |= same[1:]
        part[0] |= k[0] == key
        part[-1] = True  # it may go on in the next batch
        rows = np.flatnonzero(part)
        out = []
        for kk, m, i in zip(k[rows].tolist(), n[rows].tolist(), ids[rows].tolist(), strict=True):
            if kk != key:
                key, leader, led = kk, i, m
            elif DENOMINATOR * led >= NUMERATOR * m:
                out.append((i, leader, m))
            else:
                if DENOMINATOR * held >= NUMERATOR * m:
                    out.append((i, last, m))
                leader, led = i, m
            last, held = i, m
        if out:
            yield pd.DataFrame(out, columns=["u", "v", "n"])


class Node:
    """Sets ``low`` to ``high`` of a block: their OR-combined bitmap, their range of sizes and ``lost``, the most shingles
    by which a set's size exceeds its bits."""

    __slots__ = ("bits", "children", "high", "largest", "lost", "low", "smallest")

    def __init__(self, low, high, bits, smallest, largest, lost, children=()):
        self.low, self.high, self.bits, self.smallest, self.largest, self.lost, self.children = low, high, bits, smallest, largest, lost, children


def signature_tree(bits: np.ndarray, sizes: np.ndarray) -> Node:
    """Over the rows of ``bits`` in their order."""
    lost = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    level = []
    for a in range(0, len(sizes), LEAF):
        own = slice(a, min(a + LEAF, len(sizes)))
        level.append(Node(a, own.stop, np.bitwise_or.reduce(bits[own]), int(sizes[own].min()), int(sizes[own].max()), int(lost[own].max())))
    while len(level) > 1:
        groups = [level[k : k + FAN] for k in range(0, len(level), FAN)]
        level = [Node(g[0].low, g[-1].high, np.bitwise_or.reduce([x.bits for x in g]), min(x.smallest for x in g), max(x.largest for x in g), max(x.lost for x in g), g) for g in groups]
    return level[0]


def possible(a: Node, b: Node) -> bool:
    """Whether a set below a and one below b can be linked.

    Linked sets differ in size by the similarity at most. Shingles that two sets share set bits that both nodes have; they
    number no more than those bits and the shingles that either set has beyond its bits.
    """
    if a.largest * DENOMINATOR < NUMERATOR * b.smallest or b.largest * DENOMINATOR < NUMERATOR * a.smallest:
        return False
    most = min(int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.lost, b.lost), a.largest, b.largest)
    return most >= required(a.smallest, b.smallest)


def leaf_pairs(a: Node, b: Node, same: bool) -> Iterator[tuple[Node, Node]]:
    """Pairs of leaves that both trees' traversal leaves over; within one tree each unordered pair once."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if same and y.low < x.low or not possible(x, y):
            continue
        if not x.children and not y.children:
            yield x, y
        elif not y.children or x.children and x.high - x.low >= y.high - y.low:
            todo += [(c, y) for c in x.children] if not (same and x is y) else [(c, d) for c in x.children for d in x.children if c.low <= d.low]
        else:
            todo += [(x, c) for c in y.children]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


class Block:
    """Sets sorted by size, then by their smallest shingles, so that like sets are near each other in the tree."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k][0], ids[k]))
        self.ids, self.sets = [int(ids[k]) for k in order], [sets[k] for k in order]
        self.sizes = np.array([len(s) for s in self.sets])

    def signatures(self, width: int) -> np.ndarray:
        bits = np.zeros((len(self.sets), width), bool)
        for k, s in enumerate(self.sets):
            bits[k, (s & np.uint64(width - 1)).astype(np.int64)] = True
        return np.packbits(bits, axis=1, bitorder="little")


def links(a: Block, b: Block | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of two blocks, or within one."""
    same = b is None
    b = a if same else b
    width = 64
    while width < 2 * max(a.sizes.max(), b.sizes.max()) and width < 1 << 14:
        width *= 2
    bits_a = a.signatures(width)
    bits_b = bits_a if same else b.signatures(width)
    tree_a = signature_tree(bits_a, a.sizes)
    tree_b = tree_a if same else signature_tree(bits_b, b.sizes)
    left: list[np.ndarray] = []
    for x, y in leaf_pairs(tree_a, tree_b, same):
        n, m = a.sizes[x.low : x.high, None], b.sizes[None, y.low : y.high]
        p, q = bits_a[x.low : x.high, None], bits_b[None, y.low : y.high]
        most = np.minimum(n - np.bitwise_count(p & ~q).sum(axis=2, dtype=np.int64), m - np.bitwise_count(q & ~p).sum(axis=2, dtype=np.int64))
        left.append(np.argwhere(most >= required(n, m)) + (x.low, y.low))
    pairs = np.concatenate(left) if left else np.empty((0, 2), np.int64)
    if same:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    shift, out = 0 if same else len(a.ids), []
    forest = Forest(len(a.ids) + (0 if same else len(b.ids)))
    if same and len(pairs):  # the set that may have most links first: what it is linked with needs no comparison any more
        centre = np.bincount(pairs.ravel()).argmax()
        pairs = np.concatenate([pairs[mine := (pairs == centre).any(axis=1)], pairs[~mine]])
    while len(pairs):
        part, pairs = pairs[:PAIRS], pairs[PAIRS:]
        roots = np.array([forest.root(x) for x in range(len(forest.up))])
        part = part[roots[part[:, 0]] != roots[part[:, 1] + shift]]
        shared = overlaps(a.sets, b.sets, part)
        for p, q in part[shared >= required(a.sizes[part[:, 0]], b.sizes[part[:, 1]])].tolist():
            x, y = forest.root(p), forest.root(q + shift)
            if x != y:
                forest.up[x] = y
                out.append((a.ids[p], b.ids[q]))
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[p] and b[q]: one by one, or for many pairs as a product of incidence matrices."""
    if len(pairs) <= 64:
        return np.array([overlap(a[p], b[q]) for p, q in pairs.tolist()], np.int64)
    rows, cols = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
    own_a, own_b = np.concatenate([a[p] for p in rows]), np.concatenate([b[q] for q in cols])
    both = np.intersect1d(own_a, own_b)
    total = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(both), 8192):
        part = both[at : at + 8192]
        x, y = _incidence([a[p] for p in rows], part), _incidence([b[q] for q in cols], part)
        total += x @ y.T
    return total[np.searchsorted(rows, pairs[:, 0]), np.searchsorted(cols, pairs[:, 1])].astype(np.int64)


def _incidence(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(words)), np.float32)
    if len(words):
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(words, s), len(words) - 1)
            out[k, at[words[at] == s]] = 1
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (unit, side, id, text) sorted by unit: links of each unit. Sides 0 and 1 are the two blocks."""
    for b in runs(batches, "unit"):
        unit = b["unit"].to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(b)]
        out = []
        for begin, end in zip(cuts, cuts[1:]):
            own = b.iloc[begin:end]
            sets = [s for _, part in chunks(own["text"]) for s in shingle_sets(part)]
            side, ids = own["side"].to_numpy(), own["id"].to_numpy()
            blocks = [Block(ids[side == k], [s for s, x in zip(sets, side) if x == k]) for k in (0, 1) if (side == k).any()]
            out += links(blocks[0], blocks[1] if len(blocks) > 1 else None)
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])


def _roots(df: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """``df`` with the root of the node in ``column``, which is the node itself if ``roots`` does not have it."""
    own = roots.select(F.col("node").alias("cachesight_node"), F.col("root").alias(name))
    return df.hint("merge").join(own, df[column] == own["cachesight_node"], "left").drop("cachesight_node").withColumn(name, F.coalesce(name, column))


def _blocks(n: str | int, shingles: str | int):
    return F.ceil(F.greatest(n / F.lit(BLOCK), shingles / F.lit(SHINGLES))).cast("int")


def _joined(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) in units (unit, side, node): trees over sides 0 and 1, or over side 0 alone, are traversed together."""
    dealt = units.hint("merge").join(texts, "node").select("unit", "side", F.col("node").alias("id"), "text")
    dealt = dealt.repartition(partitions(texts.sparkSession), "unit").sortWithinPartitions("unit", "side", "id")
    return dealt.mapInPandas(tidy(_verify), "u long, v long")


def _leader_units(ties: DataFrame) -> DataFrame:
    """(unit, side, node): each leader with the classes that are tied to it more often than to others."""
    often = Window.partitionBy("u").orderBy(F.desc("ties"), "v")
    chosen = ties.withColumn("k", F.row_number().over(often)).where(F.col("k") <= LEADERS)
    parts = chosen.groupBy("v").agg(_blocks(F.count("*"), F.sum("n")).alias("parts"))
    led = chosen.hint("merge").join(parts, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), "parts").alias("part"))
    leaders = parts.select(F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"))
    return led.unionByName(leaders).select("node", F.xxhash64("v", "part").alias("unit"), F.lit(0).alias("side"))


def _region_units(members: DataFrame) -> DataFrame:
    """(unit, side, node) from (node, n, component, region): pairs of blocks of a region but those of its largest component."""
    sizes = members.groupBy("region", "component").agg(F.count("*").alias("count"))
    main = sizes.groupBy("region").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"))
    # sets of one range differ by less than sets that can be linked, so those are in the same range or neighbouring ones
    ranged = members.hint("merge").join(main, "region").select("node", "n", "region", (F.col("component") == F.col("main")).cast("int").alias("kind"), F.floor(F.log(F.col("n")) / F.lit(math.log(1.34))).cast("int").alias("range"))
    counts = lambda k: F.coalesce(_blocks(F.count_if(F.col("kind") == k), F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))), F.lit(0))
    layout = ranged.groupBy("region", "range").agg(counts(0).alias("apart"), counts(1).alias("main"))
    layout = layout.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("range", F.struct("apart", "main")))).alias("layout"))  # as many as ranges
    placed = ranged.hint("merge").join(layout, "region")
    here = F.col("layout")[F.col("range")]
    own = F.struct("range", "kind", F.pmod(F.xxhash64("node"), F.when(F.col("kind") == 0, here["apart"]).otherwise(here["main"])).cast("int").alias("block"))

    def blocks(d, kind: int):
        n = F.coalesce(F.col("layout")[F.col("range") + d]["apart" if kind == 0 else "main"], F.lit(0))
        made = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct((F.col("range") + d).alias("range"), F.lit(kind).alias("kind"), x.alias("block")))
        return F.when(n > 0, made).otherwise(F.array().cast("array<struct<range:int,kind:int,block:int>>"))

    near = (-1, 0, 1)
    partners = F.concat(*[blocks(d, 0) for d in near], *[F.when(F.col("kind") == 0, blocks(d, 1)).otherwise(F.array()) for d in near])
    exploded = placed.select("node", "region", own.alias("own"), F.explode(partners).alias("partner"))
    unit = F.xxhash64("region", F.least("own", "partner"), F.greatest("own", "partner"))
    return exploded.select("node", unit.alias("unit"), (F.col("own") > F.col("partner")).cast("int").alias("side"))


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text), n_shingles and component_id of each row."""
    spark = docs.sparkSession
    described = materialize(describe(docs), "described")
    members = described.select("doc_id", "content", "n_shingles", "digest")
    sets = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = described.where(sets).groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("doc_id IS NOT NULL")
    banded = classes.select(F.explode("bands").alias("key"), "n", "id")
    ties = banded.repartition(partitions(spark), "key").sortWithinPartitions("key", "n", "id").mapInPandas(tidy(_bucket_ties), "u long, v long, n long")
    ties = materialize(ties.where("u <> v").groupBy("u", "v").agg(F.count("*").alias("ties"), F.max("n").alias("n")), "ties")
    first = connected_components(_joined(_leader_units(ties), texts), "first")
    apart = _roots(_roots(ties.select("u", "v"), "u", first, "a"), "v", first, "b").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    regions = connected_components(apart, "regions")
    regions = regions.unionByName(regions.select(F.col("root").alias("node"), "root").distinct())
    of_class = _roots(classes.select(F.col("id").alias("node"), "n"), "node", first, "component")
    inside = materialize(of_class.hint("merge").join(regions.select(F.col("node").alias("component"), F.col("root").alias("region")), "component"), "regions")
    more = _joined(_region_units(inside), texts)
    more = _roots(_roots(more, "u", first, "a"), "v", first, "b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    last = connected_components(more, "last")
    named = _roots(_roots(classes.select("digest", "id"), "id", first, "component"), "component", last, "component_id")
    joined = members.where(sets).join(named.select("digest", "component_id"), "digest").select("doc_id", "content", "n_shingles", "component_id")
    alone = members.where(~sets).select("doc_id", "content", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    A text with fewer than five words is one shingle; a text without words, or null, has none and links with nothing. A row with
    a null id links with nothing either, and its component_id is null. Texts that share an id are one node, which has
    the links of each. Groups of equal sets are one class from the start, however large. A block's texts are held in one task, with about
    100 bytes for each byte of the longest.
    """
    return _components(docs).drop("content")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows with a null id stay, and of rows that share an
    id those whose text is not of an other document's component."""
    gone = _components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("cachesight_id"), F.col("content").alias("cachesight_content")).distinct()
    same = (docs["doc_id"] == gone["cachesight_id"]) & (F.xxhash64(docs["text"]) == gone["cachesight_content"])
    return docs.hint("merge").join(gone, same, "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
