"""Merkle manifest of a dataset: a root, a subtree for each group, a proof for each document.

1. A document's leaf is hashed where its row is read; texts cross no shuffle. Equal rows are counted, not repeated.
2. Ranks in a group: histograms over the digits of doc_id, from the finest prefix up to the whole group. A prefix starts behind
   its parent's start and its smaller siblings, of which there are at most 2^14; rows are ranked among those of their finest
   prefix alone. No rows are sorted as a whole. Where many rows share the finest prefix, as with one repeated or null id,
   the digits of their leaves go on.
3. A trie over the digits of the ranks, base FANOUT: one shuffle brings the ranks of a prefix of LEVELS digits together, where
   the longest prefixes are reduced first, each node keeping its children. Its tops are the leaves of the next trie.
4. Groups are ranked in their order, their tops reduced likewise. Then tries are unfolded from the root down, and each document
   meets the siblings on its path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.llm.common import materialize, partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Digits of a rank that one shuffle reduces: at most FANOUT^LEVELS nodes a row.
LEVELS = 3
#: Low bits of doc_id below each prefix that is counted.
SHIFTS = (50, 36, 22, 9)
#: Different rows of a finest prefix beyond which their leaves' digits tell them apart; hexadecimal digits of a leaf.
FULL, LEAF_DIGITS = 1 << 14, 3
GROUP = ["known", "name"]


def digest(*inputs: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated inputs."""
    return F.sha2(F.concat(*inputs), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang") -> DataFrame:
    """known and name (the group), doc_id, leaf, tampered (the leaf with the text in lower case, or null) and ``copies`` of each
    different row. Of equal leaves all that is hashed is equal, so the counts stand for the rows."""
    hashed = lambda text: digest(*[framed(text if f == "text" else F.col(f)) for f in fields])
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col("doc_id").cast("long").alias("doc_id"), hashed(F.col("text")).alias("leaf"), F.when(tamper, hashed(F.translate("text", UPPER, LOWER))).alias("tampered"))
    return rows.groupBy(*GROUP, "doc_id", "leaf").agg(F.first("tampered").alias("tampered"), F.count("*").alias("copies"))


def _starts(counts: DataFrame, keys: list[list[str]]) -> DataFrame:
    """``start`` of each row of ``counts`` (all of ``keys``, n) in its group (the first of them), by histograms level by level.

    ``keys`` are the columns of the prefixes from the coarsest to the finest: a prefix's own columns, beside those before.
    """
    levels = [counts]
    for k in range(len(keys) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*[c for own in keys[:k] for c in own]).agg(F.sum("n").alias("n")))
    out = levels[-1].withColumn("start", F.lit(0).cast("long"))
    for k, level in enumerate(reversed(levels[:-1]), 1):
        parent = [c for own in keys[:k] for c in own]
        before = Window.partitionBy(*parent).orderBy(*keys[k]).rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
        up = out.select(*[F.col(c).alias(f"up_{c}") for c in parent], F.col("start").alias("up_start"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"up_{c}") for c in parent])
        out = inside.join(up, same).select(*[c for own in keys[: k + 1] for c in own], "n", (F.col("up_start") + F.col("inside")).alias("start"))
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of ``leaves`` with ``rank``, from 0, of the first copy in its group by doc_id (null first) and leaf."""
    digits = {f"p{s}": F.when(F.col("doc_id").isNotNull(), F.shiftright("doc_id", s)) for s in SHIFTS}
    low = SHIFTS[-1]
    rows = rows.withColumn("has_id", F.col("doc_id").isNotNull()).withColumns({k: F.coalesce(v, F.lit(0)) for k, v in digits.items()})
    prefixes = [GROUP, ["has_id"], *[[k] for k in digits]]
    finest = [c for own in prefixes for c in own]
    full = rows.groupBy(*finest).agg(F.count("*").alias("different")).where(F.col("different") > FULL).select(*[F.col(c).alias(f"full_{c}") for c in finest])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"full_{c}") for c in finest])
    marked = rows.join(full, same, "left")  # few prefixes are full; a hot one is on the row's side, where Spark may split it
    is_full = F.col("full_name").isNotNull()
    own = F.coalesce(F.col("doc_id"), F.lit(0)) - F.shiftleft(F.col(f"p{low}"), low)
    marked = marked.withColumn("own", F.when(is_full, own).otherwise(0)).withColumn("leaf_digits", F.when(is_full, F.substring("leaf", 1, LEAF_DIGITS)).otherwise("")).select(*rows.columns, "own", "leaf_digits")
    keys = [*prefixes, ["own"], ["leaf_digits"]]
    cells = [c for k in keys for c in k]
    counts = materialize(marked.groupBy(*cells).agg(F.sum("copies").alias("n")), "counts")
    starts = _starts(counts, keys).drop("n")
    before = Window.partitionBy(*cells).orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("inside", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    up = starts.select(*[F.col(c).alias(f"up_{c}") for c in cells], "start")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"up_{c}") for c in cells])
    return inside.join(up, same).select(*GROUP, "doc_id", "leaf", "tampered", "copies", (F.col("start") + F.col("inside")).alias("rank"))


def _tries(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(known, name, n, i, digest, kids) from nodes (known, name, n, i, digest, ``extra``) of groups of n nodes: one row for each
    run of FANOUT^LEVELS, whose ``kids`` hold their own. A level above a single node changes nothing, it has none."""
    out = nodes.select(*GROUP, "n", F.shiftright("i", FANOUT_BITS * LEVELS).alias("top"), "i", "digest", *extra)
    out = out.repartition(partitions(nodes.sparkSession), *GROUP, "top")
    for level in range(LEVELS):
        held = F.sort_array(F.collect_list(F.struct("i", "digest", *(extra if level == 0 else ["kids"]))))
        out = out.groupBy(*GROUP, "n", "top", F.shiftright("i", FANOUT_BITS).alias("i")).agg(held.alias("kids"))
        more = F.col("n") > F.lit(FANOUT**level)
        out = out.withColumn("digest", F.when(more, F.sha2(F.array_join("kids.digest", ""), 256)).otherwise(F.col("kids")[0]["digest"]))
    return out.select(*GROUP, "n", "i", "digest", "kids")


def _unfolded(tries: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes (known, name, i, digest, ``extra``, path) from tries with the ``path`` above them. A step of a path is what is left
    and right of the own digest in its run."""
    out = tries
    for level in reversed(range(LEVELS)):
        more = F.col("n") > F.lit(FANOUT**level)
        digests = F.col("kids.digest")
        step = lambda at, d=digests: F.struct(F.array_join(F.slice(d, 1, at), "").alias("left"), F.array_join(F.slice(d, at + 2, FANOUT), "").alias("right"))
        out = out.select(*GROUP, "n", "kids", "path", F.posexplode("kids").alias("at", "kid"))
        path = F.when(more, F.concat(F.array(step(F.col("at"))), F.col("path"))).otherwise(F.col("path"))
        own = ["i", "digest", *(extra if level == 0 else ["kids"])]
        out = out.select(*GROUP, "n", path.alias("path"), *[F.col("kid")[c].alias(c) for c in own])
    return out


def _tower(nodes: DataFrame, most: int, extra: list[str], name: str) -> list[DataFrame]:
    """Tries over tries until groups of at most ``most`` nodes are one node each; each written to the shared folder."""
    out = []
    while not out or most > 1:
        out.append(materialize(_tries(nodes, extra if not out else []), name))
        most = -(-most // FANOUT**LEVELS)
        nodes = out[-1].select(*GROUP, F.ceil(F.col("n") / F.lit(FANOUT**LEVELS)).cast("long").alias("n"), "i", "digest")
    return out


def _down(tower: list[DataFrame], paths: DataFrame, extra: list[str]) -> DataFrame:
    """The first nodes of a tower with their paths; ``paths`` are those of the groups (known, name, path)."""
    above = paths.withColumn("up_i", F.lit(0).cast("long"))
    for k, tries in reversed(list(enumerate(tower))):
        up = above.select(F.col("known").alias("up_known"), F.col("name").alias("up_name"), "up_i", "path")
        same = (F.col("known") == F.col("up_known")) & (F.col("name") == F.col("up_name")) & (F.col("i") == F.col("up_i"))
        nodes = _unfolded(tries.hint("merge").join(up, same).select(*GROUP, "n", "kids", "path"), extra if k == 0 else [])
        above = nodes.withColumnRenamed("i", "up_i") if k else nodes
    return above


def _in_order(groups: DataFrame) -> DataFrame:
    """``groups`` with ``i``, from 0, their place in order: ranges by name, places in a range, sums of the ranges before."""
    n = partitions(groups.sparkSession)
    placed = groups.repartitionByRange(n, "known", "name").sortWithinPartitions("known", "name").withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "groups")
    counts = placed.groupBy("range").agg(F.count("*").alias("count"))  # one row for each partition
    start = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.withColumn("start", start).drop("count")), "range").withColumn("i", F.col("start") + F.col("place")).drop("range", "place", "start")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang") -> DataFrame:
    """For each row of ``docs``: doc_id, leaf, subroot (its group's), root, proof_sha256, folded_root and verified.

    A null in any hashed column counts as ``-``; a null group is a group, the first. Null ids come first in their group,
    rows of one id go by their leaves, and equal rows follow each other, each with its own place and proof. Null ids are not
    tampered with. An empty table has no rows and no root.
    """
    extra = ["doc_id", "tampered"]
    own = materialize(ranked(materialize(leaves(docs, fields, group), "leaves")), "ranks")
    sizes = own.groupBy(*GROUP).agg(F.sum("copies").alias("n"))
    most, langs = sizes.agg(F.max("n"), F.count("*")).first()
    run = FANOUT**LEVELS
    # a row that has many copies goes to each run of ranks that they reach, and is repeated there
    last = F.col("rank") + F.col("copies") - 1
    dealt = own.withColumn("run", F.explode(F.sequence(F.floor(F.col("rank") / run), F.floor(last / run))))
    dealt = dealt.withColumn("from", F.greatest("rank", F.col("run") * run)).withColumn("to", F.least(last, F.col("run") * run + run - 1)).join(F.broadcast(sizes) if langs <= 1000 else sizes, GROUP)
    dealt = dealt.repartition(partitions(docs.sparkSession), *GROUP, "run")
    nodes = dealt.select(*GROUP, "n", F.explode(F.sequence("from", "to")).alias("i"), F.col("leaf").alias("digest"), *extra)
    tower = _tower(nodes, most or 1, extra, "trie")
    n = F.lit(langs).cast("long")
    tops = _in_order(tower[-1].select(*GROUP, "digest"))
    subroots = tops.select(F.lit(True).alias("known"), F.lit("").alias("name"), n.alias("n"), "i", "digest", F.col("known").alias("group_known"), F.col("name").alias("group_name"))
    upper = _tower(subroots, langs, ["group_known", "group_name"], "roots")
    root = upper[-1].select(F.col("digest").alias("root"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    of_group = _down(upper, docs.sparkSession.createDataFrame([(True, "")], "known boolean, name string").withColumn("path", none), ["group_known", "group_name"])
    of_group = materialize(of_group.crossJoin(F.broadcast(root)).select(F.col("group_known").alias("known"), F.col("group_name").alias("name"), F.col("digest").alias("subroot"), "root", "path"), "paths")  # one root
    found = _down(tower, of_group.select("known", "name", "path"), extra)
    roots = of_group.select("known", "name", "subroot", "root")
    found = found.join(F.broadcast(roots) if langs <= 1000 else roots, GROUP)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda below, x: F.sha2(F.concat(x["left"], below, x["right"]), 256))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS))


def _sql(depth: int) -> str:
    """Levels one by one; ``depth`` of them hold 8^depth documents a language, and languages."""
    framed = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda t: f"sha256({' || '.join(framed(t if f == 'text' else f) for f in FIELDS)})"
    shift = "list_reduce(list_prepend({0}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: {shift.format('xor(r, c)')}), 4294967295)"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""d AS (SELECT row_number() OVER () AS row, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS folded0 FROM documents),
s0 AS (SELECT row, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce('=' || lang, '') AS g, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d)"""]

    def levels(s: str) -> None:
        for k in range(1, depth + 1):
            parts.append(f"""{s}r{k} AS (SELECT g, n, i // 8 AS i, list(h ORDER BY i) AS kids FROM {s}{k - 1} GROUP BY g, n, i // 8),
{s}{k} AS (SELECT i, g, n, CASE WHEN n > {8 ** (k - 1)} THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS h FROM {s}r{k})""")

    def paths(s: str, start: str, row: str) -> str:
        joins, left, right = [], [], []
        for k in range(1, depth + 1):
            joins.append(f"JOIN {s}r{k} AS {s}j{k} ON {s}j{k}.g = b.g AND {s}j{k}.i = b.i // {8**k}")
            at = f"((b.i // {8 ** (k - 1)}) % 8)"
            more = f"b.n > {8 ** (k - 1)}"
            left.append(f"CASE WHEN {more} THEN array_to_string({s}j{k}.kids[1:{at}], '') END")
            right.append(f"CASE WHEN {more} THEN array_to_string({s}j{k}.kids[{at} + 2:8], '') END")
        return f"SELECT {row} AS key, [{', '.join(left)}] AS l, [{', '.join(right)}] AS r FROM {start} AS b {' '.join(joins)}"

    levels("s")
    parts.append(f"t0 AS (SELECT NULL AS row, row_number() OVER (ORDER BY g) - 1 AS i, 'all' AS g, count(*) OVER () AS n, h, g AS own FROM s{depth})")
    levels("t")
    parts.append(f"low AS ({paths('s', 's0', 'row')})")
    parts.append(f"high AS ({paths('t', 't0', 'own')})")
    parts.append(f"""joined AS (SELECT s0.row, t0.h AS subroot, t{depth}.h AS root, list_filter(list_zip(low.l || high.l, low.r || high.r), lambda x: x[1] IS NOT NULL) AS path
FROM s0 JOIN low ON low.key = s0.row JOIN high ON high.key = s0.g JOIN t0 ON t0.own = s0.g, t{depth})""")
    fold = "list_reduce(list_prepend({'left': folded0, 'right': ''}, list_transform(path, lambda x: {'left': x[1], 'right': x[2]})), lambda a, x: {'left': sha256(x.\"left\" || a.\"left\" || x.\"right\"), 'right': ''}).\"left\""
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[1] || x[2]), '')) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified
FROM d JOIN joined USING (row)"""


OP13_SQL = _sql(7)
