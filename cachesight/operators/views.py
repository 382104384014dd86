"""Views derived from the candidate relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachesight.functions.scalars import odd_hash, text_key
from cachesight.schema import DECISION_KEY, FEATURES, LABELS
from cachesight.sources.shared import materialize
from cachesight.sources.tables import strict_join

METHOD = "sha256-parity-v1"


def own():
    """The window of a decision's rows."""
    return Window.partitionBy(*DECISION_KEY)


def attach_regret(candidates: DataFrame) -> DataFrame:
    """Adds regret: y_loss above the least of the decision. One shuffle, which a following group-by on the key shares."""
    return candidates.withColumn("regret", F.col("y_loss") - F.min("y_loss").over(own()))


def decision_view(candidates: DataFrame) -> DataFrame:
    """One row a decision: counts, least loss, optimal pages in order of their names, and the regret's moments."""
    best = F.col("regret") == 0
    return attach_regret(candidates.select(*DECISION_KEY, "candidate_page_id", *LABELS)).groupBy(*DECISION_KEY).agg(
        F.count("*").alias("candidate_count"), F.min("y_loss").alias("min_y_loss"), F.max("y_value").alias("max_y_value"),
        F.array_join(F.array_sort(F.collect_list(F.when(best, F.col("candidate_page_id")))), "|").alias("optimal_candidate_page_ids"),
        F.count_if(best).alias("optimal_candidate_count"), F.count_if(best).alias("tie_count"), F.avg("regret").alias("regret_mean"),
        F.stddev_pop("regret").alias("regret_std"), F.max("regret").alias("regret_max"), F.sum("regret").alias("regret_sum"),
    )


def _oriented(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (lo, hi) of structs as sides a and b by the parity of a hash of the decision and both pages."""
    swap = odd_hash(*[F.col(c) for c in DECISION_KEY], F.col("lo.candidate_page_id"), F.col("hi.candidate_page_id"), F.lit(METHOD))
    a, b = F.when(swap, F.col("hi")).otherwise(F.col("lo")), F.when(swap, F.col("lo")).otherwise(F.col("hi"))
    sided = pairs.select(*DECISION_KEY, a.alias("a"), b.alias("b"))
    ra, rb = F.col("a.regret"), F.col("b.regret")
    return sided.select(
        *DECISION_KEY, F.col("a.candidate_page_id").alias("candidate_a_page_id"), F.col("b.candidate_page_id").alias("candidate_b_page_id"),
        *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in columns], ra.alias("regret_a"), rb.alias("regret_b"), (ra - rb).alias("regret_diff_a_minus_b"),
        (ra < rb).cast("int").alias("label_a_better"), (rb < ra).cast("int").alias("label_b_better"), (ra == rb).cast("int").alias("is_tie"),
    )


def pairwise_view(candidates: DataFrame, include_ties: bool = False) -> DataFrame:
    """All unordered pairs of each decision. A decision has at most ``capacity`` candidates, which bounds its pairs."""
    columns = ["candidate_page_id", *LABELS, *FEATURES]
    side = attach_regret(candidates).select(*DECISION_KEY, F.struct(*columns, "regret").alias("x"))
    pairs = side.withColumnRenamed("x", "lo").join(side.withColumnRenamed("x", "hi"), DECISION_KEY).where("lo.candidate_page_id < hi.candidate_page_id")
    out = _oriented(pairs, columns)
    return out if include_ties else out.where("is_tie = 0")


def pairwise_sample(candidates: DataFrame, rows: int, per_decision: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` pairs: the first ``per_decision`` pairs, by page names, of decisions drawn by a seeded hash; ties stay.

    Only the ``per_decision`` + 1 smallest pages of a decision can appear in its first pairs, so the self-join sees no more.
    """
    decisions = candidates.select(*DECISION_KEY).distinct()
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), text_key(*DECISION_KEY)), 256)
    wanted = -(-rows // per_decision)
    drawn = decisions.orderBy(draw, *DECISION_KEY).limit(wanted)
    rows_drawn = attach_regret(candidates.select(*DECISION_KEY, "candidate_page_id", "y_loss").join(drawn, DECISION_KEY, "left_semi"))
    near = rows_drawn.withColumn("r", F.row_number().over(own().orderBy("candidate_page_id"))).where(F.col("r") <= per_decision + 1)
    side = near.select(*DECISION_KEY, F.struct("candidate_page_id", "y_loss", "regret").alias("x"))
    pairs = side.withColumnRenamed("x", "lo").join(side.withColumnRenamed("x", "hi"), DECISION_KEY).where("lo.candidate_page_id < hi.candidate_page_id")
    kept = pairs.withColumn("k", F.row_number().over(own().orderBy("lo.candidate_page_id", "hi.candidate_page_id"))).where(F.col("k") <= per_decision)
    low, high = F.least("candidate_a_page_id", "candidate_b_page_id"), F.greatest("candidate_a_page_id", "candidate_b_page_id")
    return _oriented(kept.drop("k"), ["y_loss"]).orderBy(*DECISION_KEY, low, high).limit(rows)


def augment_pairs(pairs: DataFrame, candidates: DataFrame, features: list[str]) -> DataFrame:
    """``pairs`` with the features of both sides. A page that a decision lists twice, or not at all, raises.

    Only candidates of the pairs' decisions are grouped, and once for both sides; Spark broadcasts the decisions if they are few.
    """
    out = pairs
    needed = candidates.select(*DECISION_KEY, "candidate_page_id", *features).join(pairs.select(*DECISION_KEY).distinct(), DECISION_KEY, "left_semi")
    for s in "ab":
        one = needed.groupBy(*DECISION_KEY, F.col("candidate_page_id").alias(f"candidate_{s}_page_id")).agg(F.count("*").alias("copies"), *[F.first(c).alias(f"{c}_{s}") for c in features])
        fault = F.when(F.col("copies") == 1, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("pages matched: "), F.coalesce(F.col("copies"), F.lit(0)).cast("string"))))
        joined = out.join(one, [*DECISION_KEY, f"candidate_{s}_page_id"], "left")
        out = joined.where(fault.cast("string").isNull()).drop("copies")
    return out


def matched_population(candidates: DataFrame, horizon: int) -> DataFrame:
    """Physical decisions (all of the key but the horizon) that ``horizon`` has, with the horizons that share them."""
    physical = [c for c in DECISION_KEY if c != "horizon"]
    horizons = candidates.select(*physical, "horizon").distinct().groupBy(*physical).agg(F.array_sort(F.collect_list("horizon")).alias("horizons"))
    return horizons.where(F.array_contains("horizons", horizon))


def population_digests(candidates: DataFrame) -> DataFrame:
    """Of each (family, capacity): decisions and a digest that does not depend on their order."""
    keys = candidates.select("trace_family", "capacity", text_key(*DECISION_KEY).alias("k")).distinct()
    digest = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.substring(F.sha2("k", 256), 1, 16)))), 256)
    return keys.groupBy("trace_family", "capacity").agg(F.count("*").alias("decisions"), digest.alias("digest"))


def split_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("split", "trace_family", "capacity", "horizon").agg(F.count("*").alias("row_count"), F.count_distinct("decision_id").alias("decision_count"))


def split_summary_runs(ordered: DataFrame, order: list[str]) -> DataFrame:
    """As ``split_summary``, but decision_count counts changes of decision_id between rows that follow each other."""
    group = ["split", "trace_family", "capacity", "horizon"]
    before = F.lag("decision_id").over(Window.partitionBy(*group).orderBy(*order))
    changes = ordered.withColumn("new", (~before.eqNullSafe(F.col("decision_id"))).cast("long"))
    return changes.groupBy(*group).agg(F.count("*").alias("row_count"), F.sum("new").alias("decision_count"))


def linkage(victims: DataFrame, drawn: DataFrame, closed: DataFrame, cell: list[str]) -> DataFrame:
    """Offline regrets of each ``cell`` (family, capacity, horizon) beside the closed loop's miss ratios of its family and capacity.

    ``victims`` has offline_lru_regret and offline_mru_regret, ``drawn`` offline_random_regret, ``closed`` lru_, mru_ and
    random_miss_ratio, which hold for each horizon. A cell that is not once in each source raises (``strict_join``). Gaps are
    against the least-recently-used policy; a cell whose regrets are all 0 is degenerate.
    """
    horizons = victims.select(*cell[:2], *cell[2:]).unionByName(drawn.select(*cell)).select(*cell[2:]).distinct()
    each = closed.crossJoin(F.broadcast(horizons))  # a handful of horizons
    rows = strict_join({"victims": victims, "drawn": drawn, "closed": each}, cell)
    gap = lambda a, b: F.round(F.col(a) - F.col(b), 9)
    gaps = {"offline_mru_gap": gap("offline_mru_regret", "offline_lru_regret"), "offline_random_gap": gap("offline_random_regret", "offline_lru_regret"), "closed_mru_gap": gap("mru_miss_ratio", "lru_miss_ratio"), "closed_random_gap": gap("random_miss_ratio", "lru_miss_ratio")}
    agrees = lambda k: F.signum(f"offline_{k}_gap") == F.signum(f"closed_{k}_gap")
    zero = (F.col("offline_lru_regret") == 0) & (F.col("offline_mru_regret") == 0) & (F.col("offline_random_regret") == 0)
    return rows.withColumns(gaps).withColumns({"mru_agrees": agrees("mru"), "random_agrees": agrees("random"), "degenerate": zero})


def clean_pair_features(pairs: DataFrame, candidates: DataFrame, features: list[str]) -> DataFrame:
    """``pairs`` with ``features`` of both sides as a_ and b_ columns, joined on trace, capacity, horizon, decision and page alone.

    The key is narrower than that of ``augment_pairs``: a page that it matches twice gives two rows, one that it does not match
    none. Candidates are read once: both sides of all pairs are looked up together, and what was found, which is as small as the
    pairs are, is joined by pair.
    """
    key = ["trace_name", "capacity", "horizon", "decision_id"]
    kept = ["decision_id", "capacity", "horizon", "split", "trace_family", "label_a_better", "label_b_better", "is_tie"]
    numbered = pairs.withColumn("pair", F.sha2(text_key(*DECISION_KEY, "candidate_a_page_id", "candidate_b_page_id"), 256))
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"candidate_{x}_page_id").alias("candidate_page_id")) for x in "ab"])
    wanted = numbered.select(*key, "pair", F.explode(sides).alias("p")).select(*key, "pair", "p.*").distinct()
    found = materialize(candidates.select(*key, "candidate_page_id", *features).join(wanted, [*key, "candidate_page_id"]).select("pair", "side", *features), "sides")
    out = numbered.select("pair", *kept)
    for x in "ab":
        out = out.join(found.where(F.col("side") == x).select("pair", *[F.col(c).alias(f"{x}_{c}") for c in features]), "pair")
    return out.drop("pair")


def pair_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs of ``a`` and of ``b`` whatever the order of their pages, how many rows both join to, and their share of a's.

    Rows of equal pairs are counted before the join, so repeated pairs cost nothing.
    """
    key = F.concat_ws("|", text_key("trace_name", "capacity", "horizon", "decision_id", "split"), F.least("candidate_a_page_id", "candidate_b_page_id"), F.greatest("candidate_a_page_id", "candidate_b_page_id"))
    x, y = (df.groupBy(key.alias("k")).agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    both = x.join(y, "k", "full_outer").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("na"), "a_pairs"), (F.col("nb"), "b_pairs"), (F.col("na") * F.col("nb"), "overlap"))])
    same = (F.col("overlap") == F.col("a_pairs")) & (F.col("a_pairs") == F.col("b_pairs"))
    return both.withColumn("overlap_fraction", F.round(F.try_divide(F.col("overlap"), F.col("a_pairs")), 9)).withColumn("same_pairs", same)


def with_suffixes(left: DataFrame, right: DataFrame, key: list[str], suffixes: tuple[str, str] = ("", "_old")) -> DataFrame:
    """The rows of both of equal ``key``; other columns that both have get a suffix on either side."""
    clash = (set(left.columns) & set(right.columns)) - set(key)
    named = [df.select(*[F.col(c).alias(f"{c}{s}") if c in clash else F.col(c) for c in df.columns]) for df, s in zip((left, right), suffixes)]
    return named[0].join(named[1], key)


#: Policies that are compared with the least-recently-used one, with their gaps offline and in the closed loop.
LINKED = ("mru", "random")


def linkage_gaps(linked: DataFrame) -> DataFrame:
    """``linkage`` as a row for each policy: its gap offline (x) and in the closed loop (y)."""
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"offline_{p}_gap").alias("x"), F.col(f"closed_{p}_gap").alias("y")) for p in LINKED])
    return linked.select("trace_family", "capacity", "horizon", "degenerate", F.explode(each).alias("p")).select("trace_family", "capacity", "horizon", "degenerate", "p.*")


def linkage_ranks(linked: DataFrame) -> DataFrame:
    """Of each cell the policies as candidates with their gaps (x offline, y in the closed loop); the one that is compared with has 0."""
    own = [F.struct(F.lit("lru").alias("policy"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))]
    own += [F.struct(F.lit(p).alias("policy"), F.col(f"offline_{p}_gap").alias("x"), F.col(f"closed_{p}_gap").alias("y")) for p in LINKED]
    return linked.select("trace_family", "capacity", "horizon", F.explode(F.array(*own)).alias("p")).select("trace_family", "capacity", "horizon", "p.*")
