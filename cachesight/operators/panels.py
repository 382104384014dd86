"""Aggregate panels over decisions, candidates and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachesight.functions.scalars import finite, safe_ratio, text_key
from cachesight.operators.views import attach_regret
from cachesight.schema import DECISION_KEY


def nontrivial() -> dict[str, Column]:
    """Named subsets of decisions that are not trivial. Their names and thresholds."""
    best, n = F.col("optimal_candidate_count"), F.col("candidate_count")
    return {
        "not_all_tied": best < n,
        "unique_optimal_victim": best == 1,
        "optimal_set_fraction_le_0.5": best / n <= 0.5,
        "loss_range_ge_1": F.col("regret_max") >= 1,
        "loss_range_ge_2": F.col("regret_max") >= 2,
        "random_expected_regret_ge_0.1": F.col("regret_mean") >= 0.1,
        "random_expected_regret_ge_0.5": F.col("regret_mean") >= 0.5,
        "random_expected_regret_ge_1": F.col("regret_mean") >= 1.0,
    }


def _panel() -> list[Column]:
    n, best = F.col("candidate_count"), F.col("optimal_candidate_count")
    return [
        F.count("*").alias("decisions"), F.sum("candidate_count").alias("candidates"), F.count_if(F.col("regret_max") == 0).alias("all_tied"),
        F.round(F.avg((F.col("regret_max") == 0).cast("double")), 9).alias("all_tied_fraction"), F.round(F.avg(best / n), 9).alias("random_optimal_probability"),
        F.round(F.sum("optimal_candidate_count") / F.sum("candidate_count"), 9).alias("optimal_share_by_candidate"), F.round(F.avg("regret_mean"), 9).alias("random_regret"),
        F.round(F.sum("regret_sum") / F.sum("candidate_count"), 9).alias("regret_by_candidate"), F.max("regret_max").alias("regret_max"),
        F.round(F.avg("regret_max"), 9).alias("mean_regret_max"), F.round(F.percentile("regret_mean", 0.5), 9).alias("median_regret_mean"),
        F.round(F.percentile("regret_mean", 0.9), 9).alias("p90_regret_mean"), F.count_if(best == 1).alias("single_optimum"), F.round(F.avg("optimal_candidate_count"), 9).alias("mean_optimal_count"),
        F.round(F.avg((best == 1).cast("double")), 9).alias("single_optimum_fraction"), F.round(F.percentile(best / n, 0.5), 9).alias("median_optimal_fraction"),
        F.round(F.percentile("regret_mean", 0.95), 9).alias("p95_regret_mean"), F.round(F.percentile("regret_mean", 0.99), 9).alias("p99_regret_mean"),
        F.round(F.avg((F.col("regret_max") >= 1).cast("double")), 9).alias("loss_range_ge_1"), F.round(F.avg((F.col("regret_max") >= 2).cast("double")), 9).alias("loss_range_ge_2"),
        F.round(F.avg((n - best) / n), 9).alias("random_regret_probability"),
    ]


def discriminativeness(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How far decisions tell candidates apart, overall or by ``by``: means by decision beside means by candidate."""
    return decisions.groupBy(*(by or [])).agg(*_panel())


def discriminativeness_sets(decisions: DataFrame, by: list[str]) -> DataFrame:
    """The same for the whole and for each stratum in one pass; the whole has nulls in ``by``."""
    return decisions.groupingSets([[], [F.col(c) for c in by]], *[F.col(c) for c in by]).agg(*_panel())


def nontrivial_subsets(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each named subset's size, share of decisions and of candidates, and mean and median regret; a decision is expanded into the
    subsets that hold it."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in nontrivial().items()]))
    by = by or []
    held = decisions.select(*by, "regret_mean", "candidate_count", F.explode(names).alias("subset"))
    out = held.groupBy(*by, "subset").agg(F.count("*").alias("decisions"), F.sum("candidate_count").alias("candidates"), F.round(F.avg("regret_mean"), 9).alias("mean_regret"), F.round(F.percentile("regret_mean", 0.5), 9).alias("median_regret"))
    whole = decisions.groupBy(*by).agg(F.count("*").alias("n"), F.sum("candidate_count").alias("n_candidates"))
    joined = out.join(whole, by) if by else out.crossJoin(whole)  # the whole is one row
    return joined.select(*by, "subset", "decisions", F.round(F.col("decisions") / F.col("n"), 9).alias("coverage"), "candidates", F.round(F.col("candidates") / F.col("n_candidates"), 9).alias("candidate_coverage"), "mean_regret", "median_regret")


def candidate_regret(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Regret thresholds over all candidates, and the victims that simple rules choose."""
    r = F.col("regret")
    last = F.col("candidate_recency_rank") == F.count("*").over(Window.partitionBy(*DECISION_KEY)) - 1
    rows = attach_regret(candidates.select(*DECISION_KEY, "y_loss", "candidate_recency_rank", "candidate_is_lru_victim", "candidate_is_predictor_victim")).withColumn("mru", last)
    victims = {"lru": F.col("candidate_is_lru_victim") == 1, "mru": F.col("mru"), "predictor": F.col("candidate_is_predictor_victim") == 1}
    own = [x for k, v in victims.items() for x in (
        F.count_if(v).alias(f"{k}_victims"), F.count_if(v & (r == 0)).alias(f"{k}_optimal"), F.sum(F.when(v, r).otherwise(0.0)).alias(f"{k}_regret_sum"),
        F.round(F.percentile(F.when(v, r), 0.9), 9).alias(f"{k}_regret_p90"))]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("candidates"), *[F.count_if(r >= k).alias(f"regret_ge_{k}") for k in (1, 2, 3)], F.count_if(r == 0).alias("regret_0"), *own)


def pair_panel(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ties, sides and decisions of a table of pairs."""
    key = text_key(*DECISION_KEY)
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("pairs"), F.sum("is_tie").alias("ties"), F.sum("label_a_better").alias("a_better"), F.sum("label_b_better").alias("b_better"),
        F.count_distinct(key).alias("decisions"), F.round(F.avg("is_tie"), 9).alias("tie_fraction"),
    )


def pair_universe(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many pairs the full pairwise view has, without making them."""
    n = F.col("candidate_count")
    return decisions.groupBy(*(by or [])).agg(F.sum((n * (n - 1) / 2).cast("long")).alias("pairs"), F.max("candidate_count").alias("largest"))


def strict_density(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Share of pairs with different losses, from each decision's histogram of losses: no pair is made."""
    histogram = candidates.groupBy(*DECISION_KEY, "y_loss").agg(F.count("*").alias("n"))
    own = histogram.groupBy(*DECISION_KEY).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("equal"))
    own = own.withColumn("pairs", F.expr("n * (n - 1) div 2"))
    return own.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("equal").alias("equal_pairs"), F.round(safe_ratio(F.sum("pairs") - F.sum("equal"), F.sum("pairs")), 9).alias("strict_density"))


def decision_density(labels: DataFrame, key: list[str]) -> DataFrame:
    """Of each decision: candidates, range of losses, strict pairs and their share, from the histogram of its losses."""
    histogram = labels.groupBy(*key, "y_loss").agg(F.count("*").alias("m"))
    own = histogram.groupBy(*key).agg(F.sum("m").alias("candidates"), (F.max("y_loss") - F.min("y_loss")).alias("loss_range"), F.sum(F.expr("m * (m - 1) div 2")).alias("equal"))
    strict = F.expr("candidates * (candidates - 1) div 2 - equal")
    return own.select(*key, "candidates", "loss_range", strict.alias("strict_pairs"), F.round(safe_ratio(strict, F.expr("candidates * (candidates - 1) div 2")), 9).alias("strict_density"))


def pair_contributions(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How decisions contribute to a table of pairs: decisions with a strict pair, with ties only, and pairs for each; and which side
    strict pairs prefer."""
    own = pairs.groupBy(*(by or []), *[c for c in DECISION_KEY if c not in (by or [])]).agg(F.count("*").alias("n"), F.sum(1 - F.col("is_tie")).alias("strict"), F.sum("label_a_better").alias("a"))
    tells = F.col("strict") > 0
    return own.groupBy(*(by or [])).agg(
        F.count("*").alias("decisions"), F.count_if(tells).alias("with_strict_pairs"), F.count_if(~tells).alias("only_tied"), F.round(F.avg(tells.cast("double")), 9).alias("with_strict_share"),
        F.round(F.avg("n"), 9).alias("pairs_a_decision"), F.round(F.avg(F.when(tells, F.col("strict"))), 9).alias("strict_a_telling_decision"), F.round(safe_ratio(F.sum("a"), F.sum("strict")), 9).alias("a_better_share"),
    )


def sample_mix(pairs: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """Shares of each stratum in a sample of pairs, in the decisions, and in all pairs that the decisions would have, which grow with
    the square of their candidates. A stratum that one side lacks has 0 there."""
    sample = pairs.groupBy(*by).agg(F.count("*").alias("sampled"))
    n = F.col("candidate_count")
    whole = decisions.groupBy(*by).agg(F.count("*").alias("decisions"), F.sum((n * (n - 1) / 2).cast("long")).alias("universe"))
    both = sample.join(whole, by, "full_outer").na.fill(0, ["sampled", "decisions", "universe"])
    share = lambda c: F.round(safe_ratio(F.col(c), F.sum(c).over(Window.partitionBy())), 9)  # noqa: E731  # a row for each stratum
    return both.select(*by, "sampled", "decisions", "universe", share("sampled").alias("sampled_share"), share("decisions").alias("decision_share"), share("universe").alias("universe_share"))


def numeric_summary(df: DataFrame, columns: list[str], by: list[list[str]]) -> DataFrame:
    """Count, missing (null or not finite), moments and quantiles of each column, for each of the groupings in one pass."""
    keys = list(dict.fromkeys(k for g in by for k in g))
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select(*keys, "p.target", "p.x")
    ok = F.when(finite(F.col("x")), F.col("x"))
    sets = [[F.col("target"), *[F.col(k) for k in g]] for g in by]
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    out = long.groupingSets(sets, F.col("target"), *[F.col(k) for k in keys]).agg(
        F.count(ok).alias("n"), F.count_if(~F.coalesce(finite(F.col("x")), F.lit(False))).alias("missing"), F.round(F.avg(ok), 9).alias("mean"), F.round(F.stddev_pop(ok), 9).alias("std"),
        F.min(ok).alias("least"), F.max(ok).alias("largest"), *[F.round(F.percentile(ok, p), 9).alias(f"p{int(p * 100):02d}") for p in q],
    )
    return out


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, nulls, least and largest of each column, from one pass of counts by (column, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.feature", "p.x")
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    return values.groupBy("feature").agg(F.count("x").alias("distinct_values"), F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.min("x").alias("least"), F.max("x").alias("largest"))


def weighted_pool(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Sum of weight times value over the sum of weights."""
    return df.groupBy(*by).agg(F.sum(weight).alias("weight"), F.round(safe_ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), 9).alias("pooled"))


def seed_summary(runs: DataFrame, by: list[str], value: str, wanted: int) -> DataFrame:
    """Over the seeds of a cell: mean, sample deviation, a normal 95 % interval and whether all seeds are there."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    half = 1.96 * sd / F.sqrt(n)
    status = F.when(n == 0, "no_complete_seeds").when(n < wanted, "partial").otherwise("complete")
    return runs.groupBy(*by).agg(n.alias("n"), F.round(mean, 9).alias("mean"), F.round(sd, 9).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"), F.round(mean - half, 9).alias("low"), F.round(mean + half, 9).alias("high"), status.alias("status"))


def horizon_transitions(losses: DataFrame, physical: list[str], steps: list[tuple[int, int]]) -> DataFrame:
    """How decisions change between horizons: tied or telling, regret up, down or equal (beyond 1e-12), mean changes."""
    return changes(losses.groupBy(*physical).pivot("horizon", sorted({h for s in steps for h in s})).agg(F.first("random_regret")), steps)


def changes(wide: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``horizon_transitions`` of rows that have each horizon's random regret in a column of its name."""
    rows = [F.struct(F.lit(a).cast("int").alias("from_horizon"), F.lit(b).cast("int").alias("to_horizon"), F.col(str(a)).alias("x"), F.col(str(b)).alias("y")) for a, b in steps]
    long = wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    tied = lambda v: F.abs(v) <= 1e-12
    return long.groupBy("from_horizon", "to_horizon").agg(
        F.count("*").alias("decisions"), F.count_if(tied(x) & ~tied(y)).alias("tied_to_telling"), F.count_if(~tied(x) & tied(y)).alias("telling_to_tied"), F.count_if(tied(x) & tied(y)).alias("both_tied"),
        F.count_if(y - x > 1e-12).alias("up"), F.count_if(x - y > 1e-12).alias("down"), F.count_if(F.abs(y - x) <= 1e-12).alias("equal"), F.round(F.avg(y - x), 9).alias("mean_change"),
    )


def horizon_monotonicity(losses: DataFrame, physical: list[str], horizons: list[int]) -> DataFrame:
    """Over decisions seen at every horizon: does random regret rise or fall from the least to the largest, and does it do so
    at each step (beyond 1e-12)? Regret that is equal at all steps counts as nondecreasing."""
    hs = sorted(horizons)
    return monotonicity(losses.groupBy(*physical).pivot("horizon", hs).agg(F.first("random_regret")), hs)


def monotonicity(wide: DataFrame, horizons: list[int]) -> DataFrame:
    """``horizon_monotonicity`` of rows that have each horizon's random regret in a column of its name."""
    hs = sorted(horizons)
    wide = wide.dropna(subset=[str(h) for h in hs])
    steps = [(F.col(str(a)), F.col(str(b))) for a, b in zip(hs, hs[1:])]
    up, down = F.lit(True), F.lit(True)
    for x, y in steps:
        up, down = up & ~(y + 1e-12 < x), down & ~(y > x + 1e-12)
    change = F.col(str(hs[-1])) - F.col(str(hs[0]))
    return wide.agg(
        F.count("*").alias("decisions"), F.count_if(change > 1e-12).alias("rise"), F.count_if(change < -1e-12).alias("fall"), F.count_if(F.abs(change) <= 1e-12).alias("unchanged"),
        F.count_if(up).alias("nondecreasing"), F.count_if(~up & down).alias("nonincreasing"), F.count_if(~up & ~down).alias("mixed"),
    )


def horizon_decomposition(losses: DataFrame, physical: list[str], start: int, to: int) -> DataFrame:
    """What of a change between two horizons is due to other decisions and what to the horizon: each horizon's own decisions
    against those seen at all horizons. ``losses`` has the summary of each decision and horizon."""
    n = losses.agg(F.countDistinct("horizon").alias("n"))
    seen = losses.groupBy(*physical).agg(F.countDistinct("horizon").alias("seen"))
    matched = seen.join(F.broadcast(n), F.col("seen") == F.col("n")).select(*physical, F.lit(True).alias("matched"))  # n is one row
    rows = losses.join(matched, physical, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    values = {"all_tied": F.col("all_tied").cast("double"), "random_optimal": F.col("optimal_fraction"), "random_regret": F.col("random_regret")}
    long = rows.select("horizon", "matched", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in values.items()])).alias("p")).select("horizon", "matched", "p.*")
    cell = lambda h, own: F.avg(F.when((F.col("horizon") == h) & (F.lit(not own) | F.col("matched")), F.col("v")))
    return long.groupBy("metric").agg(
        F.round(cell(start, False), 9).alias("own_start"), F.round(cell(start, True), 9).alias("matched_start"), F.round(cell(to, True), 9).alias("matched_end"),
        F.round(cell(start, True) - cell(start, False), 9).alias("population_effect"), F.round(cell(to, True) - cell(start, True), 9).alias("horizon_effect"),
    )
