"""Best candidates, ranks, samples and key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachesight.functions.scalars import finite, stable_score
from cachesight.operators.views import attach_regret
from cachesight.schema import DECISION_KEY


def best_candidate(candidates: DataFrame, score: Column, largest: bool = True) -> DataFrame:
    """The candidate that a score selects in each decision, with its regret.

    Scores that are not finite lose, ties go to the smallest page, and so do decisions without any finite score. Rows
    without a finite loss are left out first.
    """
    own = attach_regret(candidates.where(finite(F.col("y_loss")))).withColumn("score", score)
    good = finite(F.col("score"))
    order = [F.when(good, 0).otherwise(1), F.when(good, F.col("score")).desc() if largest else F.when(good, F.col("score")).asc(), "candidate_page_id"]
    place = F.row_number().over(Window.partitionBy(*DECISION_KEY).orderBy(*order))
    return own.withColumn("place", place).where("place = 1").select(*DECISION_KEY, "candidate_page_id", "y_loss", "score", "regret")


def selection_metrics(selected: DataFrame, by: list[str] | None = None) -> DataFrame:
    r = F.col("regret")
    return selected.groupBy(*(by or [])).agg(F.count("*").alias("decisions"), F.round(F.avg((r <= 1e-12).cast("double")), 9).alias("optimal_rate"), F.round(F.avg(r), 9).alias("mean_regret"), F.round(F.percentile(r, 0.5), 9).alias("median_regret"), F.max(r).alias("max_regret"))


def selection_panel(selected: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value) with ``selection_metrics`` for the whole (``all``) and for each value of each dimension, in one pass."""
    d = [F.col(c) for c in dimensions]
    r = F.col("regret")
    name, value = F.lit("all"), F.lit(None).cast("string")
    for c in dimensions:
        name, value = F.when(F.grouping(c) == 0, c).otherwise(name), F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(value)
    found = selected.groupingSets([[], *[[x] for x in d]], *d).agg(name.alias("dimension"), value.alias("value"), F.count("*").alias("decisions"), F.round(F.avg((r <= 1e-12).cast("double")), 9).alias("optimal_rate"), F.round(F.avg(r), 9).alias("mean_regret"), F.round(F.percentile(r, 0.5), 9).alias("median_regret"), F.max(r).alias("max_regret"))
    return found.drop(*dimensions)


def bottom_sample(df: DataFrame, n: int, by: list[str], parts: list[str], seed: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes of (seed, parts) in each group; the sample only depends on the rows' values."""
    score = stable_score(F.lit(seed), *[F.col(c) for c in parts])
    return df.withColumn("sample_score", score).withColumn("sample_rank", F.row_number().over(Window.partitionBy(*by).orderBy("sample_score", *parts))).where(F.col("sample_rank") <= n)


def stratified_sample(df: DataFrame, stratum: str, n: int, parts: list[str], seed: int) -> DataFrame:
    """``n`` rows in all, each stratum's share in proportion to its rows (largest remainders get the rest), by hash rank."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    whole = Window.partitionBy(F.lit(1))  # a row a stratum
    exact = F.col("size") * F.lit(n) / F.sum("size").over(whole)
    shares = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    rest = F.lit(n) - F.sum("base").over(whole)
    place = F.row_number().over(whole.orderBy((F.col("exact") - F.col("base")).desc(), stratum))
    shares = shares.withColumn("take", F.least(F.col("size"), F.col("base") + (place <= rest).cast("long"))).select(stratum, "take")
    score = stable_score(F.lit(seed), *[F.col(c) for c in parts])
    ranked = df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(score, *parts)))
    return ranked.join(shares, stratum).where(F.col("sample_rank") <= F.col("take")).drop("take")


def top_decile_sample(decisions: DataFrame, n: int, seed: int) -> DataFrame:
    """Of the tenth of decisions with the most regret, ``n`` by hash."""
    place = F.row_number().over(Window.partitionBy("trace_family").orderBy(F.desc("regret_sum"), *DECISION_KEY))
    size = F.count("*").over(Window.partitionBy("trace_family"))
    top = decisions.withColumn("place", place).withColumn("size", size).where(F.col("place") <= F.greatest(F.lit(1), F.expr("size div 10")))
    return bottom_sample(top.drop("place", "size"), n, ["trace_family"], DECISION_KEY, seed)


def even_positions(n: int, k: int) -> list[int]:
    """``k`` of n positions at even distances."""
    return sorted({0} if k == 1 else {round(i * (n - 1) / (k - 1)) for i in range(min(k, n))})


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    one, two = a.select(*keys).distinct(), b.select(*keys).distinct()
    return one.join(two, keys, "left_anti").withColumn("only_in", F.lit("left")).unionByName(two.join(one, keys, "left_anti").withColumn("only_in", F.lit("right")))


def midrank_auroc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from counts by distinct score; null where one class is missing.

    A running count over distinct scores stands for the ranks of rows, so rows are never sorted. A column ``rows`` says how many rows a
    row stands for.
    """
    by = by or []
    many = F.col("rows") if "rows" in scored.columns else F.lit(1).cast("long")
    counts = scored.groupBy(*by, "score").agg(F.sum(many).alias("n"), F.sum(many * F.col("label")).alias("pos"))
    run = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("mid", F.sum("n").over(run) - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("mid") * F.col("pos")).alias("ranks"))
    neg = F.col("n") - F.col("pos")
    return sums.select(*by, F.col("n"), F.col("pos").alias("positives"), F.round(F.when((F.col("pos") > 0) & (neg > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)), 9).alias("auroc"))
