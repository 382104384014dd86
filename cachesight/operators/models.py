"""Linear and logistic models from sums that Spark makes, and rank statistics.

Only sums of a size that the number of features sets come to the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachesight.functions.scalars import finite, linear_score, odd_hash, safe_ratio, sign
from cachesight.operators.dominance import block_size, dominated, in_order
from cachesight.operators.selection import midrank_auroc
from cachesight.schema import DECISION_KEY
from cachesight.sources.shared import materialize


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.when(finite(F.col(c)), F.col(c))).alias(c) for c in features]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in features}


def normal_sums(df: DataFrame, features: list[str], target: str, means: dict[str, float] | None = None) -> DataFrame:
    """One row: n, sums of features, of products of two features (i <= j), of features with the target, and the target's."""
    x = [F.when(finite(F.col(c)), F.col(c)).otherwise((means or {}).get(c, 0.0)) for c in features]
    y = F.col(target)
    cells = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    cells += [F.sum(a).alias(f"s_{i}") for i, a in enumerate(x)] + [F.sum(a * y).alias(f"sy_{i}") for i, a in enumerate(x)]
    cells += [F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i, j in itertools.combinations_with_replacement(range(len(x)), 2)]
    return df.agg(*cells)


def fit_linear(df: DataFrame, features: list[str], target: str) -> dict:
    """Least squares of the smallest norm, with an intercept; constant or repeated features do no harm."""
    means = feature_means(df, features)
    row, p = normal_sums(df, features, target, means).first(), len(features)
    a, b = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
    a[0, 0], b[0] = row["n"], row["sy"] or 0.0
    for i in range(p):
        a[0, i + 1] = a[i + 1, 0] = row[f"s_{i}"] or 0.0
        b[i + 1] = row[f"sy_{i}"] or 0.0
        for j in range(i, p):
            a[i + 1, j + 1] = a[j + 1, i + 1] = row[f"s_{i}_{j}"] or 0.0
    w = np.linalg.pinv(a, hermitian=True) @ b
    return {"intercept": float(w[0]), "coefficients": dict(zip(features, w[1:].tolist(), strict=True)), "means": means}


def predict_linear(model: dict) -> Column:
    return linear_score(model["intercept"], model["coefficients"], model["means"])


def regression_metrics(df: DataFrame, prediction: Column, target: str, by: list[str], constant: float | None = None) -> DataFrame:
    """MAE, RMSE and R2 (null where the target does not vary), and those of a constant prediction."""
    y, e = F.col(target), F.col(target) - F.col("prediction")
    total = F.var_pop(y) * F.count(y)
    cells = [F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 9).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse"), F.round(F.when(total > 0, 1 - F.sum(e * e) / total), 9).alias("r2")]
    if constant is not None:
        cells += [F.round(F.avg(F.abs(y - constant)), 9).alias("constant_mae"), F.round(F.sqrt(F.avg((y - constant) * (y - constant))), 9).alias("constant_rmse")]
    return df.withColumn("prediction", prediction).groupBy(*by).agg(*cells)


def standardise(df: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Means and population deviations of ``df``; a deviation below 1e-12 counts as one. A column ``rows`` says how many rows a row
    stands for; then squares are summed of differences from the means."""
    if "rows" in df.columns:
        n = F.col("rows")
        total = lambda c, v: F.sum(F.when(F.col(c).isNotNull(), n * v)) / F.sum(F.when(F.col(c).isNotNull(), n))
        means = df.agg(*[total(c, F.col(c)).alias(f"m_{c}") for c in features]).first()
        away = {c: F.col(c) - (means[f"m_{c}"] or 0.0) for c in features}
        row = df.agg(*[F.lit(means[f"m_{c}"]).cast("double").alias(f"m_{c}") for c in features], *[F.sqrt(total(c, d * d)).alias(f"s_{c}") for c, d in away.items()]).first()
    else:
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= 1e-12 else 1.0) for c in features}
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}), scale


def fit_logistic(df: DataFrame, features: list[str], label: str, ridge: float = 1.0, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Newton steps; each is one aggregation of gradient and curvature. The penalty spares the intercept. Equal rows are counted once
    before the steps, which read the counts, written as a table; a column ``rows`` says how many rows a row stands for."""
    p = len(features) + 1
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    n = F.sum("rows") if "rows" in df.columns else F.count("*")
    df = materialize(df.groupBy(*features, label).agg(n.alias("rows")), "fitted")
    return _newton(df, x, np.zeros(p), label, ridge, steps, tolerance)


def _newton(df: DataFrame, x: list[Column], w: np.ndarray, label: str, ridge: float, steps: int, tolerance: float) -> np.ndarray:
    p = len(x)
    for _ in range(steps):
        z = sum((x[i] * float(w[i]) for i in range(1, p)), F.lit(float(w[0])))
        q = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        own = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (F.col("rows") * (F.col(label) - q)).alias("e"), (F.col("rows") * F.greatest(q * (1 - q), F.lit(1e-6))).alias("v"))
        cells = [F.sum(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)]
        cells += [F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        row = own.agg(*cells).first()
        g = np.array([row[f"g{i}"] or 0.0 for i in range(p)])
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        penalty = np.array([0.0] + [ridge] * (p - 1))
        step = np.linalg.lstsq(h + np.diag(penalty), g - penalty * w, rcond=None)[0]
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return w


def logistic_probability(w: np.ndarray, features: list[str]) -> Column:
    z = sum((F.col(c) * float(v) for c, v in zip(features, w[1:], strict=True)), F.lit(float(w[0])))
    return 1 / (1 + F.exp(-z))


def pair_metrics(pairs: DataFrame, probability: Column, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, log loss and macro F1 of ``probability`` that side a is better; ties are left out. A column ``rows``
    says how many pairs a row stands for."""
    many = F.col("rows") if "rows" in pairs.columns else F.lit(1).cast("long")
    rows = pairs.where("is_tie = 0").withColumn("p", F.greatest(F.least(probability, F.lit(1 - 1e-12)), F.lit(1e-12))).withColumn("y", F.col("label_a_better"))
    hit = F.col("p") >= 0.5
    cell = lambda c: F.coalesce(F.sum(F.when(c, many)), F.lit(0).cast("long"))
    loss = F.when(F.col("y") == 1, -F.log("p")).otherwise(-F.log(1 - F.col("p")))
    counts = rows.groupBy(*(by or [])).agg(cell(hit & (F.col("y") == 1)).alias("tp"), cell(hit & (F.col("y") == 0)).alias("fp"), cell(~hit & (F.col("y") == 1)).alias("fn"), cell(~hit & (F.col("y") == 0)).alias("tn"), (F.sum(many * loss) / F.sum(F.when(loss.isNotNull(), many))).alias("loss"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall_a, recall_b = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    f1 = (safe_ratio(2 * tp, 2 * tp + fp + fn) + safe_ratio(2 * tn, 2 * tn + fp + fn)) / 2
    return counts.select(*(by or []), (tp + fp + fn + tn).alias("n"), F.round(safe_ratio(tp + tn, tp + fp + fn + tn), 9).alias("accuracy"), F.round((recall_a + recall_b) / 2, 9).alias("balanced_accuracy"), F.round("loss", 9).alias("log_loss"), F.round(recall_a, 9).alias("recall_a"), F.round(recall_b, 9).alias("recall_b"), F.round(f1, 9).alias("macro_f1"))


def pair_evaluation(pairs: DataFrame, probability: Column, by: str = "split") -> DataFrame:
    """``pair_metrics`` and the area under the curve for each value of ``by`` and, as ``all``, for all pairs that do not tie."""
    rows = counted_pairs(pairs.withColumn("probability", probability), ["probability"], [by])
    each = rows.withColumn("part", F.explode(F.array(F.col(by), F.lit("all"))))
    scored = each.select("part", "rows", F.col("probability").alias("score"), F.col("label_a_better").alias("label"))
    return pair_metrics(each, F.col("probability"), ["part"]).join(midrank_auroc(scored, ["part"]).select("part", "auroc"), "part")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p = safe_ratio(hits, n)
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round((centre - half) / (1 + z * z / n), 9), F.round((centre + half) / (1 + z * z / n), 9)


def majority_baseline(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Every pair gets the training pairs' commonest label, and their share as its probability; ties are left out."""
    rows = pairs.where("is_tie = 0")
    share = rows.where("split = 'train'").agg(F.avg("label_a_better").alias("share"))
    joined = rows.crossJoin(F.broadcast(share))  # one row
    p = F.greatest(F.least("share", F.lit(1 - 1e-12)), F.lit(1e-12))
    hit = (F.col("share") >= 0.5).cast("int") == F.col("label_a_better")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("label_a_better"), 9).alias("positive_rate"), F.round(F.avg(hit.cast("double")), 9).alias("accuracy"), F.round(F.avg(F.when(F.col("label_a_better") == 1, -F.log(p)).otherwise(-F.log(1 - p))), 9).alias("log_loss"))


def random_baseline(pairs: DataFrame, key: list[str], by: list[str], seed: int = 7) -> DataFrame:
    """Every pair gets a label by the parity of a seeded hash, at a probability of one half; ties are left out."""
    rows = pairs.where("is_tie = 0")
    guess = odd_hash(F.lit(str(seed)), *[F.col(c) for c in key]).cast("int")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("label_a_better"), 9).alias("positive_rate"), F.round(F.avg((guess == F.col("label_a_better")).cast("double")), 9).alias("accuracy"), F.round(F.lit(1.0) * -F.log(F.lit(0.5)), 9).alias("log_loss"))


def raw_score_accuracy(pairs: DataFrame, feature: str, by: list[str]) -> DataFrame:
    """Side a is said to be better where its score is larger, b where it is smaller or equal; with the share's 95 % interval."""
    rows = pairs.where("is_tie = 0").withColumn("hit", ((F.col(f"{feature}_a") > F.col(f"{feature}_b")).cast("int") == F.col("label_a_better")).cast("int"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counted.select(*by, "n", F.round(safe_ratio(F.col("hits"), F.col("n")), 9).alias("accuracy"), low.alias("low"), high.alias("high"))


def counted_pairs(pairs: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """How often each label comes with the same ``features`` among the pairs that do not tie, written as a table: pairs are made once,
    and what reads them often follows the number of different features."""
    kept = pairs.where("is_tie = 0").groupBy(*dict.fromkeys(["split", *by]), *features, "label_a_better").agg(F.count("*").alias("rows"))
    return materialize(kept.withColumn("is_tie", F.lit(0)), "counted")


def calibrated_score(pairs: DataFrame, difference: Column, by: list[str], ridge: float = 1.0) -> DataFrame:
    """A logistic model of one standardised difference, fitted on training pairs; ``pair_metrics`` of all by ``by``."""
    rows = counted_pairs(pairs.withColumn("difference", F.coalesce(difference, F.lit(0.0))), ["difference"], by)
    train = rows.where("split = 'train'")
    _, scale = standardise(train, ["difference"])
    mean, deviation = scale["difference"]
    scaled = lambda df: df.withColumn("difference", (F.col("difference") - mean) / deviation)
    w = fit_logistic(scaled(train), ["difference"], "label_a_better", ridge)
    return pair_metrics(scaled(rows), logistic_probability(w, ["difference"]), by)


def calibrated_linear_score(pairs: DataFrame, model: dict, by: list[str], ridge: float = 1.0) -> DataFrame:
    """``calibrated_score`` of how much more a linear model says that side b loses than side a. ``pairs`` have its features as
    ``_a`` and ``_b`` columns; one that is missing raises."""
    wanted = model["coefficients"]
    if not wanted:
        raise ValueError("the model has no coefficients")
    if missing := [f for f in wanted if not {f"{f}_a", f"{f}_b"} <= set(pairs.columns)]:
        raise ValueError(f"the pairs lack features of the model: {missing}")
    loss = lambda s: linear_score(model["intercept"], {f"{f}_{s}": w for f, w in wanted.items()}, {f"{f}_{s}": m for f, m in model["means"].items()})
    return calibrated_score(pairs, loss("b") - loss("a"), by, ridge)


def optimal_set_agreement(losses: DataFrame, key: list[str]) -> DataFrame:
    """For each decision two losses (x, y) of each candidate: Jaccard of the optimal sets, and the regret under y of what is
    optimal under x: mean, least, largest, and how likely it stays optimal."""
    own = Window.partitionBy(*key)
    r = losses.withColumn("rx", F.col("x") - F.min("x").over(own)).withColumn("ry", F.col("y") - F.min("y").over(own))
    a, b = F.col("rx") == 0, F.col("ry") == 0
    chosen = F.when(a, F.col("ry"))
    return r.groupBy(*key).agg(F.round(F.count_if(a & b) / F.count_if(a | b), 9).alias("jaccard"), F.round(F.avg(chosen), 9).alias("mean_cross_regret"), F.min(chosen).alias("best_cross_regret"), F.max(chosen).alias("worst_cross_regret"), F.round(F.avg(F.when(a, b.cast("double"))), 9).alias("still_optimal"))


def pair_taxonomy(losses: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of candidates by how two losses order them. Pairs come from each decision's histogram of (x, y) joined to
    itself, so its size follows the number of different losses and not of candidates."""
    h = losses.groupBy(*key, "x", "y").agg(F.count("*").alias("n"))
    joined = h.alias("a").join(h.alias("b"), key)
    first = (F.col("a.x") < F.col("b.x")) | (F.col("a.x") == F.col("b.x")) & (F.col("a.y") <= F.col("b.y"))
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    n = F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    sx, sy = sign(F.col("b.x") - F.col("a.x")), sign(F.col("b.y") - F.col("a.y"))
    kind = F.when((sx == 0) & (sy == 0), "both_tied").when(sx == 0, "x_tied").when(sy == 0, "y_tied").when(sx == sy, "concordant").otherwise("discordant")
    kinds = ["concordant", "discordant", "x_tied", "y_tied", "both_tied"]
    return joined.where(first).select(*key, n.alias("n"), kind.alias("kind")).groupBy(*key).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])


def continuation_summary(losses: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """How two continuations (losses x and y) agree over sets of decisions: all, not tied under both, telling under the
    first, telling under either. A decision of one candidate counts as tied."""
    tax = pair_taxonomy(losses, key)
    kinds = ["concordant", "discordant", "x_tied", "y_tied", "both_tied"]
    rows = optimal_set_agreement(losses, key).join(tax, key)
    c, d, only_x, only_y = (F.col(k) for k in kinds[:4])
    tied, other = (c + d + only_y) == 0, (c + d + only_x) == 0
    # the second and the fourth set are equal by definition; both are listed, as in the survey
    sets = F.array(F.lit("A_all"), F.when(~(tied & other), "B_not_both_tied"), F.when(~tied, "C_telling_first"), F.when(~tied | ~other, "D_telling_either"))
    long = rows.withColumn("subset", F.explode(F.filter(sets, lambda v: v.isNotNull())))
    j, m = F.col("jaccard"), F.col("mean_cross_regret")
    pairs = sum((F.sum(k) for k in kinds[1:]), F.sum(kinds[0]))
    return long.groupBy(*(by or []), "subset").agg(
        F.count("*").alias("decisions"), F.round(F.avg(j), 9).alias("mean_jaccard"), F.round(F.percentile(j, 0.5), 9).alias("median_jaccard"), F.min(j).alias("least_jaccard"),
        *[F.sum(k).alias(k) for k in kinds], F.round(safe_ratio(F.sum("discordant"), pairs), 9).alias("reversals"), F.round(F.avg(m), 9).alias("mean_ccr"), F.max(m).alias("largest_ccr"),
        F.round(F.avg((m == 0).cast("double")), 9).alias("ccr_zero"), F.round(F.avg((m <= 1).cast("double")), 9).alias("ccr_at_most_1"), F.round(F.avg("still_optimal"), 9).alias("still_optimal"),
    )


#: Dimensions of a census: all decisions, and strata of one or two columns.
CENSUS = ([], ["trace_family"], ["capacity"], ["trace_family", "capacity"], ["horizon"])


def continuation_census(losses: DataFrame, key: list[str]) -> DataFrame:
    """How two continuations agree over all decisions and over those that tell under the first, for each of CENSUS, in one pass over
    the decisions: Jaccard (mean, median, share of 1 and below 0.8), strict reversals, cross regret (mean, median, 95th
    percentile, largest) and the share of decisions that tie under both. Columns that a stratum does not have are null."""
    rows = optimal_set_agreement(losses, key).join(pair_taxonomy(losses, key), key)
    c, d, only_x, only_y = (F.col(k) for k in ("concordant", "discordant", "x_tied", "y_tied"))
    tied, other = (c + d + only_y) == 0, (c + d + only_x) == 0
    rows = rows.withColumn("both_flat", tied & other).withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), F.when(~tied, "telling")))))
    j, m, one = F.col("jaccard"), F.col("mean_cross_regret"), lambda e: F.round(F.avg(e.cast("double")), 9)
    strata = sorted({x for own in CENSUS for x in own})
    sets = [[F.col("subset"), *map(F.col, own)] for own in CENSUS]
    level = F.when(F.grouping("trace_family") + F.grouping("capacity") == 0, "trace_family+capacity").when(F.grouping("trace_family") == 0, "trace_family").when(F.grouping("capacity") == 0, "capacity").when(F.grouping("horizon") == 0, "horizon").otherwise("all")
    return rows.groupingSets(sets, F.col("subset"), *map(F.col, strata)).agg(
        level.alias("level"), F.count("*").alias("decisions"), F.round(F.avg(j), 9).alias("mean_jaccard"), F.round(F.percentile(j, 0.5), 9).alias("median_jaccard"), one(j == 1).alias("jaccard_1"), one(j < 0.8).alias("jaccard_below_0_8"),
        F.sum("discordant").alias("reversals"), F.round(F.avg(m), 9).alias("mean_ccr"), F.round(F.percentile(m, 0.5), 9).alias("median_ccr"), F.round(F.percentile(m, 0.95), 9).alias("p95_ccr"), F.max(m).alias("largest_ccr"), one(F.col("both_flat")).alias("both_tied_fraction"),
    )


def census_deltas(sample: DataFrame, population: DataFrame, measures: list[str]) -> DataFrame:
    """(level, subset, strata ..., measure, sampled, whole, delta) of two censuses, for strata that both have."""
    key = ["level", "subset", "trace_family", "capacity", "horizon"]
    long = lambda df, name: df.select(*key, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(name)) for m in measures])).alias("p")).select(*key, "p.*")
    a, b = long(sample, "sampled"), long(population, "whole")
    same = [a[k].eqNullSafe(b[k]) for k in [*key, "measure"]]
    return a.join(b, same).select(*[a[k] for k in [*key, "measure"]], "sampled", "whole", F.round(F.col("sampled") - F.col("whole"), 9).alias("delta"))


def continuation_class(losses: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Whether labels hold under another continuation, from the decisions that tell under the first; strata without such
    decisions stay as inconclusive."""
    by = by or []
    whole = continuation_summary(losses, key, by)
    told = lambda c: F.max(F.when(F.col("subset") == "C_telling_first", F.col(c)))
    j, c = F.col("median_jaccard"), F.col("ccr_at_most_1")
    kind = F.when(j.isNull() | c.isNull(), "INCONCLUSIVE").when((j >= 0.8) & (c >= 0.8), "ROBUST").when((j < 0.5) | (c < 0.2), "SENSITIVE").otherwise("CONDITIONALLY_ROBUST")
    out = whole.groupBy(*by).agg(told("median_jaccard").alias("median_jaccard"), told("ccr_at_most_1").alias("ccr_at_most_1"))
    return out.withColumn("class", kind)


def kendall_tau_b(taxonomy: DataFrame, key: list[str]) -> DataFrame:
    """Null where either side is constant."""
    c, d, x, y = (F.col(k) for k in ("concordant", "discordant", "x_tied", "y_tied"))
    return taxonomy.select(*key, F.round(safe_ratio(c - d, F.sqrt(((c + d + x) * (c + d + y)).cast("double"))), 9).alias("tau_b"))


def correlations(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson's and Spearman's (of mid-ranks from counts of distinct values); null where a side is constant."""
    by = by or []
    out = df
    for c, name in ((x, "rx"), (y, "ry")):
        counts = out.groupBy(*by, c).agg(F.count("*").alias("m"))
        run = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        ranks = counts.select(*by, c, (F.sum("m").over(run) - (F.col("m") - 1) / 2).alias(name))
        out = out.join(ranks, [*by, c])
    safe = lambda a, b: F.round(F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)), 9)
    return out.groupBy(*by).agg(F.count("*").alias("n"), safe(x, y).alias("pearson"), safe("rx", "ry").alias("spearman"))


def concordance(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Sign agreement of two gaps."""
    sx, sy = sign(F.col(x)), sign(F.col(y))
    kind = F.when((sx == 0) & (sy == 0), "both_tied").when(sx == 0, "offline_tie_only").when(sy == 0, "closed_loop_tie_only").when(sx == sy, "concordant").otherwise("discordant")
    return df.groupBy(*(by or []), kind.alias("kind")).agg(F.count("*").alias("n"))


def leave_one_out(df: DataFrame, block: str, x: str, y: str) -> DataFrame:
    """Pearson's correlation without each block in turn, from the sums of the blocks."""
    s = df.groupBy(block).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in _moments(x, y).items()])
    whole = s.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", *_moments(x, y))])
    left = s.crossJoin(F.broadcast(whole)).select(F.col(block).alias("left_out"), *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", *_moments(x, y))])  # one row
    return left.select("left_out", "n", F.round(_pearson(), 9).alias("pearson"))


def _moments(x: str, y: str) -> dict[str, Column]:
    a, b = F.col(x), F.col(y)
    return {"sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b}


def _pearson() -> Column:
    n = F.col("n")
    vx, vy = F.col("sxx") * n - F.col("sx") * F.col("sx"), F.col("syy") * n - F.col("sy") * F.col("sy")
    return F.when((vx > 0) & (vy > 0), (F.col("sxy") * n - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))


def permutation_p(cells: DataFrame, block: str, unit: str, x: str, y: str) -> DataFrame:
    """Exact p-value of the correlation of x and y when the y's of whole blocks are exchanged in all ways (at most 8 blocks).

    ``unit`` names a cell within its block; each block has the same units.
    """
    spark = cells.sparkSession
    blocks = sorted(r[0] for r in cells.select(block).distinct().limit(9).collect())
    if len(blocks) > 8:
        raise ValueError("at most 8 blocks can be exchanged in all ways")
    rows = [(k, a, b) for k, p in enumerate(itertools.permutations(blocks)) for a, b in zip(blocks, p, strict=True)]
    ways = spark.createDataFrame(rows, f"way int, {block} string, other string")
    own, other = cells.select(block, unit, F.col(x).alias("x")), cells.select(F.col(block).alias("other"), unit, F.col(y).alias("y"))
    r = ways.join(own, block).join(other, ["other", unit]).groupBy("way").agg(F.corr("x", "y").alias("r"))
    observed = r.where("way = 0").select(F.col("r").alias("observed"))
    return r.crossJoin(F.broadcast(observed)).agg(F.count("*").alias("ways"), F.round(F.first("observed"), 9).alias("observed"), F.round(F.avg((F.col("r") >= F.col("observed") - 1e-9).cast("double")), 9).alias("p_value"))  # one row


def kendall(df: DataFrame, x: str, y: str, by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Kendall's tau-b of two columns over any number of rows, with the counts of its pairs; null where a side is constant.

    Rows are placed in order of (x, y), then in order of (y, that place). A pair is discordant where the two orders differ, so
    all pairs come from the numbers of earlier rows with a smaller second place, and pairs that tie from counts of values. No
    pair is ever a row. Rows with a null in either column are left out.
    """
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    rows = in_order(rows, [*by, "x", "y"], "first")
    rows = in_order(rows, [*by, "y", "first"], "second")
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("first").alias("start_first"), F.min("second").alias("start_second"))
    size = size or block_size(totals.agg(F.max("n")).first()[0] or 0)
    if by:
        rows = rows.join(totals, by)
    else:
        rows = rows.crossJoin(F.broadcast(totals))  # one row
    placed = rows.select(*by, (F.col("first") - F.col("start_first")).alias("first"), (F.col("second") - F.col("start_second")).alias("second"))
    agreeing = dominated(placed, by, "first", "second", size, "agreeing").groupBy(*by).agg(F.sum("agreeing").alias("agreeing"))
    out = totals.select(*by, "n").join(agreeing, by) if by else totals.select("n").crossJoin(F.broadcast(agreeing))
    pairs = lambda m: F.expr(f"{m} * ({m} - 1) div 2")
    for name, values in (("x_tied", ["x"]), ("y_tied", ["y"]), ("both_tied", ["x", "y"])):
        own = rows.groupBy(*by, *values).agg(F.count("*").alias("m")).groupBy(*by).agg(F.sum(pairs("m")).alias(name))
        out = out.join(own, by) if by else out.crossJoin(F.broadcast(own))
    out = out.withColumn("pairs", pairs("n")).withColumn("discordant", F.col("pairs") - F.col("agreeing"))
    out = out.withColumn("concordant", F.col("pairs") - F.col("x_tied") - F.col("y_tied") + F.col("both_tied") - F.col("discordant"))
    below = F.sqrt(((F.col("pairs") - F.col("x_tied")).cast("double")) * (F.col("pairs") - F.col("y_tied")))
    return out.select(*by, "n", "concordant", "discordant", "x_tied", "y_tied", "both_tied", F.round(safe_ratio(F.col("concordant") - F.col("discordant"), below), 9).alias("tau_b"))


#: The distribution of a Poisson variable of mean 1, up to where 30 bits see no difference.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
#: The multipliers of a public 64-bit mixer.
MIXER = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def poisson_weights(h: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights (row, replicate) that depend on a row's hash, the replicate and the seed alone. Rows of one hash move together."""
    one, two = (np.uint64(m) for m in MIXER)
    x = h.view(np.uint64)[:, None] ^ ((np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 32)) * one)
    x = (x ^ (x >> np.uint64(30))) * one
    x = (x ^ (x >> np.uint64(27))) * two
    return np.searchsorted(POISSON, (x >> np.uint64(34)).astype(float) / (1 << 30), "right")


def _resampled(replicates: int, seed: int):
    """Weighted sums and sums of weights of each replicate, over the rows of a task."""

    def run(batches):
        sums, weights = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            h, v = b["h"].to_numpy(), b["v"].to_numpy(float)
            for at in range(0, len(h), 512):
                w = poisson_weights(h[at : at + 512], replicates, seed).astype(float)
                sums += v[at : at + 512] @ w
                weights += w.sum(axis=0)
        yield pd.DataFrame({"k": np.arange(replicates), "s": sums, "w": weights})

    return run


def bootstrap(decisions: DataFrame, value: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Mean of ``value`` over decisions with Poisson weights for each replicate, and their percentile interval.

    Each row's weight in a replicate is drawn from a hash of its decision and the replicate, so every part of the table can be
    resampled where it is, rows of one decision are drawn together, and repeated runs give the same result. A task sums up before
    anything is shuffled. Nulls are left out.
    """
    means = _bootstrap_means(decisions, value, [c for c in DECISION_KEY if c in decisions.columns], replicates, seed)
    return means.agg(F.count("*").alias("replicates"), F.round(F.percentile("m", 0.5), 9).alias("median"), F.round(F.percentile("m", 0.025), 9).alias("low"), F.round(F.percentile("m", 0.975), 9).alias("high"))


def _bootstrap_means(decisions: DataFrame, value: str, key: list[str], replicates: int, seed: int) -> DataFrame:
    rows = decisions.where(F.col(value).isNotNull()).select(F.xxhash64(*key).alias("h"), F.col(value).cast("double").alias("v"))
    sums = rows.mapInPandas(_resampled(replicates, seed), "k long, s double, w double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return sums.where("w > 0").select("k", (F.col("s") / F.col("w")).alias("m"))


def _weighed(edges: np.ndarray, low: float, high: float, replicates: int, seed: int):
    """Of each replicate the weights of the values below ``low``, in the bins from ``low`` to ``high`` (bin j begins at edges[j]),
    and in all."""

    def run(batches):
        bins = np.zeros((len(edges) + 2, replicates), np.int64)
        for b in batches:
            h, v = b["h"].to_numpy(), b["v"].to_numpy(float)
            bin_of = np.where(v < low, 0, np.where(v > high, len(edges) + 1, np.searchsorted(edges, v, "right")))
            for at in range(0, len(h), 512):
                own, w = bin_of[at : at + 512], poisson_weights(h[at : at + 512], replicates, seed)
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                bins[own[order][first]] += np.add.reduceat(w[order], first, axis=0)
        at, k = np.nonzero(bins)
        yield pd.DataFrame({"bin": at, "k": k, "w": bins[at, k]})

    return run


def bootstrap_medians(decisions: DataFrame, value: str, key: list[str], replicates: int = 2000, seed: int = 7, bins: int = 512) -> DataFrame:
    """(k, m): the median of ``value`` over decisions with Poisson weights, exactly, for each replicate with any weight.

    A task adds up a histogram of weights over ``bins`` bins for each replicate, and histograms are added up. With as many
    different values the bins are the values, and one pass is all; else the bins that hold the medians of all replicates, which are
    next to each other, are the range of the next pass. The driver holds bins and replicates, no rows.
    """
    spark = decisions.sparkSession
    rows = materialize(decisions.where(F.col(value).isNotNull()).select(F.xxhash64(*key).alias("h"), F.col(value).cast("double").alias("v")), "resampled")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return spark.createDataFrame([], "k long, m double")
    while True:
        inside = rows.where(F.col("v").between(low, high))
        some = sorted(r.v for r in inside.select("v").distinct().limit(bins + 1).collect())
        exact = len(some) <= bins
        edges = some if exact else sorted({low, *inside.agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 10 * bins)).first()[0]})
        summed = rows.mapInPandas(_weighed(np.array(edges), low, high, replicates, seed), "bin long, k long, w long").groupBy("k", "bin").agg(F.sum("w").alias("w"))
        along = Window.partitionBy("k").orderBy("bin")
        ends = summed.withColumn("before", F.coalesce(F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("w").over(Window.partitionBy("k")))
        # the middle weights, counted from 0: one, or two of which the mean counts
        holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("w"))
        middles = [F.max(F.when(holds(F.expr(e)), F.col("bin"))).alias(n) for n, e in (("a", "(`all` - 1) div 2"), ("b", "`all` div 2"))]
        found = ends.groupBy("k").agg(*middles)
        if exact:
            values = F.broadcast(spark.createDataFrame(list(enumerate(edges, 1)), "bin long, v double"))  # at most ``bins`` rows
            return found.join(values.withColumnsRenamed({"bin": "a", "v": "va"}), "a").join(values.withColumnsRenamed({"bin": "b", "v": "vb"}), "b").select("k", ((F.col("va") + F.col("vb")) / 2).alias("m"))
        first, last = found.agg(F.min("a"), F.max("b")).first()
        upper = edges[last] if last < len(edges) else high
        if (edges[first - 1], upper) == (low, high):  # no narrower: bins of equal widths part what these could not
            bins *= 2
        low, high = edges[first - 1], upper


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: of the sorted values those whose place is the rounded share of the last place (halves to even). ``values`` are few,
    as replicates are."""
    ranked = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("n"))
    return ranked.agg(*[F.round(F.max(F.when(F.col("place") == F.bround(F.lit(p) * (F.col("n") - 1)), F.col(column))), 9).alias(name) for name, p in shares.items()])


def cluster_bootstrap(decisions: DataFrame, key: list[str], jaccard: str = "jaccard", regret: str = "mean_cross_regret", replicates: int = 2000, seed: int = 7) -> DataFrame:
    """95 % intervals of the median Jaccard and the mean cross regret when whole decisions, each one row of ``decisions``, are drawn
    again. Weights are Poisson draws from a hash of ``key``, one for each decision and replicate."""
    ends = lambda name: {f"{name}_low": 0.025, f"{name}_high": 0.975}
    medians = nearest_rank(bootstrap_medians(decisions, jaccard, key, replicates, seed), "m", ends("median_jaccard"))
    means = nearest_rank(_bootstrap_means(decisions, regret, key, replicates, seed), "m", ends("mean_ccr"))
    counted = decisions.agg(F.count("*").alias("decisions"), F.lit(replicates).alias("replicates"))
    return counted.crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(means))  # one row each
