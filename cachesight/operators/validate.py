"""Checks of relations; each returns rows (check, detail) or counts of faults, and reads its table once or twice."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachesight.functions.scalars import finite, pseudonym
from cachesight.schema import CANONICAL, DECISION_KEY, SPLITS


def label_faults(candidates: DataFrame) -> DataFrame:
    """Losses that are null, not finite, negative or fractional, values that are not their negatives, and unknown splits."""
    y, v = F.col("y_loss"), F.col("y_value")
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    return candidates.agg(
        F.count("*").alias("row_count"), bad(~finite(y)).alias("loss_not_finite"), bad(~finite(v)).alias("value_not_finite"), bad(y < 0).alias("loss_negative"), F.count_if(finite(y) & (y != F.floor(y))).alias("loss_fractional"),
        bad(F.abs(v + y) > 1e-8).alias("sign_mismatch"), bad(~F.col("split").isin(*SPLITS)).alias("split_unknown"),
        F.when(F.count_if(F.col("split") == "val") > 0, F.count_if(F.col("split") == "validation")).otherwise(0).alias("split_named_twice"),
    )


def duplicate_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(*DECISION_KEY, "candidate_page_id").agg(F.count("*").alias("copies")).where("copies > 1")


def inconsistent_metadata(candidates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys under which one of ``columns`` has several values."""
    counts = candidates.groupBy(*key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns]))


def cross_split_ids(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("decision_id").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1).select("decision_id", F.array_join("s", "|").alias("splits"))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """All checks as (check, faults); a missing column is the only result if there is one."""
    spark = candidates.sparkSession
    missing = [c for c in CANONICAL if c not in candidates.columns]
    if missing:
        return spark.createDataFrame([(f"missing_column:{c}", 1) for c in missing], "check string, faults long")
    labels = label_faults(candidates)
    names = [c for c in labels.columns if c != "row_count"]
    out = labels.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("faults")) for c in names])).alias("p")).select("p.*")
    count = lambda df, name: df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
    narrow = ["trace_name", "capacity", "horizon", "decision_id"]
    for df, name in ((duplicate_candidates(candidates), "duplicate_candidates"), (cross_split_ids(candidates), "decision_in_several_splits"), (inconsistent_metadata(candidates, narrow, ["trace_family", "dataset_source", "decision_t", "decision_chunk_id", "split"]), "inconsistent_metadata")):
        out = out.unionByName(count(df, name))
    return out


def feature_schema_faults(df: DataFrame, features: list[str], allowed: list[str], deprecated: list[str], forbidden: list[str]) -> DataFrame:
    """(feature, fault): unknown, deprecated, leaking, constant, with nulls, or equal to another feature in every row."""
    spark = df.sparkSession
    named = [(f, kind) for f in features for kind, known in (("unknown", f not in allowed and f not in deprecated), ("deprecated", f in deprecated), ("leaks", f in forbidden)) if known]
    out = spark.createDataFrame(named, "feature string, fault string")
    pairs = list(itertools.combinations(features, 2))
    cells = [F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in features] + [(F.min(f).eqNullSafe(F.max(f))).alias(f"c_{f}") for f in features]
    cells += [(F.count_if(~F.col(a).eqNullSafe(F.col(b))) == 0).alias(f"e_{a}|{b}") for a, b in pairs]
    row = df.agg(*cells)
    found: list[Column] = [F.struct(F.lit(f).alias("feature"), F.lit("nulls").alias("fault"), (F.col(f"n_{f}") > 0).alias("is")) for f in features]
    found += [F.struct(F.lit(f).alias("feature"), F.lit("constant").alias("fault"), F.col(f"c_{f}").alias("is")) for f in features]
    found += [F.struct(F.lit(b).alias("feature"), F.lit(f"equals {a}").alias("fault"), F.col(f"`e_{a}|{b}`").alias("is")) for a, b in pairs]
    return out.unionByName(row.select(F.explode(F.array(*found)).alias("p")).select("p.*").where(F.col("is")).drop("is"))


def alias_faults(candidates: DataFrame) -> DataFrame:
    """Counts that show whether features are aliases of others or leak the label."""
    from pyspark.sql import Window

    best = F.max("candidate_lru_score").over(Window.partitionBy(*DECISION_KEY))
    rows = candidates.select("*", best.alias("best"))
    return rows.agg(
        F.count("*").alias("row_count"), F.count_if(F.abs(F.col("score_gap_to_lru_victim") - (F.col("candidate_lru_score") - F.col("best"))) > 1e-9).alias("gap_is_no_alias"),
        F.count_if(F.abs(F.col("candidate_lru_score") + F.col("candidate_age_norm") - 1) > 1e-9).alias("age_is_no_complement"), F.count_if((F.col("candidate_is_lru_victim") == 1) != (F.col("candidate_recency_rank") == 0)).alias("victim_is_no_rank_0"),
        F.count_if(F.col("candidate_lru_score") == F.col("y_loss")).alias("score_equals_loss"),
    )


def pseudonym_collisions(df: DataFrame, column: str, salt: str, digits: int = 24) -> DataFrame:
    """Pseudonyms that several values would share, were they of so many digits."""
    p = df.select(F.col(column).alias("raw"), pseudonym(F.col(column), salt, digits).alias("pseudonym")).distinct()
    return p.groupBy("pseudonym").agg(F.count("raw").alias("raw_values")).where("raw_values > 1")


def leaked_values(public: DataFrame, raw: DataFrame, raw_column: str) -> DataFrame:
    """(column, leaked): distinct values of each string column of ``public`` that are raw values."""
    strings = [f.name for f in public.schema if f.dataType.simpleString() == "string"]
    each = public.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in strings])).alias("p")).select("p.*").distinct()
    hit = each.join(raw.select(F.col(raw_column).alias("v")).distinct(), "v", "left_semi")
    base = public.sparkSession.createDataFrame([(c,) for c in strings], "column string")
    return base.join(hit.groupBy("column").agg(F.count("*").alias("n")), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("leaked"))


#: Patterns of what published tables must not hold. ``long_token`` is any run of 32 letters and digits.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "token": r"\b(?:(?:hf|ghp|gho|sk)_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "long_token": r"\b[A-Za-z0-9]{32,}\b", "absolute_path": r"(?:^|[^A-Za-z0-9_])/(?:home|Users|var|tmp|mnt|srv|opt)/[^\s`\"']|[A-Za-z]:\\[^\s`\"']",
}


def secret_scan(df: DataFrame) -> DataFrame:
    """(column, kind, row_count) over whole string columns."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    cells = [F.count_if(F.col(c).rlike(p)).alias(f"{c}|{k}") for c in strings for k, p in SECRETS.items()]
    found = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"`{c}|{k}`").alias("row_count")) for c in strings for k in SECRETS]
    return df.agg(*cells).select(F.explode(F.array(*found)).alias("p")).select("p.*")


def equal_within(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(column, differing, only_left, only_right) of two tables of one row a key."""
    x, y = a.select(*keys, *[F.col(c).alias(f"x_{c}") for c in columns], F.lit(1).alias("in_x")), b.select(*keys, *[F.col(c).alias(f"y_{c}") for c in columns], F.lit(1).alias("in_y"))
    j = x.join(y, keys, "full_outer")
    both = F.col("in_x").isNotNull() & F.col("in_y").isNotNull()
    cells = [F.count_if(both & (F.coalesce(F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) > tolerance, ~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}"))))).alias(c) for c in columns]
    row = j.agg(*cells, F.count_if(F.col("in_y").isNull()).alias("only_left"), F.count_if(F.col("in_x").isNull()).alias("only_right"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("differing")) for c in columns])).alias("p"), "only_left", "only_right").select("p.*", "only_left", "only_right")


def family_errors(selected: set[str], blocked: set[str], excluded: set[str]) -> list[str]:
    """Families that are selected though blocked or excluded, and blocked ones that nobody excluded."""
    return [*(f"selected and blocked: {f}" for f in sorted(selected & blocked)), *(f"selected and excluded: {f}" for f in sorted(selected & excluded)), *(f"blocked but not excluded: {f}" for f in sorted(blocked - excluded))]
