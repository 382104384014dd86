"""The driver's tables as candidate relations and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.operators.trace import numbered
from cachesight.schema import CANONICAL, DECISION_KEY, DEPRECATED_FEATURES
from cachesight.sources.shared import bucketed_once, deal_finely, tasks


#: Pairs that a candidate is in, about. As shuffles so have other numbers of parts than the buckets, Spark does not take the join's
#: shuffle for theirs, whose parts it would merge.
PAIR_ROWS = 2
#: Rows that a request becomes in shuffles: capacities, neighbouring parts of time, stays.
EVENT_ROWS = 4


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate relation of the driver's tables, written once in a session to the cluster's shared folder."""

    def make() -> tuple[DataFrame, int]:
        items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        deal_finely(spark, PAIR_ROWS * items.count())
        n = tasks(items)
        return made_candidates(spark, sf_dir, n), n

    return bucketed_once(spark, sf_dir, "candidates", "decision_t", make)


def made_candidates(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Orders as decisions, their line items as candidates, in ``parts`` parts by decision."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    power = lambda base, x: (F.lit(base) * F.pow(F.lit(2), x % 3)).cast("long")
    part = F.col("o_orderkey") % 10
    rows = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("tr_"), "o_orderstatus").alias("trace_name"),
        F.col("o_orderpriority").alias("trace_family"),
        F.lit("driver").alias("dataset_source"),
        power(32, F.col("o_orderkey")).alias("capacity"),
        power(4, F.col("o_custkey")).alias("horizon"),
        F.col("o_orderkey").cast("string").alias("decision_id"),
        F.col("o_orderkey").alias("decision_t"),
        F.expr("o_orderkey div 4096").alias("decision_chunk_id"),
        F.when(part < 7, "train").when(part < 9, "val").otherwise("test").alias("split"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_page_id"),
        F.floor(F.col("l_quantity") / 12).cast("double").alias("y_loss"), "l_discount", "l_tax",
    )
    rows = rows.repartition(parts, "decision_t") if parts else rows.repartition("decision_t")  # a part of each key below, so nothing is dealt out again
    once = rows.groupBy(*DECISION_KEY, "candidate_page_id").agg(F.min("y_loss").alias("y_loss"), F.min("l_discount").alias("recent_candidate_request_rate"), F.min("l_tax").alias("recent_candidate_hit_rate"))
    own = Window.partitionBy(*DECISION_KEY)
    rank = (F.row_number().over(own.orderBy("candidate_page_id")) - 1).cast("double")
    last = F.count("*").over(own) - 1
    age = F.when(last > 0, F.col("candidate_recency_rank") / last).otherwise(0.0)
    out = once.withColumn("candidate_recency_rank", rank).withColumn("candidate_age_norm", age).withColumn("candidate_lru_score", 1 - F.col("candidate_age_norm"))
    out = out.withColumns({"candidate_is_lru_victim": (F.col("candidate_recency_rank") == 0).cast("double"), "y_value": -F.col("y_loss")})
    out = out.withColumn("score_gap_to_lru_victim", F.col("candidate_lru_score") - F.max("candidate_lru_score").over(own))
    constant = {c: F.lit(0.0) for c in DEPRECATED_FEATURES} | {"candidate_is_predictor_victim": F.col("candidate_is_lru_victim"), "candidate_predictor_score": F.lit(0.5)}
    return out.withColumns(constant).select(*CANONICAL)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, t, item): events of a type as requests of their users, in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    deal_finely(spark, EVENT_ROWS * e.count())
    e = numbered(e, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"])
    return e.select(F.col("event_type").alias("trace"), F.col("t").cast("long").alias("t"), F.col("user_id").cast("string").alias("item"))
