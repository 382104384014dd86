"""The queries that show each operator on the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.functions import scalars as S
from cachesight.operators import models as M
from cachesight.operators import panels as A
from cachesight.operators import policies as P
from cachesight.operators import release
from cachesight.operators import selection as W
from cachesight.operators import trace as T
from cachesight.operators import validate as V
from cachesight.operators import views
from cachesight.schema import ACTIVE_FEATURES, DECISION_KEY, DEPRECATED_FEATURES, PARTITIONS
from cachesight.sources import files, tables
from cachesight.sources.fixtures import candidates, traces
from cachesight.sources.shared import written_once, written_path

Query = Callable[[SparkSession, str], DataFrame]
K = ", ".join(DECISION_KEY)
STRATA = ["trace_family", "capacity", "horizon"]
CAPACITIES, HORIZONS = [4, 8], [4, 8, 16]

_C = f"""
c0 AS (SELECT 'tr_' || o_orderstatus AS trace_name, o_orderpriority AS trace_family, 'driver' AS dataset_source, (32 * pow(2, o_orderkey % 3))::BIGINT AS capacity,
  (4 * pow(2, o_custkey % 3))::BIGINT AS horizon, o_orderkey::VARCHAR AS decision_id, o_orderkey AS decision_t, o_orderkey // 4096 AS decision_chunk_id,
  CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
  l_linenumber || '-' || l_partkey || '-' || l_suppkey AS candidate_page_id, min(floor(l_quantity / 12)) AS y_loss,
  min(l_discount) AS recent_candidate_request_rate, min(l_tax) AS recent_candidate_hit_rate
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
c1 AS (SELECT *, -y_loss AS y_value, (row_number() OVER (PARTITION BY {K} ORDER BY candidate_page_id) - 1)::DOUBLE AS candidate_recency_rank, count(*) OVER (PARTITION BY {K}) AS n_own,
  y_loss - min(y_loss) OVER (PARTITION BY {K}) AS regret FROM c0),
c2 AS (SELECT *, CASE WHEN n_own > 1 THEN candidate_recency_rank / (n_own - 1) ELSE 0.0 END AS candidate_age_norm, (candidate_recency_rank = 0)::INT::DOUBLE AS candidate_is_lru_victim FROM c1),
c3 AS (SELECT *, 1 - candidate_age_norm AS candidate_lru_score FROM c2),
c AS (SELECT *, candidate_lru_score - max(candidate_lru_score) OVER (PARTITION BY {K}) AS score_gap_to_lru_victim FROM c3)"""
_D = f"""{_C},
d AS (SELECT {K}, count(*) AS candidate_count, min(y_loss) AS min_y_loss, max(y_value) AS max_y_value, string_agg(candidate_page_id, '|' ORDER BY candidate_page_id) FILTER (regret = 0) AS optimal_candidate_page_ids,
  count(*) FILTER (regret = 0) AS optimal_candidate_count, count(*) FILTER (regret = 0) AS tie_count, avg(regret) AS regret_mean, stddev_pop(regret) AS regret_std, max(regret) AS regret_max, sum(regret) AS regret_sum
  FROM c GROUP BY {K})"""
_KEY_TEXT = "concat_ws('|', " + ", ".join(f"{c}::VARCHAR" for c in DECISION_KEY)
_P = f"""{_C},
p0 AS (SELECT {', '.join(f'a.{c}' for c in DECISION_KEY)}, a.candidate_page_id AS lo, b.candidate_page_id AS hi, a.y_loss AS lo_loss, b.y_loss AS hi_loss, a.regret AS lo_regret, b.regret AS hi_regret,
  a.candidate_lru_score AS lo_score, b.candidate_lru_score AS hi_score, a.recent_candidate_request_rate AS lo_rate, b.recent_candidate_request_rate AS hi_rate
  FROM c a JOIN c b USING ({K}) WHERE a.candidate_page_id < b.candidate_page_id),
p1 AS (SELECT *, ('0x' || right(sha256({_KEY_TEXT}, lo, hi, '{views.METHOD}')), 1))::INT % 2 = 1 AS swap FROM p0),
p AS (SELECT *, CASE WHEN swap THEN hi ELSE lo END AS candidate_a_page_id, CASE WHEN swap THEN lo ELSE hi END AS candidate_b_page_id, CASE WHEN swap THEN hi_loss ELSE lo_loss END AS y_loss_a,
  CASE WHEN swap THEN lo_loss ELSE hi_loss END AS y_loss_b, CASE WHEN swap THEN hi_regret ELSE lo_regret END AS regret_a, CASE WHEN swap THEN lo_regret ELSE hi_regret END AS regret_b,
  CASE WHEN swap THEN hi_score ELSE lo_score END AS score_a, CASE WHEN swap THEN lo_score ELSE hi_score END AS score_b, CASE WHEN swap THEN hi_rate ELSE lo_rate END AS rate_a, CASE WHEN swap THEN lo_rate ELSE hi_rate END AS rate_b FROM p1)"""
_PAIR = f"{K}, candidate_a_page_id, candidate_b_page_id, y_loss_a, y_loss_b, regret_a, regret_b, regret_a - regret_b AS regret_diff_a_minus_b, (regret_a < regret_b)::INT AS label_a_better, (regret_b < regret_a)::INT AS label_b_better, (regret_a = regret_b)::INT AS is_tie"
_S = f"""{_P},
draw AS (SELECT {K} FROM (SELECT DISTINCT {K} FROM c) ORDER BY sha256(concat_ws('|', '7', {', '.join(f'{c}::VARCHAR' for c in DECISION_KEY)})), {K} LIMIT 125),
s0 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY lo, hi) AS k FROM p SEMI JOIN draw USING ({K})),
s AS (SELECT * FROM s0 WHERE k <= 8 ORDER BY {K}, lo, hi LIMIT 1000)"""
_T = """
t0 AS (SELECT event_type AS trace, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, user_id::VARCHAR AS item FROM events),
t1 AS (SELECT *, lag(t) OVER (PARTITION BY trace, item ORDER BY t) AS prev, lead(t) OVER (PARTITION BY trace, item ORDER BY t) AS next FROM t0),
t2 AS (SELECT a.trace, a.t, count(*) AS distance FROM t1 a JOIN t1 b ON a.trace = b.trace AND b.t > a.prev AND b.t < a.t AND (b.prev IS NULL OR b.prev <= a.prev) GROUP BY ALL),
t AS (SELECT t1.*, CASE WHEN prev IS NULL THEN NULL ELSE coalesce(distance, 0) END AS distance FROM t1 LEFT JOIN t2 USING (trace, t))"""
_L = f"""{_T},
caps AS (SELECT unnest([4, 8])::BIGINT AS capacity),
rep AS (SELECT *, coalesce(distance < capacity, false) AS hit, NOT coalesce(distance < capacity, false) AND coalesce(sum((prev IS NULL)::INT) OVER (PARTITION BY trace, capacity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= capacity AS decision FROM t, caps),
live AS (SELECT r.trace, r.capacity, r.t, p.item AS page, p.t AS last, p.next AS again, row_number() OVER (PARTITION BY r.trace, r.capacity, r.t ORDER BY p.t DESC) AS place
  FROM rep r JOIN t1 p ON p.trace = r.trace AND p.t < r.t AND (p.next IS NULL OR p.next >= r.t) WHERE r.decision),
cand AS (SELECT trace, capacity, t, page, last, again FROM live WHERE place <= capacity)"""
_R = f"""{_L},
old AS (SELECT *, min(last) OVER (PARTITION BY trace, capacity, t) AS oldest FROM cand),
miss AS (SELECT o.trace, o.capacity, o.t, o.page, o.last, q.t - o.t AS step,
  CASE WHEN q.prev >= o.t THEN q.distance >= o.capacity WHEN q.prev >= o.oldest AND q.item <> o.page THEN q.distance - (o.last > q.prev AND (o.again IS NULL OR o.again >= q.t))::INT >= o.capacity ELSE true END AS missed
  FROM old o JOIN t q ON q.trace = o.trace AND q.t > o.t AND q.t <= o.t + 16),
labels AS (SELECT c.trace, c.capacity, c.t, c.page, c.last, h.horizon, coalesce(sum((missed AND step <= h.horizon)::INT), 0)::BIGINT AS y_loss
  FROM cand c CROSS JOIN (SELECT unnest([4, 8, 16])::BIGINT AS horizon) h LEFT JOIN miss m USING (trace, capacity, t, page, last) GROUP BY ALL),
lr AS (SELECT *, y_loss - min(y_loss) OVER (PARTITION BY trace, capacity, t, horizon) AS regret FROM labels)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _distances(s: SparkSession, d: str) -> DataFrame:
    return written_once(s, d, "distances", lambda: T.reuse_distance(traces(s, d)))


def _replay(s: SparkSession, d: str) -> DataFrame:
    return written_once(s, d, "lru_replay", lambda: T.lru_replay(traces(s, d), CAPACITIES))


def _faulty(s: SparkSession, d: str) -> DataFrame:
    """The relation with a fault of each kind planted in it."""
    c, t = candidates(s, d), F.col("decision_t")
    loss = F.when(t % 53 == 0, F.lit(None)).when(t % 59 == 0, F.lit(float("inf"))).when(t % 61 == 0, -1.0).when(t % 67 == 0, F.col("y_loss") + 0.5).otherwise(F.col("y_loss"))
    split = F.when(t % 73 == 0, "dev").when(t % 79 == 0, "validation").otherwise(F.col("split"))
    bad = c.withColumns({"y_loss": loss, "y_value": F.when(t % 71 == 0, F.col("y_value") + 1).otherwise(-loss), "split": split})
    again = bad.where(t % 83 == 0)
    other = bad.where(t % 89 == 0).withColumns({"split": F.lit("train"), "decision_chunk_id": F.lit(-1).cast("long")})
    return bad.unionByName(again).unionByName(other)


_LOSS = "CASE WHEN decision_t % 53 = 0 THEN NULL WHEN decision_t % 59 = 0 THEN 'inf'::DOUBLE WHEN decision_t % 61 = 0 THEN -1 WHEN decision_t % 67 = 0 THEN y_loss + 0.5 ELSE y_loss END"
_F = f"""f0 AS (SELECT * REPLACE ({_LOSS} AS y_loss, CASE WHEN decision_t % 71 = 0 THEN y_value + 1 ELSE -({_LOSS}) END AS y_value,
  CASE WHEN decision_t % 73 = 0 THEN 'dev' WHEN decision_t % 79 = 0 THEN 'validation' ELSE split END AS split) FROM c),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE decision_t % 83 = 0 UNION ALL SELECT * REPLACE ('train' AS split, -1 AS decision_chunk_id) FROM f0 WHERE decision_t % 89 = 0)"""
_VALIDATE = f"""SELECT 'loss_not_finite' AS "check", count(*) FILTER (y_loss IS NULL OR NOT isfinite(y_loss)) AS faults FROM f
UNION ALL SELECT 'value_not_finite', count(*) FILTER (y_value IS NULL OR NOT isfinite(y_value)) FROM f
UNION ALL SELECT 'loss_negative', count(*) FILTER (y_loss IS NULL OR y_loss < 0) FROM f
UNION ALL SELECT 'loss_fractional', count(*) FILTER (isfinite(y_loss) AND y_loss <> floor(y_loss)) FROM f
UNION ALL SELECT 'sign_mismatch', count(*) FILTER (y_loss IS NULL OR y_value IS NULL OR isnan(y_loss + y_value) OR abs(y_loss + y_value) > 1e-8) FROM f
UNION ALL SELECT 'split_unknown', count(*) FILTER (split NOT IN ('train', 'val', 'validation', 'test')) FROM f
UNION ALL SELECT 'split_named_twice', CASE WHEN count(*) FILTER (split = 'val') > 0 THEN count(*) FILTER (split = 'validation') ELSE 0 END FROM f
UNION ALL SELECT 'duplicate_candidates', count(*) FROM (SELECT {K}, candidate_page_id FROM f GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'decision_in_several_splits', count(*) FROM (SELECT decision_id FROM f GROUP BY ALL HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'inconsistent_metadata', count(*) FROM (SELECT trace_name, capacity, horizon, decision_id FROM f GROUP BY ALL
  HAVING greatest(count(DISTINCT trace_family), count(DISTINCT dataset_source), count(DISTINCT decision_t), count(DISTINCT decision_chunk_id), count(DISTINCT split)) > 1)"""


def _rollouts(s: SparkSession, d: str) -> DataFrame:
    return written_once(s, d, "rollouts", lambda: T.rollouts(traces(s, d), _distances(s, d), _replay(s, d), HORIZONS))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return T.labels_of(_rollouts(s, d), HORIZONS)


def _whole_windows(s: SparkSession, d: str) -> DataFrame:
    """Decisions of each horizon whose window ends within the trace, so that longer horizons have fewer."""
    ends = traces(s, d).groupBy("trace").agg(F.max("t").alias("end"))
    return T.rollout_summary(_rollouts(s, d), HORIZONS).join(ends, "trace").where("t + horizon <= end").drop("end")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return views.pairwise_view(candidates(s, d), include_ties=True)


def _narrow(df: DataFrame) -> DataFrame:
    return df.select(*DECISION_KEY, "candidate_a_page_id", "candidate_b_page_id", "y_loss_a", "y_loss_b", "regret_a", "regret_b", "regret_diff_a_minus_b", "label_a_better", "label_b_better", "is_tie")


def _view(s: SparkSession, d: str) -> DataFrame:
    return views.decision_view(candidates(s, d))


def _two_losses(s: SparkSession, d: str) -> DataFrame:
    """Each candidate's loss and another one made from its rates, as two continuations would give."""
    return candidates(s, d).select(*DECISION_KEY, "candidate_page_id", F.col("y_loss").alias("x"), F.floor(F.col("recent_candidate_request_rate") * 50).cast("double").alias("y"))


_X = f"{_C}, x AS (SELECT {K}, candidate_page_id, y_loss AS x, floor(recent_candidate_request_rate * 50) AS y FROM c)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d).groupBy("trace_family", "capacity").agg(F.avg("regret_mean").alias("x"), F.avg("optimal_candidate_count").alias("y"))


_CELLS = f"{_D}, cells AS (SELECT trace_family, capacity, avg(regret_mean) AS x, avg(optimal_candidate_count) AS y FROM d GROUP BY ALL)"


def _runs(s: SparkSession, d: str) -> DataFrame:
    t = traces(s, d)
    return P.simulate(t, P.execution_plan(t, CAPACITIES, ["lru"], 0))


def _linear(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    model = M.fit_linear(c.where("split = 'train'"), ACTIVE_FEATURES, "y_loss")
    return M.regression_metrics(c, M.predict_linear(model), "y_loss", ["split"])


def _logistic(s: SparkSession, d: str) -> DataFrame:
    pairs = M.counted_pairs(_pairs(s, d).withColumns({f: F.col(f"{f}_a") - F.col(f"{f}_b") for f in ACTIVE_FEATURES}), ACTIVE_FEATURES, ["split"])
    train = pairs.where("split = 'train'")
    _, scale = M.standardise(train, ACTIVE_FEATURES)
    scaled = lambda df: df.withColumns({f: (F.col(f) - m) / sd for f, (m, sd) in scale.items()})
    w = M.fit_logistic(scaled(train), ACTIVE_FEATURES, "label_a_better")
    return M.pair_metrics(scaled(pairs), M.logistic_probability(w, ACTIVE_FEATURES), ["split"])


def _panel_sql(by: str, source: str = "d") -> str:
    return f"""SELECT {by + ', ' if by else ''}count(*) AS decisions, sum(candidate_count)::BIGINT AS candidates, count(*) FILTER (regret_max = 0) AS all_tied, round(avg((regret_max = 0)::INT), 9) AS all_tied_fraction,
      round(avg(optimal_candidate_count / candidate_count), 9) AS random_optimal_probability, round(sum(optimal_candidate_count) / sum(candidate_count), 9) AS optimal_share_by_candidate, round(avg(regret_mean), 9) AS random_regret,
      round(sum(regret_sum) / sum(candidate_count), 9) AS regret_by_candidate, max(regret_max) AS regret_max, round(avg(regret_max), 9) AS mean_regret_max, round(quantile_cont(regret_mean, 0.5), 9) AS median_regret_mean,
      round(quantile_cont(regret_mean, 0.9), 9) AS p90_regret_mean, count(*) FILTER (optimal_candidate_count = 1) AS single_optimum, round(avg(optimal_candidate_count), 9) AS mean_optimal_count,
      round(count(*) FILTER (optimal_candidate_count = 1) / count(*), 9) AS single_optimum_fraction, round(quantile_cont(optimal_candidate_count / candidate_count, 0.5), 9) AS median_optimal_fraction,
      round(quantile_cont(regret_mean, 0.95), 9) AS p95_regret_mean, round(quantile_cont(regret_mean, 0.99), 9) AS p99_regret_mean, round(count(*) FILTER (regret_max >= 1) / count(*), 9) AS loss_range_ge_1,
      round(count(*) FILTER (regret_max >= 2) / count(*), 9) AS loss_range_ge_2, round(1 - avg(optimal_candidate_count / candidate_count), 9) AS random_regret_probability FROM {source}"""


_METRICS = "count(*) AS decisions, round(avg((regret <= 1e-12)::INT), 9) AS optimal_rate, round(avg(regret), 9) AS mean_regret, round(quantile_cont(regret, 0.5), 9) AS median_regret, max(regret) AS max_regret"
_VICTIMS = ", ".join(
    f"count(*) FILTER ({v}) AS {k}_victims, count(*) FILTER ({v} AND regret = 0) AS {k}_optimal, sum(CASE WHEN {v} THEN regret ELSE 0 END) AS {k}_regret_sum, round(quantile_cont(CASE WHEN {v} THEN regret END, 0.9), 9) AS {k}_regret_p90"
    for k, v in (("lru", "candidate_is_lru_victim = 1"), ("mru", "candidate_recency_rank = n_own - 1"), ("predictor", "candidate_is_lru_victim = 1"))
)
_NONTRIVIAL = [
    ("not_all_tied", "min_y_loss < (SELECT max(y_loss) FROM c WHERE c.decision_id = d.decision_id)"), ("unique_optimal_victim", "tie_count = 1"), ("optimal_set_fraction_le_0.5", "2 * tie_count <= candidate_count"),
    ("loss_range_ge_1", "regret_max > 0.999999"), ("loss_range_ge_2", "regret_max > 1.999999"),
    *((f"random_expected_regret_ge_{x}", f"regret_mean >= {x}") for x in ("0.1", "0.5", "1")),
]
_Q5 = ", ".join(f"round(quantile_cont(x, {q}), 9) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
_SUMS = ["count(*) AS n", "sum(y_loss) AS sy", "sum(y_loss * y_loss) AS syy", *[f"round(sum({c}), 6) AS s_{i}" for i, c in enumerate(ACTIVE_FEATURES)], *[f"round(sum({c} * y_loss), 6) AS sy_{i}" for i, c in enumerate(ACTIVE_FEATURES)], *[f"round(sum({ACTIVE_FEATURES[i]} * {ACTIVE_FEATURES[j]}), 6) AS s_{i}_{j}" for i in range(7) for j in range(i, 7)]]
_DIGEST = f"SELECT trace_family, capacity, count(*) AS decisions, sha256(string_agg(k16, chr(10) ORDER BY k16)) AS digest FROM (SELECT DISTINCT trace_family, capacity, sha256({_KEY_TEXT}))[1:16] AS k16 FROM c) GROUP BY ALL"
_TAX = f"""tax AS (SELECT {', '.join(f'a.{c}' for c in DECISION_KEY)}, sign(b.x - a.x) AS sx, sign(b.y - a.y) AS sy FROM x a JOIN x b USING ({K}) WHERE a.candidate_page_id < b.candidate_page_id),
tx AS (SELECT {K}, count(*) FILTER (sx <> 0 AND sx = sy) AS concordant, count(*) FILTER (sx <> 0 AND sy <> 0 AND sx <> sy) AS discordant, count(*) FILTER (sx = 0 AND sy <> 0) AS x_tied, count(*) FILTER (sx <> 0 AND sy = 0) AS y_tied, count(*) FILTER (sx = 0 AND sy = 0) AS both_tied FROM tax GROUP BY {K})"""


KINDS = {"split": "string", "trace_family": "string", "capacity": "bigint", "horizon": "bigint"}


def _release(s: SparkSession, d: str) -> str:
    """The relation as a partitioned table in the shared folder."""
    path = written_path(s, d, "release", lambda p: tables.write_partitions(candidates(s, d), p))
    return path


def _shards(s: SparkSession, d: str) -> DataFrame:
    """Names of shards as uploads have them: in folders of their family, or by a prefix, with families that begin alike."""
    each = candidates(s, d).select("trace_family", "capacity", "split").distinct()
    short = F.substring("trace_family", 1, 3)
    names = F.array(F.concat(F.lit("x/trace_family="), "trace_family", F.lit("/part_"), "capacity"), F.concat(F.lit("up/"), "trace_family", F.lit("_cap"), "capacity", F.lit("_"), "split", F.lit(".csv")), F.concat(short, F.lit("_"), "capacity", F.lit("_"), "split"), F.concat(F.lit("other_"), "trace_family", F.lit("_"), "split"))
    return each.select(F.explode(names).alias("path")).distinct()


def _known(s: SparkSession, d: str) -> DataFrame:
    c = candidates(s, d)
    return c.select(F.explode(F.array("trace_family", F.substring("trace_family", 1, 3), F.concat("trace_family", F.lit("_cap"), "capacity"))).alias("name"))


def _linked(s: SparkSession, d: str) -> DataFrame:
    """What victims lose offline, and how often they would be asked for again, which stands for the miss ratio of a closed loop."""
    cell = ["trace_family", "capacity", "horizon"]
    rows = candidates(s, d)
    last = F.count("*").over(Window.partitionBy(*DECISION_KEY)) - 1
    regret = F.col("y_loss") - F.min("y_loss").over(Window.partitionBy(*DECISION_KEY))
    rows = rows.withColumn("regret", regret).withColumn("is_mru", F.col("candidate_recency_rank") == last).withColumn("is_lru", F.col("candidate_is_lru_victim") == 1)
    when = lambda c, v: F.avg(F.when(F.col(c), F.col(v)))
    victims = rows.groupBy(*cell).agg(F.round(when("is_lru", "regret"), 9).alias("offline_lru_regret"), F.round(when("is_mru", "regret"), 9).alias("offline_mru_regret"))
    drawn = rows.groupBy(*cell).agg(F.round(F.avg("regret"), 9).alias("offline_random_regret"))
    rate = "recent_candidate_request_rate"
    closed = rows.groupBy("trace_family", "capacity").agg(F.round(when("is_lru", rate), 9).alias("lru_miss_ratio"), F.round(when("is_mru", rate), 9).alias("mru_miss_ratio"), F.round(F.avg(rate), 9).alias("random_miss_ratio"))
    return views.linkage(victims, drawn, closed, cell)


_LINK = """l0 AS (SELECT *, y_loss - min(y_loss) OVER (PARTITION BY {K}) AS rg, candidate_recency_rank = count(*) OVER (PARTITION BY {K}) - 1 AS is_mru, candidate_is_lru_victim = 1 AS is_lru FROM c),
off AS (SELECT trace_family, capacity, horizon, round(avg(rg) FILTER (is_lru), 9) AS a, round(avg(rg) FILTER (is_mru), 9) AS b, round(avg(rg), 9) AS r FROM l0 GROUP BY ALL),
cl AS (SELECT trace_family, capacity, round(avg(recent_candidate_request_rate) FILTER (is_lru), 9) AS x, round(avg(recent_candidate_request_rate) FILTER (is_mru), 9) AS y, round(avg(recent_candidate_request_rate), 9) AS z FROM l0 GROUP BY ALL)"""


def _written_shards(s: SparkSession, d: str, path: str) -> None:
    """Shards of drifting headers: text with a column less and one more, whose values have to be quoted, and Parquet."""
    c = candidates(s, d)
    c.where("decision_t % 2 = 1").drop("request_bucket").withColumn("more", F.lit('x, "y"')).write.option("header", True).option("escape", '"').csv(f"{path}/a")
    c.where("decision_t % 2 = 0").write.parquet(f"{path}/b")


def _damaged(s: SparkSession, d: str, path: str) -> None:
    """A release to which rows were added afterwards: some a second time, and some of a family that it leaves out."""
    c = candidates(s, d)
    release.build(s, c, path, ("5-LOW",), 1000, 8)
    more = c.where("trace_family <> '5-LOW' AND decision_t % 83 = 0").unionByName(c.where("trace_family = '5-LOW' AND capacity = 32"))
    more.write.mode("append").partitionBy(*PARTITIONS).parquet(f"{path}/candidate_rows")


def _gates(s: SparkSession, d: str) -> DataFrame:
    """Replays as runs, with one that is missing, some twice, failed or unplanned, and some whose counts do not agree."""
    c = lambda cond: F.count_if(cond)
    whole = _replay(s, d).groupBy("trace", "capacity").agg(F.count("*").alias("requests"), c(F.col("hit")).alias("hits"), c(~F.col("hit")).alias("misses"), c(F.col("decision")).alias("evictions"))
    whole = whole.withColumns({"policy": F.lit("lru"), "seed": F.lit(0), "status": F.lit("complete")})
    plan, at = whole.select("trace", "capacity", "policy", "seed"), F.col("trace")
    runs = whole.where("trace <> 'view' OR capacity <> 8").withColumns({"hits": F.col("hits") + (at == "click").cast("int"), "evictions": F.when(at == "error", F.col("misses") + 1).otherwise(F.col("evictions")), "status": F.when(at == "signup", "failed").otherwise(F.col("status"))})
    return P.run_gates(runs.unionByName(whole.where("trace = 'purchase'")).unionByName(whole.where("trace = 'view'").withColumn("trace", F.lit("other"))), plan)


def _compacted(s: SparkSession, d: str, path: str) -> None:
    """The relation in many small files, merged."""
    candidates(s, d).repartition(8, "candidate_page_id").write.partitionBy("trace_family", "split").parquet(path)
    files.compact(s, path, order=("decision_t", "decision_id", "candidate_page_id"))


def _trace_files(s: SparkSession, d: str, path: str) -> None:
    """The trace of views as files of requests, some lines of which are blank or none."""
    t = traces(s, d).where("trace = 'view'")
    good = F.to_json(F.struct(F.col("item").alias("item_id")))
    lines = F.when(F.col("t") % 50 == 7, F.concat(F.lit('{"item_id": \n\n'), good)).otherwise(good)
    t.withColumn("value", lines).orderBy("t").select("value").write.text(path)


def _entries() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    q["candidates"] = lambda s, d: _rounded(candidates(s, d).drop(*DEPRECATED_FEATURES), "candidate_age_norm", "candidate_lru_score", "score_gap_to_lru_victim"), f"WITH {_C} SELECT * EXCLUDE (n_own, regret) REPLACE (round(candidate_age_norm, 9) AS candidate_age_norm, round(candidate_lru_score, 9) AS candidate_lru_score, round(score_gap_to_lru_victim, 9) AS score_gap_to_lru_victim) FROM c"
    q["decision_view"] = lambda s, d: _rounded(_view(s, d), "regret_mean", "regret_std"), f"WITH {_D} SELECT * REPLACE (round(regret_mean, 9) AS regret_mean, round(regret_std, 9) AS regret_std) FROM d"
    q["regret_attach"] = lambda s, d: views.attach_regret(candidates(s, d)).select(*DECISION_KEY, "candidate_page_id", "y_loss", "regret"), f"WITH {_C} SELECT {K}, candidate_page_id, y_loss, regret FROM c"
    q["pairwise_view"] = lambda s, d: _narrow(views.pairwise_view(candidates(s, d))), f"WITH {_P} SELECT {_PAIR} FROM p WHERE regret_a <> regret_b"
    q["pairwise_view_ties"] = lambda s, d: _narrow(_pairs(s, d)), f"WITH {_P} SELECT {_PAIR} FROM p"
    q["pairwise_sample"] = lambda s, d: _narrow(views.pairwise_sample(candidates(s, d), 1000, 8)), f"WITH {_S} SELECT {_PAIR} FROM s"
    q["augmented_pairwise"] = lambda s, d: views.augment_pairs(_narrow(views.pairwise_sample(candidates(s, d), 1000, 8)), candidates(s, d), ["candidate_lru_score", "recent_candidate_request_rate"]).withColumns({f"candidate_lru_score_{x}": F.round(f"candidate_lru_score_{x}", 9) for x in "ab"}), f"WITH {_S} SELECT {_PAIR}, round(score_a, 9) AS candidate_lru_score_a, round(score_b, 9) AS candidate_lru_score_b, rate_a AS recent_candidate_request_rate_a, rate_b AS recent_candidate_request_rate_b FROM s"
    q["split_summary"] = lambda s, d: views.split_summary(candidates(s, d)), f"WITH {_C} SELECT split, trace_family, capacity, horizon, count(*) AS row_count, count(DISTINCT decision_id) AS decision_count FROM c GROUP BY ALL"
    q["split_summary_runs"] = lambda s, d: views.split_summary_runs(candidates(s, d), ["candidate_page_id", "decision_t"]), f"WITH {_C}, o AS (SELECT split, trace_family, capacity, horizon, decision_id, lag(decision_id) OVER (PARTITION BY split, trace_family, capacity, horizon ORDER BY candidate_page_id, decision_t) AS before FROM c) SELECT split, trace_family, capacity, horizon, count(*) AS row_count, sum((before IS DISTINCT FROM decision_id)::INT)::BIGINT AS decision_count FROM o GROUP BY ALL"
    q["matched_population"] = lambda s, d: views.matched_population(candidates(s, d).withColumns({"decision_id": F.lit("any"), "decision_t": F.lit(0).cast("long"), "decision_chunk_id": F.lit(0).cast("long")}), 8).select("trace_name", "trace_family", "capacity", "split", F.array_join(F.transform("horizons", lambda x: x.cast("string")), "|").alias("horizons")), f"WITH {_C}, h AS (SELECT DISTINCT trace_name, trace_family, capacity, split, horizon FROM c) SELECT trace_name, trace_family, capacity, split, string_agg(horizon::VARCHAR, '|' ORDER BY horizon) AS horizons FROM h GROUP BY ALL HAVING bool_or(horizon = 8)"
    q["population_digests"] = lambda s, d: views.population_digests(candidates(s, d)), f"WITH {_C} {_DIGEST}"
    q["discriminativeness"] = lambda s, d: A.discriminativeness(_view(s, d)), f"WITH {_D} {_panel_sql('')}"
    q["discriminativeness_strata"] = lambda s, d: A.discriminativeness_sets(_view(s, d), STRATA), f"WITH {_D} {_panel_sql(', '.join(STRATA))} GROUP BY GROUPING SETS ((), ({', '.join(STRATA)}))"
    for by in ("split", "candidate_count", "horizon"):
        q[f"discriminativeness_by_{by}"] = (lambda s, d, by=by: A.discriminativeness(_view(s, d), [by])), f"WITH {_D} {_panel_sql(by)} GROUP BY {by}"
    sub = " UNION ALL ".join(f"SELECT '{k}' AS subset, * FROM d WHERE {p}" for k, p in _NONTRIVIAL)
    for name, by in (("nontrivial_subsets", []), ("nontrivial_subsets_by_family", ["trace_family"]), ("nontrivial_subsets_by_capacity", ["capacity"]), ("nontrivial_subsets_by_horizon", ["horizon"])):
        c = "".join(f"{b}, " for b in by)
        q[name] = (lambda s, d, by=by: A.nontrivial_subsets(_view(s, d), by)), f"WITH {_D}, u AS ({sub}), w AS (SELECT {c}count(*) AS n, sum(candidate_count) AS nc FROM d {'GROUP BY ALL' if by else ''}) SELECT {c}subset, count(*) AS decisions, round(count(*) / max(n), 9) AS coverage, sum(candidate_count)::BIGINT AS candidates, round(sum(candidate_count) / max(nc), 9) AS candidate_coverage, round(avg(regret_mean), 9) AS mean_regret, round(quantile_cont(regret_mean, 0.5), 9) AS median_regret FROM u {f'JOIN w USING ({by[0]})' if by else 'CROSS JOIN w'} GROUP BY {c}subset"
    hist = f"count(*) AS candidates, count(*) FILTER (regret >= 1) AS regret_ge_1, count(*) FILTER (regret >= 2) AS regret_ge_2, count(*) FILTER (regret >= 3) AS regret_ge_3, count(*) FILTER (regret = 0) AS regret_0, {_VICTIMS}"
    q["candidate_regret"] = lambda s, d: A.candidate_regret(candidates(s, d)), f"WITH {_C} SELECT {hist} FROM c"
    q["candidate_regret_by_family"] = lambda s, d: A.candidate_regret(candidates(s, d), ["trace_family"]), f"WITH {_C} SELECT trace_family, {hist} FROM c GROUP BY trace_family"
    panel = "count(*) AS pairs, sum((regret_a = regret_b)::INT)::BIGINT AS ties, sum((regret_a < regret_b)::INT)::BIGINT AS a_better, sum((regret_b < regret_a)::INT)::BIGINT AS b_better, count(DISTINCT decision_id) AS decisions, round(avg((regret_a = regret_b)::INT), 9) AS tie_fraction"
    q["pair_panel"] = lambda s, d: A.pair_panel(_narrow(_pairs(s, d)), ["trace_family"]), f"WITH {_P} SELECT trace_family, {panel} FROM p GROUP BY trace_family"
    q["pair_universe"] = lambda s, d: A.pair_universe(_view(s, d), ["trace_family", "capacity"]), f"WITH {_D} SELECT trace_family, capacity, sum(candidate_count * (candidate_count - 1) // 2)::BIGINT AS pairs, max(candidate_count) AS largest FROM d GROUP BY ALL"
    q["strict_density"] = lambda s, d: A.strict_density(candidates(s, d), ["capacity", "horizon"]), f"WITH {_P} SELECT capacity, horizon, count(*) AS pairs, count(*) FILTER (regret_a = regret_b) AS equal_pairs, round(count(*) FILTER (regret_a <> regret_b) / count(*), 9) AS strict_density FROM p GROUP BY ALL"
    keys = ["split", "trace_family"]
    q["label_stats"] = lambda s, d: A.numeric_summary(candidates(s, d).withColumn("y_value", F.col("y_value") + 0.0), ["y_loss", "y_value"], [[], keys]), f"WITH {_C}, l AS (SELECT 'y_loss' AS target, split, trace_family, y_loss AS x FROM c UNION ALL SELECT 'y_value', split, trace_family, y_value + 0.0 FROM c) SELECT target, split, trace_family, count(x) AS n, count(*) FILTER (x IS NULL) AS missing, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS least, max(x) AS largest, {_Q5} FROM l GROUP BY GROUPING SETS ((target), (target, split, trace_family))"
    prof = ["capacity", "y_loss", "candidate_recency_rank", "recent_candidate_request_rate"]
    q["feature_profile"] = lambda s, d: A.feature_profile(candidates(s, d), prof), f"WITH {_C} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS distinct_values, count(*) FILTER ({f} IS NULL) AS nulls, min({f})::DOUBLE AS least, max({f})::DOUBLE AS largest FROM c" for f in prof)
    q["weighted_pool"] = lambda s, d: A.weighted_pool(_view(s, d).withColumn("candidate_count", F.col("candidate_count").cast("long")), "regret_mean", "candidate_count", ["capacity"]), f"WITH {_D} SELECT capacity, sum(candidate_count)::BIGINT AS weight, round(sum(regret_mean * candidate_count) / sum(candidate_count), 9) AS pooled FROM d GROUP BY capacity"
    q["seed_summary"] = lambda s, d: A.seed_summary(_cells(s, d), ["trace_family"], "x", 3), f"WITH {_CELLS} SELECT trace_family, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, min(x) AS least, max(x) AS largest, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(x)), 9) AS low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(x)), 9) AS high, CASE WHEN count(x) = 0 THEN 'no_complete_seeds' WHEN count(x) < 3 THEN 'partial' ELSE 'complete' END AS status FROM cells GROUP BY trace_family"
    q["seed_summary"] = (lambda s, d: _rounded(A.seed_summary(_cells(s, d), ["trace_family"], "x", 3), "least", "largest")), q["seed_summary"][1].replace("min(x) AS least, max(x) AS largest", "round(min(x), 9) AS least, round(max(x), 9) AS largest")
    best = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}, candidate_page_id) AS place FROM c"
    lru = f"WITH {_C}, b AS ({best.format(k=K, o='candidate_lru_score DESC')})"
    q["best_candidate_lru"] = lambda s, d: _rounded(W.best_candidate(candidates(s, d), F.col("candidate_lru_score")), "score"), f"{lru} SELECT {K}, candidate_page_id, y_loss, round(candidate_lru_score, 9) AS score, regret FROM b WHERE place = 1"
    score = lambda: S.linear_score(0.5, {"recent_candidate_request_rate": 8.0, "candidate_recency_rank": -0.25}, {})
    lin = f"WITH {_C}, b AS ({best.format(k=K, o='0.5 + recent_candidate_request_rate * 8.0 + candidate_recency_rank * -0.25')})"
    q["best_candidate_linear"] = lambda s, d: W.best_candidate(candidates(s, d), score(), largest=False).drop("score"), f"{lin} SELECT {K}, candidate_page_id, y_loss, regret FROM b WHERE place = 1"
    q["best_candidate_metrics"] = lambda s, d: W.selection_metrics(W.best_candidate(candidates(s, d), F.col("candidate_lru_score")), ["trace_family", "capacity"]), f"{lru} SELECT trace_family, capacity, {_METRICS} FROM b WHERE place = 1 GROUP BY ALL"
    q["sample_bottom_n"] = lambda s, d: W.bottom_sample(candidates(s, d).select(*DECISION_KEY, "candidate_page_id"), 20, ["capacity"], ["decision_id", "candidate_page_id"], 7).select("capacity", "decision_id", "candidate_page_id", "sample_rank"), f"WITH {_C}, h AS (SELECT capacity, decision_id, candidate_page_id, row_number() OVER (PARTITION BY capacity ORDER BY sha256(concat_ws('|', '7', decision_id, candidate_page_id))[1:16], decision_id, candidate_page_id)::INT AS sample_rank FROM c) SELECT * FROM h WHERE sample_rank <= 20"
    q["stratified_sample"] = lambda s, d: W.stratified_sample(_view(s, d).withColumn("tied", (F.col("regret_max") == 0).cast("int")), "tied", 100, ["decision_id"], 7).groupBy("tied").agg(F.count("*").alias("n"), F.min("decision_id").alias("first_id"), F.max("decision_id").alias("last_id")), f"""WITH {_D}, v AS (SELECT *, (regret_max = 0)::INT AS tied FROM d), z AS (SELECT tied, count(*) AS size FROM v GROUP BY tied), e AS (SELECT *, size * 100 / sum(size) OVER () AS exact FROM z),
      f AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, tied) AS place FROM e), g AS (SELECT tied, least(size, base + (place <= 100 - sum(base) OVER ())::INT) AS take FROM f),
      h AS (SELECT v.tied, decision_id, row_number() OVER (PARTITION BY v.tied ORDER BY sha256(concat_ws('|', '7', decision_id))[1:16], decision_id) AS r FROM v) SELECT tied, count(*) AS n, min(decision_id) AS first_id, max(decision_id) AS last_id FROM h JOIN g USING (tied) WHERE r <= take GROUP BY tied"""
    q["top_decile_sample"] = lambda s, d: W.top_decile_sample(_view(s, d), 10, 7).select("trace_family", "decision_id", "regret_sum"), f"WITH {_D}, a AS (SELECT *, row_number() OVER (PARTITION BY trace_family ORDER BY regret_sum DESC, {K}) AS place, count(*) OVER (PARTITION BY trace_family) AS size FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY trace_family ORDER BY sha256(concat_ws('|', '7', {', '.join(f'{c}::VARCHAR' for c in DECISION_KEY)}))[1:16], {K}) AS r FROM a WHERE place <= greatest(1, size // 10)) SELECT trace_family, decision_id, regret_sum FROM b WHERE r <= 10"
    q["key_difference"] = lambda s, d: W.key_difference(candidates(s, d).where("y_loss >= 1"), candidates(s, d).where("y_loss <= 2"), ["decision_id"]), f"WITH {_C}, a AS (SELECT DISTINCT decision_id FROM c WHERE y_loss >= 1), b AS (SELECT DISTINCT decision_id FROM c WHERE y_loss <= 2) SELECT decision_id, 'left' AS only_in FROM a ANTI JOIN b USING (decision_id) UNION ALL SELECT decision_id, 'right' FROM b ANTI JOIN a USING (decision_id)"
    q["auroc_midrank"] = lambda s, d: W.midrank_auroc(candidates(s, d).select("split", F.col("recent_candidate_request_rate").alias("score"), (F.col("y_loss") >= 2).cast("int").alias("label")), ["split"]), f"WITH {_C}, m AS (SELECT split, (y_loss >= 2)::INT AS label, rank() OVER (PARTITION BY split ORDER BY recent_candidate_request_rate) + (count(*) OVER (PARTITION BY split, recent_candidate_request_rate) - 1) / 2 AS mid FROM c) SELECT split, count(*) AS n, sum(label)::BIGINT AS positives, round((sum(mid * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auroc FROM m GROUP BY split"
    sums = lambda df: df.select(*[F.round(c, 6).alias(c) if c.startswith("s_") or c.startswith("sy_") else F.col(c) for c in df.columns])
    q["normal_equation_sums"] = lambda s, d: sums(M.normal_sums(candidates(s, d), ACTIVE_FEATURES, "y_loss")), f"WITH {_C} SELECT {', '.join(_SUMS)} FROM c"
    q["linear_regression_eval"] = _linear, None
    q["regression_eval"] = lambda s, d: M.regression_metrics(candidates(s, d), F.col("recent_candidate_request_rate") * 20, "y_loss", ["split"], 1.5), f"WITH {_C} SELECT split, count(*) AS n, round(avg(abs(y_loss - recent_candidate_request_rate * 20)), 9) AS mae, round(sqrt(avg((y_loss - recent_candidate_request_rate * 20) ** 2)), 9) AS rmse, round(1 - sum((y_loss - recent_candidate_request_rate * 20) ** 2) / (var_pop(y_loss) * count(*)), 9) AS r2, round(avg(abs(y_loss - 1.5)), 9) AS constant_mae, round(sqrt(avg((y_loss - 1.5) ** 2)), 9) AS constant_rmse FROM c GROUP BY split"
    q["pair_metrics"] = lambda s, d: M.pair_metrics(_pairs(s, d), 1 / (1 + F.exp(F.col("recent_candidate_request_rate_a") * 10 - F.col("recent_candidate_request_rate_b") * 10)), ["split"]), f"""WITH {_P}, m AS (SELECT split, (regret_a < regret_b)::INT AS y, greatest(least(1 / (1 + exp(rate_a * 10 - rate_b * 10)), 1 - 1e-12), 1e-12) AS pr FROM p WHERE regret_a <> regret_b),
      k AS (SELECT split, count(*) FILTER (pr >= 0.5 AND y = 1) AS tp, count(*) FILTER (pr >= 0.5 AND y = 0) AS fp, count(*) FILTER (pr < 0.5 AND y = 1) AS fn, count(*) FILTER (pr < 0.5 AND y = 0) AS tn, avg(CASE WHEN y = 1 THEN -ln(pr) ELSE -ln(1 - pr) END) AS loss FROM m GROUP BY split)
      SELECT split, tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(loss, 9) AS log_loss, round(tp / (tp + fn), 9) AS recall_a, round(tn / (tn + fp), 9) AS recall_b, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1 FROM k"""
    q["pairwise_logistic"] = _logistic, None
    own = [*DECISION_KEY, "candidate_a_page_id", "candidate_b_page_id"]
    y = f"{_P}, y AS (SELECT *, (regret_a < regret_b)::INT AS y FROM p WHERE regret_a <> regret_b)"
    q["majority_baseline"] = lambda s, d: M.majority_baseline(_pairs(s, d), ["split"]), f"WITH {y}, m AS (SELECT avg(y) AS share FROM y WHERE split = 'train') SELECT split, count(*) AS n, round(avg(y), 9) AS positive_rate, round(avg(((share >= 0.5)::INT = y)::INT), 9) AS accuracy, round(avg(CASE WHEN y = 1 THEN -ln(share) ELSE -ln(1 - share) END), 9) AS log_loss FROM y, m GROUP BY split"
    q["random_baseline"] = lambda s, d: M.random_baseline(_pairs(s, d), own, ["split"]), f"WITH {y}, g AS (SELECT *, ('0x' || right(sha256(concat_ws('|', '7', {', '.join(f'{c}::VARCHAR' for c in own)})), 1))::INT % 2 AS guess FROM y) SELECT split, count(*) AS n, round(avg(y), 9) AS positive_rate, round(avg((guess = y)::INT), 9) AS accuracy, round(ln(2), 9) AS log_loss FROM g GROUP BY split"
    z = 1.959963984540054
    q["raw_score_accuracy"] = lambda s, d: M.raw_score_accuracy(_pairs(s, d), "candidate_lru_score", ["split"]), f"""WITH {y}, h AS (SELECT split, count(*) AS n, avg(((score_a > score_b)::INT = y)::INT) AS a FROM y GROUP BY split)
      SELECT split, n, round(a, 9) AS accuracy, round((a + {z}^2 / (2 * n) - {z} * sqrt(a * (1 - a) / n + {z}^2 / (4 * n * n))) / (1 + {z}^2 / n), 9) AS low, round((a + {z}^2 / (2 * n) + {z} * sqrt(a * (1 - a) / n + {z}^2 / (4 * n * n))) / (1 + {z}^2 / n), 9) AS high FROM h"""
    q["calibrated_lru_score"] = lambda s, d: M.calibrated_score(_pairs(s, d), F.col("candidate_lru_score_a") - F.col("candidate_lru_score_b"), ["split"]), None
    q["calibrated_rate"] = lambda s, d: M.calibrated_score(_pairs(s, d), F.col("recent_candidate_request_rate_b") - F.col("recent_candidate_request_rate_a"), ["split"]), None
    q["optimal_set_agreement"] = lambda s, d: M.optimal_set_agreement(_two_losses(s, d), DECISION_KEY), f"WITH {_X}, y AS (SELECT *, x - min(x) OVER (PARTITION BY {K}) AS rx, y - min(y) OVER (PARTITION BY {K}) AS ry FROM x) SELECT {K}, round(count(*) FILTER (rx = 0 AND ry = 0) / count(*) FILTER (rx = 0 OR ry = 0), 9) AS jaccard, round(avg(ry) FILTER (rx = 0), 9) AS mean_cross_regret, min(ry) FILTER (rx = 0) AS best_cross_regret, max(ry) FILTER (rx = 0) AS worst_cross_regret, round(avg((ry = 0)::INT) FILTER (rx = 0), 9) AS still_optimal FROM y GROUP BY {K}"
    cast = "concordant::BIGINT AS concordant, discordant::BIGINT AS discordant, x_tied::BIGINT AS x_tied, y_tied::BIGINT AS y_tied, both_tied::BIGINT AS both_tied"
    q["pair_taxonomy"] = lambda s, d: M.pair_taxonomy(_two_losses(s, d), DECISION_KEY).where("concordant + discordant + x_tied + y_tied + both_tied > 0"), f"WITH {_X}, {_TAX} SELECT {K}, {cast} FROM tx"
    q["kendall_tau_b"] = lambda s, d: M.kendall_tau_b(M.pair_taxonomy(_two_losses(s, d), DECISION_KEY), DECISION_KEY).where("tau_b IS NOT NULL"), f"WITH {_X}, {_TAX} SELECT {K}, round((concordant - discordant) / sqrt((concordant + discordant + x_tied) * (concordant + discordant + y_tied)::DOUBLE), 9) AS tau_b FROM tx WHERE (concordant + discordant + x_tied) * (concordant + discordant + y_tied) > 0"
    both = f"""ag AS (SELECT {K}, count(*) FILTER (rx = 0 AND ry = 0) / count(*) FILTER (rx = 0 OR ry = 0) AS j, avg(ry) FILTER (rx = 0) AS m, avg((ry = 0)::INT) FILTER (rx = 0) AS o, max(rx) > 0 AS tx, max(ry) > 0 AS ty
      FROM (SELECT *, x - min(x) OVER (PARTITION BY {K}) AS rx, y - min(y) OVER (PARTITION BY {K}) AS ry FROM x) GROUP BY {K}),
      sets AS (SELECT 'A_all' AS subset, * FROM ag UNION ALL SELECT 'B_not_both_tied', * FROM ag WHERE tx OR ty UNION ALL SELECT 'C_telling_first', * FROM ag WHERE tx UNION ALL SELECT 'D_telling_either', * FROM ag WHERE tx OR ty),
      su AS (SELECT capacity, subset, count(*) AS decisions, round(avg(round(j, 9)), 9) AS mean_jaccard, round(median(round(j, 9)), 9) AS median_jaccard, round(min(j), 9) AS least_jaccard,
      {', '.join(f'coalesce(sum({k}), 0)::BIGINT AS {k}' for k in ('concordant', 'discordant', 'x_tied', 'y_tied', 'both_tied'))},
      round(sum(discordant) / nullif(sum(concordant + discordant + x_tied + y_tied + both_tied), 0), 9) AS reversals, round(avg(round(m, 9)), 9) AS mean_ccr, round(max(m), 9) AS largest_ccr,
      round(avg((m = 0)::INT), 9) AS ccr_zero, round(avg((m <= 1)::INT), 9) AS ccr_at_most_1, round(avg(round(o, 9)), 9) AS still_optimal FROM sets LEFT JOIN tx USING ({K}) GROUP BY capacity, subset)"""
    q["continuation_summary"] = lambda s, d: M.continuation_summary(_two_losses(s, d), DECISION_KEY, ["capacity"]), f"WITH {_X}, {_TAX}, {both} SELECT * FROM su"
    q["continuation_class"] = lambda s, d: M.continuation_class(_two_losses(s, d), DECISION_KEY, ["capacity"]), f"""WITH {_X}, {_TAX}, {both}, o AS (SELECT capacity, max(median_jaccard) FILTER (subset = 'C_telling_first') AS median_jaccard, max(ccr_at_most_1) FILTER (subset = 'C_telling_first') AS ccr_at_most_1 FROM su GROUP BY capacity)
      SELECT *, CASE WHEN median_jaccard IS NULL OR ccr_at_most_1 IS NULL THEN 'INCONCLUSIVE' WHEN median_jaccard >= 0.8 AND ccr_at_most_1 >= 0.8 THEN 'ROBUST' WHEN median_jaccard < 0.5 OR ccr_at_most_1 < 0.2 THEN 'SENSITIVE' ELSE 'CONDITIONALLY_ROBUST' END AS class FROM o"""
    q["gap_correlations"] = lambda s, d: M.correlations(_two_losses(s, d), "x", "y", ["capacity"]), f"WITH {_X}, r AS (SELECT *, rank() OVER (PARTITION BY capacity ORDER BY x) + (count(*) OVER (PARTITION BY capacity, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY capacity ORDER BY y) + (count(*) OVER (PARTITION BY capacity, y) - 1) / 2 AS ry FROM x) SELECT capacity, count(*) AS n, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY capacity"
    q["concordance"] = lambda s, d: M.concordance(_two_losses(s, d).withColumns({"x": F.col("x") - 2, "y": F.col("y") - 2}), "x", "y", ["capacity"]), f"WITH {_X} SELECT capacity, CASE WHEN x = 2 AND y = 2 THEN 'both_tied' WHEN x = 2 THEN 'offline_tie_only' WHEN y = 2 THEN 'closed_loop_tie_only' WHEN sign(x - 2) = sign(y - 2) THEN 'concordant' ELSE 'discordant' END AS kind, count(*) AS n FROM x GROUP BY ALL"
    q["leave_one_out"] = lambda s, d: M.leave_one_out(_two_losses(s, d), "trace_family", "x", "y"), f"WITH {_X} SELECT f.trace_family AS left_out, count(*) AS n, round(corr(x, y), 9) AS pearson FROM x JOIN (SELECT DISTINCT trace_family FROM x) f ON f.trace_family <> x.trace_family GROUP BY f.trace_family"
    q["permutation_p"] = lambda s, d: M.permutation_p(_cells(s, d), "trace_family", "capacity", "x", "y"), f"""WITH {_CELLS}, f AS (SELECT trace_family, row_number() OVER (ORDER BY trace_family) AS k FROM (SELECT DISTINCT trace_family FROM cells)), n AS (SELECT unnest(range(1, 6)) AS k),
      w AS (SELECT [a.k, b.k, c.k, e.k, g.k] AS p FROM n a, n b, n c, n e, n g WHERE len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5), o AS (SELECT p, unnest(range(1, 6)) AS own, unnest(p) AS other FROM w),
      r AS (SELECT p, corr(u.x, v.y) AS r FROM o JOIN f a ON a.k = own JOIN f b ON b.k = other JOIN cells u ON u.trace_family = a.trace_family JOIN cells v ON v.trace_family = b.trace_family AND v.capacity = u.capacity GROUP BY p), z AS (SELECT r AS observed FROM r WHERE p = [1, 2, 3, 4, 5])
      SELECT count(*) AS ways, round(max(observed), 9) AS observed, round(avg((r >= observed - 1e-9)::INT), 9) AS p_value FROM r, z"""
    pair = lambda c: f"coalesce(sum(CASE WHEN a.x = b.x AND a.y = b.y THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) FILTER ({c}), 0)::BIGINT"
    q["kendall_whole"] = lambda s, d: M.kendall(candidates(s, d).withColumn("y", F.col("y_loss") * 100 + F.col("recent_candidate_hit_rate")), "recent_candidate_request_rate", "y", ["trace_family"]), f"""WITH {_C}, h AS (SELECT trace_family, recent_candidate_request_rate AS x, y_loss * 100 + recent_candidate_hit_rate AS y, count(*) AS n FROM c GROUP BY ALL),
      p AS (SELECT trace_family, {pair('(b.x - a.x) * (b.y - a.y) > 0')} AS concordant, {pair('(b.x - a.x) * (b.y - a.y) < 0')} AS discordant, {pair('a.x = b.x')} AS x_tied, {pair('a.y = b.y')} AS y_tied, {pair('a.x = b.x AND a.y = b.y')} AS both_tied
        FROM h a JOIN h b USING (trace_family) WHERE a.x < b.x OR (a.x = b.x AND a.y <= b.y) GROUP BY trace_family), t AS (SELECT trace_family, count(*) AS n FROM c GROUP BY ALL)
      SELECT trace_family, n, concordant, discordant, x_tied, y_tied, both_tied, round((concordant - discordant) / sqrt((n * (n - 1) // 2 - x_tied)::DOUBLE * (n * (n - 1) // 2 - y_tied)), 9) AS tau_b FROM p JOIN t USING (trace_family)"""
    q["cluster_bootstrap"] = lambda s, d: M.cluster_bootstrap(M.optimal_set_agreement(_two_losses(s, d), DECISION_KEY), DECISION_KEY), None
    q["bootstrap"] = lambda s, d: M.bootstrap(_view(s, d).select(*DECISION_KEY, "regret_mean"), "regret_mean"), None
    q["dup_candidates"] = lambda s, d: V.duplicate_candidates(candidates(s, d).withColumn("candidate_page_id", F.substring_index("candidate_page_id", "-", 1))), f"WITH {_C} SELECT {K}, split_part(candidate_page_id, '-', 1) AS candidate_page_id, count(*) AS copies FROM c GROUP BY ALL HAVING count(*) > 1"
    q["inconsistent_metadata"] = lambda s, d: V.inconsistent_metadata(candidates(s, d), ["trace_family", "capacity"], ["split", "horizon"]), f"WITH {_C} SELECT trace_family, capacity, count(DISTINCT split) AS split, count(DISTINCT horizon) AS horizon FROM c GROUP BY ALL HAVING count(DISTINCT split) > 1 OR count(DISTINCT horizon) > 1"
    q["cross_split_ids"] = lambda s, d: V.cross_split_ids(candidates(s, d).withColumn("decision_id", F.expr("cast(decision_t div 8 as string)"))), f"WITH {_C} SELECT (decision_t // 8)::VARCHAR AS decision_id, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM c GROUP BY ALL HAVING count(DISTINCT split) > 1"
    q["label_validity"] = lambda s, d: V.label_faults(_faulty(s, d)), f"WITH {_C}, {_F}, v AS ({_VALIDATE}) SELECT (SELECT count(*) FROM f) AS row_count, " + ", ".join(f"max(faults) FILTER (\"check\" = '{k}') AS {k}" for k in ("loss_not_finite", "value_not_finite", "loss_negative", "loss_fractional", "sign_mismatch", "split_unknown", "split_named_twice")) + " FROM v"
    for name, relation, sql in (("validate_candidates", candidates, f"{_C}, f AS (SELECT * FROM c)"), ("validate_faulty_candidates", _faulty, f"{_C}, {_F}")):
        q[name] = (lambda s, d, relation=relation: V.validate_candidates(relation(s, d))), f"WITH {sql} {_VALIDATE}"
    q["feature_alias_checks"] = lambda s, d: V.alias_faults(candidates(s, d)), f"WITH {_C} SELECT count(*) AS row_count, count(*) FILTER (abs(score_gap_to_lru_victim - (candidate_lru_score - m)) > 1e-9) AS gap_is_no_alias, count(*) FILTER (abs(candidate_lru_score + candidate_age_norm - 1) > 1e-9) AS age_is_no_complement, count(*) FILTER ((candidate_is_lru_victim = 1) <> (candidate_recency_rank = 0)) AS victim_is_no_rank_0, count(*) FILTER (candidate_lru_score = y_loss) AS score_equals_loss FROM (SELECT *, max(candidate_lru_score) OVER (PARTITION BY {K}) AS m FROM c)"
    blurred = lambda s, d: candidates(s, d).withColumns({"score_gap_to_lru_victim": F.when(F.col("decision_t") % 53 == 0, F.col("score_gap_to_lru_victim") + 1).otherwise(F.col("score_gap_to_lru_victim")), "candidate_age_norm": F.when(F.col("decision_t") % 59 == 0, 0.25).otherwise(F.col("candidate_age_norm")), "candidate_is_lru_victim": F.when(F.col("decision_t") % 61 == 0, 1 - F.col("candidate_is_lru_victim")).otherwise(F.col("candidate_is_lru_victim"))})
    q["feature_alias_faults"] = lambda s, d: V.alias_faults(blurred(s, d)), f"WITH {_C}, e AS (SELECT * REPLACE (CASE WHEN decision_t % 53 = 0 THEN score_gap_to_lru_victim + 1 ELSE score_gap_to_lru_victim END AS score_gap_to_lru_victim, CASE WHEN decision_t % 59 = 0 THEN 0.25 ELSE candidate_age_norm END AS candidate_age_norm, CASE WHEN decision_t % 61 = 0 THEN 1 - candidate_is_lru_victim ELSE candidate_is_lru_victim END AS candidate_is_lru_victim) FROM c) SELECT count(*) AS row_count, count(*) FILTER (abs(score_gap_to_lru_victim - (candidate_lru_score - m)) > 1e-9) AS gap_is_no_alias, count(*) FILTER (abs(candidate_lru_score + candidate_age_norm - 1) > 1e-9) AS age_is_no_complement, count(*) FILTER ((candidate_is_lru_victim = 1) <> (candidate_recency_rank = 0)) AS victim_is_no_rank_0, count(*) FILTER (candidate_lru_score = y_loss) AS score_equals_loss FROM (SELECT *, max(candidate_lru_score) OVER (PARTITION BY {K}) AS m FROM e)"
    looked_at = ["candidate_lru_score", "request_bucket", "y_loss", "candidate_is_lru_victim", "recent_candidate_request_rate", "y_value"]
    holed = lambda s, d: candidates(s, d).withColumn("recent_candidate_request_rate", F.when(F.col("decision_t") % 53 != 0, F.col("recent_candidate_request_rate"))).withColumn("y_value", F.col("y_loss"))
    told = {f"n_{x}": f"count(*) FILTER ({x} IS NULL) > 0" for x in looked_at} | {f"c_{x}": f"min({x}) IS NOT DISTINCT FROM max({x})" for x in looked_at} | {f"e_{x}_{y}": f"count(*) FILTER ({x} IS DISTINCT FROM {y}) = 0" for k, x in enumerate(looked_at) for y in looked_at[k + 1 :]}
    by_name = [(x, fault) for x in looked_at for fault, is_so in (("unknown", x not in ACTIVE_FEATURES + DEPRECATED_FEATURES), ("deprecated", x in DEPRECATED_FEATURES), ("leaks", x in ("y_loss", "y_value"))) if is_so]
    parts = [f"SELECT '{x}' AS feature, '{fault}' AS fault" for x, fault in by_name] + [f"SELECT '{x}', '{word}' FROM z WHERE {c}_{x}" for x in looked_at for c, word in (("n", "nulls"), ("c", "constant"))] + [f"SELECT '{y}', 'equals {x}' FROM z WHERE e_{x}_{y}" for k, x in enumerate(looked_at) for y in looked_at[k + 1 :]]
    q["feature_schema_faults"] = lambda s, d: V.feature_schema_faults(holed(s, d), looked_at, ACTIVE_FEATURES, DEPRECATED_FEATURES, ["y_loss", "y_value"]), f"WITH {_C}, g AS (SELECT * REPLACE (CASE WHEN decision_t % 53 <> 0 THEN recent_candidate_request_rate END AS recent_candidate_request_rate, y_loss AS y_value), 0.0 AS request_bucket FROM c), z AS (SELECT {', '.join(f'{e} AS {n}' for n, e in told.items())} FROM g) " + " UNION ALL ".join(parts)
    q["pseudonymise"] = lambda s, d: candidates(s, d).select("decision_id", S.pseudonym(F.col("candidate_page_id"), "salt").alias("pseudonym")), f"WITH {_C} SELECT decision_id, 'obj_' || sha256('salt|' || candidate_page_id)[1:24] AS pseudonym FROM c"
    q["pseudonymise_lists"] = lambda s, d: _view(s, d).select("decision_id", S.pseudonym_list(F.col("optimal_candidate_page_ids"), "salt").alias("pseudonyms")), f"WITH {_D} SELECT decision_id, array_to_string(list_transform(string_split(optimal_candidate_page_ids, '|'), lambda x: 'obj_' || sha256('salt|' || x)[1:24]), '|') AS pseudonyms FROM d"
    q["pseudonym_collisions"] = lambda s, d: V.pseudonym_collisions(candidates(s, d), "candidate_page_id", "salt", 3), f"WITH {_C}, p AS (SELECT DISTINCT candidate_page_id AS raw, 'obj_' || sha256('salt|' || candidate_page_id)[1:3] AS pseudonym FROM c) SELECT pseudonym, count(raw) AS raw_values FROM p GROUP BY pseudonym HAVING count(raw) > 1"
    q["raw_leak_scan"] = lambda s, d: V.leaked_values(candidates(s, d).select("candidate_page_id", F.lit("x").alias("note"), S.pseudonym(F.col("candidate_page_id"), "salt").alias("pseudonym")), candidates(s, d).where("y_loss >= 3"), "candidate_page_id"), f"WITH {_C} SELECT unnest(['candidate_page_id', 'note', 'pseudonym']) AS \"column\", unnest([(SELECT count(DISTINCT candidate_page_id) FROM c WHERE y_loss >= 3), 0, 0])::BIGINT AS leaked"
    patterns = "".join(f" UNION ALL SELECT 'text' AS \"column\", '{k}' AS kind, count(*) FILTER (regexp_matches(text, '" + p.replace("'", "''") + "')) AS row_count FROM documents" for k, p in V.SECRETS.items())
    q["secret_scan"] = lambda s, d: V.secret_scan(s.read.parquet(f"{d}/documents.parquet").select("text")), patterns.removeprefix(" UNION ALL ")
    q["equal_within"] = lambda s, d: V.equal_within(_cells(s, d), _cells(s, d).where("capacity <> 64").withColumn("y", F.col("y") + 1), ["trace_family", "capacity"], ["x", "y"]), f"WITH {_CELLS} SELECT unnest(['x', 'y']) AS \"column\", unnest([0, (SELECT count(*) FROM cells WHERE capacity <> 64)])::BIGINT AS differing, (SELECT count(*) FROM cells WHERE capacity = 64) AS only_left, 0::BIGINT AS only_right"
    q["family_filter"] = lambda s, d: candidates(s, d).where(F.col("trace_family").isin("1-URGENT", "2-HIGH") & ~F.col("trace_family").isin("5-LOW")).groupBy("trace_family").agg(F.count("*").alias("n")), f"WITH {_C} SELECT trace_family, count(*) AS n FROM c WHERE trace_family IN ('1-URGENT', '2-HIGH') GROUP BY trace_family"
    q["split_names"] = lambda s, d: candidates(s, d).select(S.split_name(F.when(F.col("split") == "val", " Validation ").otherwise(F.upper("split"))).alias("split")).groupBy("split").agg(F.count("*").alias("n")), f"WITH {_C} SELECT split, count(*) AS n FROM c GROUP BY split"
    q["reuse_distance"] = lambda s, d: _distances(s, d), f"WITH {_T} SELECT trace, t, item, distance FROM t"
    q["lru_hits"] = lambda s, d: T.lru_hits(_distances(s, d), [4, 8, 32]), f"WITH {_T} SELECT trace, capacity, count(*) AS requests, count(*) FILTER (distance < capacity) AS hits FROM t, (SELECT unnest([4, 8, 32])::BIGINT AS capacity) GROUP BY ALL"
    q["lru_decisions"] = lambda s, d: _replay(s, d).select("trace", "capacity", "t", "item", "hit", "decision"), f"WITH {_L} SELECT trace, capacity, t, item, hit, decision FROM rep"
    q["lru_candidates"] = lambda s, d: T.lru_candidates(_replay(s, d)), f"WITH {_L} SELECT trace, capacity, t, page, last FROM cand"
    q["rollout_labels"] = _labels, f"WITH {_R} SELECT trace, capacity, t, page, last, horizon, y_loss FROM labels"
    q["rollout_decisions"] = lambda s, d: T.rollout_summary(_rollouts(s, d), HORIZONS), f"WITH {_R} SELECT trace, capacity, t, horizon, count(*) AS candidate_count, max(regret) = 0 AS all_tied, max(regret) AS regret_max, round(avg(regret), 9) AS random_regret, round(count(*) FILTER (regret = 0) / count(*), 9) AS optimal_fraction FROM lr GROUP BY ALL"
    q["horizon_transitions"] = lambda s, d: A.changes(T.rollout_regrets(_rollouts(s, d), HORIZONS), [(4, 8), (8, 16), (4, 16)]), f"""WITH {_R}, ds AS (SELECT trace, capacity, t, horizon, round(avg(regret), 9) AS v FROM lr GROUP BY ALL), j AS (SELECT a.horizon AS from_horizon, b.horizon AS to_horizon, a.v AS x, b.v AS y FROM ds a JOIN ds b USING (trace, capacity, t) WHERE a.horizon < b.horizon)
      SELECT from_horizon::INT AS from_horizon, to_horizon::INT AS to_horizon, count(*) AS decisions, count(*) FILTER (abs(x) <= 1e-12 AND abs(y) > 1e-12) AS tied_to_telling, count(*) FILTER (abs(x) > 1e-12 AND abs(y) <= 1e-12) AS telling_to_tied, count(*) FILTER (abs(x) <= 1e-12 AND abs(y) <= 1e-12) AS both_tied, count(*) FILTER (y - x > 1e-12) AS up, count(*) FILTER (x - y > 1e-12) AS down, count(*) FILTER (abs(y - x) <= 1e-12) AS equal, round(avg(y - x), 9) AS mean_change FROM j GROUP BY ALL"""
    q["horizon_monotonicity"] = lambda s, d: A.monotonicity(T.rollout_regrets(_rollouts(s, d), HORIZONS), HORIZONS), f"""WITH {_R}, ds AS (SELECT trace, capacity, t, avg(regret) FILTER (horizon = 4) AS a, avg(regret) FILTER (horizon = 8) AS b, avg(regret) FILTER (horizon = 16) AS c FROM lr GROUP BY ALL),
      m AS (SELECT *, b >= a - 1e-12 AND c >= b - 1e-12 AS up, b <= a + 1e-12 AND c <= b + 1e-12 AS down FROM ds)
      SELECT count(*) AS decisions, count(*) FILTER (c - a > 1e-12) AS rise, count(*) FILTER (a - c > 1e-12) AS fall, count(*) FILTER (abs(c - a) <= 1e-12) AS unchanged, count(*) FILTER (up) AS nondecreasing, count(*) FILTER (down AND NOT up) AS nonincreasing, count(*) FILTER (NOT up AND NOT down) AS mixed FROM m"""
    q["horizon_decomposition"] = lambda s, d: A.horizon_decomposition(_whole_windows(s, d), ["trace", "capacity", "t"], 4, 16), f"""WITH {_R}, ds AS (SELECT trace, capacity, t, horizon, (max(regret) = 0)::INT::DOUBLE AS all_tied, round(count(*) FILTER (regret = 0) / count(*), 9) AS random_optimal, round(avg(regret), 9) AS random_regret FROM lr JOIN (SELECT trace, max(t) AS e FROM t GROUP BY trace) USING (trace) WHERE t + horizon <= e GROUP BY ALL),
      l AS (UNPIVOT (SELECT *, count(*) OVER (PARTITION BY trace, capacity, t) = 3 AS matched FROM ds) ON all_tied, random_optimal, random_regret INTO NAME metric VALUE v),
      e AS (SELECT metric, avg(v) FILTER (horizon = 4) AS o, avg(v) FILTER (horizon = 4 AND matched) AS a, avg(v) FILTER (horizon = 16 AND matched) AS b FROM l GROUP BY metric)
      SELECT metric, round(o, 9) AS own_start, round(a, 9) AS matched_start, round(b, 9) AS matched_end, round(a - o, 9) AS population_effect, round(b - a, 9) AS horizon_effect FROM e"""
    top = ", ".join(f"round(sum(n) FILTER (place <= greatest(1, round_even(items * {p}, 0))) / max(whole), 9) AS top_{int(p * 100)}_share" for p in (0.01, 0.05, 0.1))
    q["locality_panel"] = lambda s, d: T.locality(_distances(s, d)), f"""WITH {_T}, i AS (SELECT trace, item, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY n DESC, item) AS place, count(*) OVER (PARTITION BY trace) AS items, sum(n) OVER (PARTITION BY trace) AS whole FROM i),
      a AS (SELECT trace, max(items) AS items, {top}, round(-sum(n / whole * log2(n / whole)), 9) AS entropy FROM r GROUP BY trace), b AS (SELECT trace, count(*) AS requests, round(count(*) FILTER (distance IS NULL) / count(*), 9) AS first_fraction, round(quantile_cont(distance, 0.5), 9) AS reuse_p50, round(quantile_cont(distance, 0.9), 9) AS reuse_p90, count(*) FILTER (distance <= 32) AS within_32, count(*) FILTER (distance <= 128) AS within_128, count(*) FILTER (distance > 128) AS beyond_128 FROM t GROUP BY trace) SELECT * FROM b JOIN a USING (trace)"""
    q["windowed_locality"] = lambda s, d: T.windowed_locality(traces(s, d), _distances(s, d), 512, 128), f"""WITH {_T}, win AS (SELECT trace, unnest(range(0, greatest(0, (max(t) + 1 - 512) // 128) + 1))::BIGINT AS w FROM t GROUP BY trace),
      m AS (SELECT w.w, t.* FROM win w JOIN t ON t.trace = w.trace AND t.t BETWEEN w.w * 128 AND w.w * 128 + 511), i AS (SELECT trace, w, item, count(*) AS n FROM m GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY trace, w ORDER BY n DESC, item) AS place, count(*) OVER (PARTITION BY trace, w) AS items, sum(n) OVER (PARTITION BY trace, w) AS whole FROM i),
      a AS (SELECT trace, w, max(items) AS objects, {top}, round(abs(-sum(n / whole * log2(n / whole))), 9) AS entropy, CASE WHEN max(items) > 1 THEN round(abs(-sum(n / whole * log2(n / whole))) / log2(max(items)), 9) ELSE 0 END AS normalised_entropy FROM r GROUP BY ALL),
      b AS (SELECT trace, w, count(*) AS requests, round(count(*) FILTER (distance IS NULL) / count(*), 9) AS compulsory_fraction, round(count(distance) / count(*), 9) AS repeated_fraction, count(distance) AS reuse_events, round(avg(distance), 9) AS reuse_mean,
        {", ".join(f"round(quantile_cont(distance, {p}), 9) AS reuse_p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, {", ".join(f"round(count(*) FILTER (distance {c}) / nullif(count(distance), 0), 9) AS {k}" for k, c in (("within_32", "<= 32"), ("within_128", "<= 128"), ("beyond_128", "> 128")))} FROM m GROUP BY ALL),
      ws AS (SELECT x.trace, x.t, count(*) FILTER (y.t > x.t - 32) AS s32, count(*) AS s128 FROM t x JOIN t y ON y.trace = x.trace AND y.t <= x.t AND y.t > x.t - 128 AND (y.next IS NULL OR y.next > x.t) GROUP BY ALL),
      s AS (SELECT trace, w, round(avg(s32), 9) AS working_set_32, round(avg(s128), 9) AS working_set_128 FROM m JOIN ws USING (trace, t) GROUP BY ALL),
      l AS (SELECT trace, w, max(n) AS streak FROM (SELECT trace, w, count(*) AS n FROM (SELECT trace, w, t - row_number() OVER (PARTITION BY trace, w ORDER BY t) AS island FROM m WHERE distance IS NULL) GROUP BY trace, w, island) GROUP BY ALL)
      SELECT b.* EXCLUDE (w), w AS "window", a.* EXCLUDE (trace, w), working_set_32, working_set_128, coalesce(streak, 0) AS longest_novel_streak, w * 128 AS history, w >= 1 AS warm, round(objects / requests, 9) AS object_ratio FROM b JOIN a USING (trace, w) JOIN s USING (trace, w) LEFT JOIN l USING (trace, w)"""
    q["in_windows"] = lambda s, d: traces(s, d).where(S.in_windows(F.col("t"), [(100, 149), (160, 199)])).groupBy("trace").agg(F.count("*").alias("requests"), F.count_distinct("item").alias("items")), f"WITH {_T} SELECT trace, count(*) AS requests, count(DISTINCT item) AS items FROM t WHERE t BETWEEN 100 AND 149 OR t BETWEEN 160 AND 199 GROUP BY trace"
    q["working_set"] = lambda s, d: T.working_set(traces(s, d), [32, 128]), f"WITH {_T}, l AS (SELECT trace, t, next, max(t) OVER (PARTITION BY trace) + 1 AS e FROM t) SELECT trace, " + ", ".join(f"round(sum(least({w}, coalesce(next, e) - t, e - t)) / count(*), 9) AS working_set_{w}" for w in (32, 128)) + " FROM l GROUP BY trace"
    q["novel_streak"] = lambda s, d: T.novel_streak(_distances(s, d)), f"WITH {_T}, i AS (SELECT trace, t - row_number() OVER (PARTITION BY trace ORDER BY t) AS island FROM t WHERE prev IS NULL) SELECT trace, max(n) AS longest_novel_streak FROM (SELECT trace, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY trace"
    q["cold_start"] = lambda s, d: T.cold_start(_distances(s, d), [32, 128, 1024]), f"WITH {_T} SELECT trace, min(t) FILTER (prev IS NOT NULL) AS first_repeat, " + ", ".join([f"count(*) FILTER (prev IS NULL AND t < {n}) AS distinct_{n}" for n in (32, 128, 1024)] + [f"count(*) FILTER (prev IS NOT NULL AND t < {n}) AS most_hits_{n}" for n in (32, 128, 1024)]) + " FROM t GROUP BY trace"
    q["quarters"] = lambda s, d: T.quarters(traces(s, d)), f"WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY trace) AS n FROM t) SELECT trace, least(t // greatest(n // 4, 1), 3)::INT AS quarter, count(*) AS requests, count(DISTINCT item) AS items FROM n GROUP BY ALL"
    q["scored_windows"] = lambda s, d: T.scored_events(_replay(s, d), s.createDataFrame([("click", 100, 149), ("click", 160, 199), ("view", 0, 99), ("purchase", 50, 150)], "trace string, lo long, hi long")), f"WITH {_L} SELECT trace, capacity, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (NOT hit) / count(*), 9) AS miss_ratio, count(*) FILTER (decision) AS evictions FROM rep WHERE (trace = 'click' AND (t BETWEEN 100 AND 149 OR t BETWEEN 160 AND 199)) OR (trace = 'view' AND t BETWEEN 0 AND 99) OR (trace = 'purchase' AND t BETWEEN 50 AND 150) GROUP BY ALL"
    q["policy_lru"] = lambda s, d: _runs(s, d).drop("error"), f"WITH {_L} SELECT trace, capacity, 'lru' AS policy, 0 AS seed, 'complete' AS status, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (decision) AS evictions FROM rep GROUP BY ALL"
    every = lambda s, d: (t := traces(s, d), p := P.execution_plan(t, CAPACITIES, [*P.DETERMINISTIC, "random"], 20), P.simulate(t, p))[1:]
    q["run_gates_faulty"] = _gates, f"""WITH {_L}, p AS (SELECT DISTINCT trace, capacity FROM rep), r0 AS (SELECT trace, capacity, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (decision) AS evictions FROM rep GROUP BY ALL),
      r AS (SELECT trace, capacity, requests, CASE WHEN trace = 'click' THEN hits + 1 ELSE hits END AS hits, misses, CASE WHEN trace = 'error' THEN misses + 1 ELSE evictions END AS evictions, CASE WHEN trace = 'signup' THEN 'failed' ELSE 'complete' END AS status FROM r0 WHERE trace <> 'view' OR capacity <> 8 UNION ALL SELECT trace, capacity, requests, hits, misses, evictions, 'complete' FROM r0 WHERE trace = 'purchase' UNION ALL SELECT 'other', capacity, requests, hits, misses, evictions, 'complete' FROM r0 WHERE trace = 'view'),
      n AS (SELECT unnest(['all_runs_present', 'no_unplanned_runs', 'no_double_runs', 'all_complete', 'hits_and_misses_sum', 'evictions_within_misses']) AS gate, unnest([(SELECT count(*) FROM p ANTI JOIN r USING (trace, capacity)), (SELECT count(*) FROM r ANTI JOIN p USING (trace, capacity)), (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY trace, capacity HAVING count(*) > 1)), (SELECT count(*) FROM r WHERE status <> 'complete'), (SELECT count(*) FROM r WHERE hits + misses <> requests), (SELECT count(*) FROM r WHERE evictions > misses)]) AS faults) SELECT gate, faults = 0 AS passed, faults FROM n"""
    q["policy_runs"] = lambda s, d: every(s, d)[1], None
    q["policy_summary"] = lambda s, d: P.policy_summary(every(s, d)[1]), None
    q["policy_best"] = lambda s, d: P.best_policy(P.policy_summary(every(s, d)[1])), None
    q["run_gates"] = lambda s, d: P.run_gates(every(s, d)[1], every(s, d)[0]), "SELECT unnest(['all_runs_present', 'no_unplanned_runs', 'no_double_runs', 'all_complete', 'hits_and_misses_sum', 'evictions_within_misses']) AS gate, true AS passed, 0::BIGINT AS faults"
    q["continuation_lru"] = lambda s, d: P.continuation_losses(traces(s, d), CAPACITIES, "lru", 8), f"WITH {_R} SELECT trace, capacity, t, page, y_loss::DOUBLE AS y_loss FROM labels WHERE horizon = 8"
    q["continuation_mru"] = lambda s, d: P.continuation_losses(traces(s, d), CAPACITIES, "mru", 8), None
    q["continuation_random"] = lambda s, d: P.continuation_losses(traces(s, d), CAPACITIES, "random", 8), None
    wanted = ["candidate_lru_score", "recent_candidate_request_rate"]
    q["clean_pair_features"] = lambda s, d: _rounded(views.clean_pair_features(_narrow(views.pairwise_sample(candidates(s, d), 1000, 8)), candidates(s, d), wanted), "a_candidate_lru_score", "b_candidate_lru_score"), f"WITH {_S}, n AS (SELECT {_PAIR} FROM s) SELECT n.decision_id, n.capacity, n.horizon, n.split, n.trace_family, label_a_better, label_b_better, is_tie, {', '.join(f'round({x}.candidate_lru_score, 9) AS {x}_candidate_lru_score, {x}.recent_candidate_request_rate AS {x}_recent_candidate_request_rate' for x in 'ab')} FROM n JOIN c a ON a.trace_name = n.trace_name AND a.capacity = n.capacity AND a.horizon = n.horizon AND a.decision_id = n.decision_id AND a.candidate_page_id = n.candidate_a_page_id JOIN c b ON b.trace_name = n.trace_name AND b.capacity = n.capacity AND b.horizon = n.horizon AND b.decision_id = n.decision_id AND b.candidate_page_id = n.candidate_b_page_id"
    turned = lambda df: df.withColumn("held", F.col("candidate_a_page_id")).withColumn("candidate_a_page_id", F.col("candidate_b_page_id")).withColumn("candidate_b_page_id", F.col("held"))
    q["pair_overlap"] = lambda s, d: views.pair_overlap(views.pairwise_sample(candidates(s, d), 1000, 8), turned(_pairs(s, d).where("capacity = 64"))), f"WITH {_S}, n AS (SELECT (SELECT count(*) FROM s) AS a_pairs, (SELECT count(*) FROM p WHERE capacity = 64) AS b_pairs, (SELECT count(*) FROM s JOIN p USING ({K}, lo, hi) WHERE capacity = 64) AS overlap) SELECT *, round(overlap / nullif(a_pairs, 0), 9) AS overlap_fraction, overlap = a_pairs AND a_pairs = b_pairs AS same_pairs FROM n"
    q["matched_and_whole"] = lambda s, d: views.with_suffixes(*[x.groupBy("trace_family", "capacity").agg(F.count("*").alias("decisions"), F.round(F.avg("regret_mean"), 9).alias("random_regret")) for x in (_view(s, d).where("horizon = 8"), _view(s, d))], ["trace_family", "capacity"], ("_matched", "_whole")), f"WITH {_D} SELECT trace_family, capacity, count(*) FILTER (horizon = 8) AS decisions_matched, round(avg(regret_mean) FILTER (horizon = 8), 9) AS random_regret_matched, count(*) AS decisions_whole, round(avg(regret_mean), 9) AS random_regret_whole FROM d GROUP BY ALL HAVING count(*) FILTER (horizon = 8) > 0"
    panel_of = lambda c: f"SELECT '{c}' AS dimension, {c}::VARCHAR AS value, {_METRICS} FROM b WHERE place = 1 GROUP BY {c}"
    q["best_candidate_panel"] = lambda s, d: W.selection_panel(W.best_candidate(candidates(s, d), F.col("candidate_lru_score")), ["split", "trace_family", "capacity", "horizon"]), f"{lru} SELECT 'all' AS dimension, NULL::VARCHAR AS value, {_METRICS} FROM b WHERE place = 1 " + " ".join(f"UNION ALL {panel_of(c)}" for c in ("split", "trace_family", "capacity", "horizon"))
    census = f"""WITH {_X}, {_TAX}, {both}, cb AS (SELECT ag.*, tx.discordant FROM ag LEFT JOIN tx USING ({K})), cs AS (SELECT 'all' AS subset, *  FROM cb UNION ALL SELECT 'telling', * FROM cb WHERE tx),
      ce AS (SELECT subset, trace_family, capacity, horizon, CASE WHEN grouping(trace_family) + grouping(capacity) = 0 THEN 'trace_family+capacity' WHEN grouping(trace_family) = 0 THEN 'trace_family' WHEN grouping(capacity) = 0 THEN 'capacity' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'all' END AS level,
        count(*) AS decisions, round(avg(round(j, 9)), 9) AS mean_jaccard, round(median(round(j, 9)), 9) AS median_jaccard, round(avg((j = 1)::INT), 9) AS jaccard_1, round(avg((round(j, 9) < 0.8)::INT), 9) AS jaccard_below_0_8, coalesce(sum(discordant), 0)::BIGINT AS reversals,
        round(avg(round(m, 9)), 9) AS mean_ccr, round(median(round(m, 9)), 9) AS median_ccr, round(quantile_cont(round(m, 9), 0.95), 9) AS p95_ccr, round(max(m), 9) AS largest_ccr, round(avg((NOT tx AND NOT ty)::INT), 9) AS both_tied_fraction
        FROM {{}} GROUP BY GROUPING SETS ((subset), (subset, trace_family), (subset, capacity), (subset, trace_family, capacity), (subset, horizon)))"""
    q["continuation_census"] = lambda s, d: M.continuation_census(_two_losses(s, d), DECISION_KEY), census.format("cs") + " SELECT * FROM ce"
    link = f"WITH {_C}, {_LINK.format(K=K)}, lk AS (SELECT trace_family, capacity, horizon, a = 0 AND b = 0 AND r = 0 AS degenerate, unnest(['mru', 'random']) AS policy, unnest([round(b - a, 9), round(r - a, 9)]) AS x, unnest([round(y - x, 9), round(z - x, 9)]) AS y FROM off JOIN cl USING (trace_family, capacity))"
    gaps = lambda s, d: views.linkage_gaps(_linked(s, d))
    kind = "CASE WHEN x = 0 AND y = 0 THEN 'both_tied' WHEN x = 0 THEN 'offline_tie_only' WHEN y = 0 THEN 'closed_loop_tie_only' WHEN sign(x) = sign(y) THEN 'concordant' ELSE 'discordant' END"
    q["linkage_concordance"] = lambda s, d: M.concordance(gaps(s, d), "x", "y", ["horizon", "policy"]), f"{link} SELECT horizon, policy, {kind} AS kind, count(*) AS n FROM lk GROUP BY ALL"
    ranks = "rk AS (SELECT *, rank() OVER (PARTITION BY horizon, policy ORDER BY x) + (count(*) OVER (PARTITION BY horizon, policy, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY horizon, policy ORDER BY y) + (count(*) OVER (PARTITION BY horizon, policy, y) - 1) / 2 AS ry FROM lk WHERE NOT degenerate)"
    q["linkage_correlations"] = lambda s, d: M.correlations(gaps(s, d).where("NOT degenerate"), "x", "y", ["horizon", "policy"]), f"{link}, {ranks} SELECT horizon, policy, count(*) AS n, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM rk GROUP BY ALL"
    pairs_of = "pk AS (SELECT a.horizon, a.policy, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM lk a JOIN lk b ON a.horizon = b.horizon AND a.policy = b.policy AND (a.trace_family, a.capacity) < (b.trace_family, b.capacity)), nk AS (SELECT horizon, policy, count(*) AS n FROM lk GROUP BY ALL)"
    q["linkage_kendall"] = lambda s, d: M.kendall(gaps(s, d), "x", "y", ["horizon", "policy"]), f"{link}, {pairs_of} SELECT horizon, policy, n, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, count(*) FILTER (tx) AS x_tied, count(*) FILTER (ty) AS y_tied, count(*) FILTER (tx AND ty) AS both_tied, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / nullif(sqrt(count(*) FILTER (NOT tx)::DOUBLE * count(*) FILTER (NOT ty)), 0), 9) AS tau_b FROM pk JOIN nk USING (horizon, policy) GROUP BY ALL"
    cell = ["trace_family", "capacity", "horizon"]
    q["linkage_cell_taus"] = lambda s, d: M.kendall_tau_b(M.pair_taxonomy(views.linkage_ranks(_linked(s, d)), cell), cell), f"{link}, v AS (SELECT trace_family, capacity, horizon, 'lru' AS policy, 0.0 AS x, 0.0 AS y FROM lk WHERE policy = 'mru' UNION ALL SELECT trace_family, capacity, horizon, policy, x, y FROM lk), w AS (SELECT trace_family, capacity, horizon, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x <> b.x AS dx, a.y <> b.y AS dy FROM v a JOIN v b USING (trace_family, capacity, horizon) WHERE a.policy < b.policy) SELECT trace_family, capacity, horizon, round(sum(s) / nullif(sqrt(sum(dx::INT)::DOUBLE * sum(dy::INT)), 0), 9) AS tau_b FROM w GROUP BY ALL"
    q["linkage_summary"] = lambda s, d: gaps(s, d).groupBy("horizon").agg(F.count_if(F.signum("x") * F.signum("y") > 0).alias("concordant"), F.count_if(F.signum("x") * F.signum("y") < 0).alias("discordant"), F.count_if((F.col("x") == 0) | (F.col("y") == 0)).alias("ties"), F.count_if("degenerate").alias("degenerate")), f"{link} SELECT horizon, count(*) FILTER (x * y > 0) AS concordant, count(*) FILTER (x * y < 0) AS discordant, count(*) FILTER (x = 0 OR y = 0) AS ties, count(*) FILTER (degenerate) AS degenerate FROM lk GROUP BY horizon"
    named = {"1-URGENT": "urgent orders", "5-LOW": "low priority"}
    q["reader_sizes"] = lambda s, d: candidates(s, d).groupBy(S.reader_name(F.col("trace_family"), named).alias("reader")).agg(F.count("*").alias("n")).select("reader", S.byte_size(F.col("n") * 304).alias("size"), S.output_name(F.col("reader")).alias("file_name")), f"WITH {_C}, r AS (SELECT CASE trace_family WHEN '1-URGENT' THEN 'urgent orders' WHEN '5-LOW' THEN 'low priority' ELSE trace_family END AS reader, count(*) * 304 AS b FROM c GROUP BY ALL) SELECT reader, CASE WHEN b >= 1024 ** 3 THEN printf('%.1f GiB', b / 1024.0 ** 3) WHEN b >= 1024 ** 2 THEN printf('%.1f MiB', b / 1024.0 ** 2) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE b || ' B' END AS size, regexp_replace(trim(reader), '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM r"
    q["source_summary"] = lambda s, d: release.source_summary(s, _release(s, d), include=("1-URGENT", "2-HIGH", "nowhere"), exclude=("5-LOW",), blocked=("2-HIGH", "5-LOW")).select("family", (F.col("shards") > 0).alias("there"), "selected", "fault"), f"WITH {_C}, w AS (SELECT DISTINCT trace_family AS family FROM c UNION SELECT unnest(['1-URGENT', '2-HIGH', 'nowhere', '5-LOW'])) SELECT family, family IN (SELECT trace_family FROM c) AS there, family IN ('1-URGENT', '2-HIGH') AND family IN (SELECT trace_family FROM c) AS selected, CASE WHEN family = 'nowhere' THEN 'missing' WHEN family = '2-HIGH' THEN 'blocked' END AS fault FROM w"
    q["calibrated_predictor_score"] = lambda s, d: M.calibrated_score(_pairs(s, d), F.col("recent_candidate_hit_rate_a") - F.col("recent_candidate_hit_rate_b"), ["split"]), None
    q["calibrated_linear_score"] = lambda s, d: M.calibrated_linear_score(_pairs(s, d), M.fit_linear(candidates(s, d).where("split = 'train'"), ACTIVE_FEATURES, "y_loss"), ["split"]), None
    q["decision_density"] = lambda s, d: T.rollout_density(_rollouts(s, d), HORIZONS), f"WITH {_R}, h AS (SELECT trace, capacity, t, horizon, y_loss, count(*) AS m FROM labels GROUP BY ALL), g AS (SELECT trace, capacity, t, horizon, sum(m)::BIGINT AS candidates, max(y_loss) - min(y_loss) AS loss_range, sum(m * (m - 1) // 2)::BIGINT AS e FROM h GROUP BY ALL) SELECT trace, capacity, t, horizon, candidates, loss_range, candidates * (candidates - 1) // 2 - e AS strict_pairs, round((candidates * (candidates - 1) // 2 - e) / nullif(candidates * (candidates - 1) // 2, 0), 9) AS strict_density FROM g"
    q["pair_contributions"] = lambda s, d: A.pair_contributions(_narrow(_pairs(s, d)), ["trace_family"]), f"WITH {_P}, g AS (SELECT {K}, count(*) AS n, count(*) FILTER (regret_a <> regret_b) AS strict, count(*) FILTER (regret_a < regret_b) AS a FROM p GROUP BY ALL) SELECT trace_family, count(*) AS decisions, count(*) FILTER (strict > 0) AS with_strict_pairs, count(*) FILTER (strict = 0) AS only_tied, round(avg((strict > 0)::INT), 9) AS with_strict_share, round(avg(n), 9) AS pairs_a_decision, round(avg(strict) FILTER (strict > 0), 9) AS strict_a_telling_decision, round(sum(a) / nullif(sum(strict), 0), 9) AS a_better_share FROM g GROUP BY trace_family"
    q["sample_mix"] = lambda s, d: A.sample_mix(views.pairwise_sample(candidates(s, d), 1000, 8), _view(s, d), ["capacity"]), f"WITH {_S}, a AS (SELECT capacity, count(*) AS sampled FROM s GROUP BY ALL), n AS (SELECT {K}, count(*) AS k FROM c GROUP BY ALL), b AS (SELECT capacity, count(*) AS decisions, sum(k * (k - 1) // 2)::BIGINT AS universe FROM n GROUP BY capacity), j AS (SELECT capacity, coalesce(sampled, 0) AS sampled, coalesce(decisions, 0) AS decisions, coalesce(universe, 0) AS universe FROM a FULL JOIN b USING (capacity)) SELECT *, round(sampled / sum(sampled) OVER (), 9) AS sampled_share, round(decisions / sum(decisions) OVER (), 9) AS decision_share, round(universe / sum(universe) OVER (), 9) AS universe_share FROM j"
    q["pair_evaluation"] = lambda s, d: M.pair_evaluation(_pairs(s, d), F.round(1 / (1 + F.exp(F.col("recent_candidate_request_rate_a") * 10 - F.col("recent_candidate_request_rate_b") * 10)), 9)).select("part", "n", "accuracy", "auroc"), f"""WITH {_P}, e AS (SELECT unnest([split, 'all']) AS part, (regret_a < regret_b)::INT AS y, round(1 / (1 + exp(rate_a * 10 - rate_b * 10)), 9) AS pr FROM p WHERE regret_a <> regret_b),
      m AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY pr) + (count(*) OVER (PARTITION BY part, pr) - 1) / 2 AS mid FROM e) SELECT part, count(*) AS n, round(avg(((pr >= 0.5)::INT = y)::INT), 9) AS accuracy, round((sum(mid * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auroc FROM m GROUP BY part"""
    q["shard_rows"] = lambda s, d: tables.read_candidates(s, written_path(s, d, "shards", lambda p: _written_shards(s, d, p))).groupBy("split", F.coalesce("more", F.lit("none")).alias("more")).agg(F.count("*").alias("row_count"), F.sum("y_loss").alias("losses"), F.count("request_bucket").alias("buckets"), F.count_distinct("candidate_page_id").alias("pages")), f"WITH {_C} SELECT split, CASE WHEN decision_t % 2 = 0 THEN 'none' ELSE 'x, \"y\"' END AS more, count(*) AS row_count, sum(y_loss) AS losses, count(*) FILTER (decision_t % 2 = 0) AS buckets, count(DISTINCT candidate_page_id) AS pages FROM c GROUP BY ALL"
    built = lambda s, d: written_path(s, d, "built", lambda p: release.build(s, candidates(s, d), p, ("5-LOW",), 1000, 8))
    q["release_built_view"] = lambda s, d: s.read.parquet(f"{built(s, d)}/decision_view").select(*DECISION_KEY, "candidate_count", "min_y_loss", "optimal_candidate_page_ids", F.round("regret_mean", 9).alias("regret_mean")), f"WITH {_D} SELECT {K}, candidate_count, min_y_loss, optimal_candidate_page_ids, round(regret_mean, 9) AS regret_mean FROM d WHERE trace_family <> '5-LOW'"
    q["release_built_summary"] = lambda s, d: s.read.parquet(f"{built(s, d)}/split_summary"), f"WITH {_C} SELECT split, trace_family, capacity, horizon, count(*) AS row_count, count(DISTINCT decision_id) AS decision_count FROM c WHERE trace_family <> '5-LOW' GROUP BY ALL"
    q["release_manifest"] = lambda s, d: s.read.json(f"{built(s, d)}/manifest").select("candidate_rows", "decision_view", F.array_join("families", "|").alias("families"), F.array_join("blocked_families", "|").alias("blocked")), f"WITH {_D} SELECT (SELECT count(*) FROM c WHERE trace_family <> '5-LOW') AS candidate_rows, (SELECT count(*) FROM d WHERE trace_family <> '5-LOW') AS decision_view, (SELECT string_agg(DISTINCT trace_family, '|' ORDER BY trace_family) FROM c WHERE trace_family <> '5-LOW') AS families, '5-LOW' AS blocked"
    damaged = lambda s, d: written_path(s, d, "damaged", lambda p: _damaged(s, d, p))
    q["release_validated"] = lambda s, d: release.validate_release(s, damaged(s, d), ("5-LOW",)).where("check <> 'checksum_faults'"), f"WITH {_D}, g AS (SELECT * FROM c WHERE trace_family <> '5-LOW' UNION ALL SELECT * FROM c WHERE trace_family <> '5-LOW' AND decision_t % 83 = 0 UNION ALL SELECT * FROM c WHERE trace_family = '5-LOW' AND capacity = 32), f AS (SELECT * FROM g), v AS ({_VALIDATE}) SELECT * FROM v UNION ALL SELECT 'row_counts_differ', ((SELECT count(*) FROM g) <> (SELECT count(*) FROM c WHERE trace_family <> '5-LOW'))::BIGINT UNION ALL SELECT 'decisions_without_view', count(*) FROM d WHERE trace_family = '5-LOW' AND capacity = 32 UNION ALL SELECT 'blocked_family_rows', count(*) FROM c WHERE trace_family = '5-LOW' AND capacity = 32"
    q["release_partitions"] = lambda s, d: release.migration_partitions(s, f"{damaged(s, d)}/candidate_rows").select(*PARTITIONS, "row_count", F.array_join("missing", "|").alias("missing"), "cheap"), f"WITH {_C}, g AS (SELECT * FROM c WHERE trace_family <> '5-LOW' UNION ALL SELECT * FROM c WHERE trace_family <> '5-LOW' AND decision_t % 83 = 0 UNION ALL SELECT * FROM c WHERE trace_family = '5-LOW' AND capacity = 32) SELECT split, trace_family, capacity, horizon, count(*) AS row_count, '' AS missing, true AS cheap FROM g GROUP BY ALL"
    q["preview"] = lambda s, d: release.preview(candidates(s, d), 15, "salt").select("capacity", "decision_id", "candidate_page_id", "candidate_page_id_original_present"), f"WITH {_C}, h AS (SELECT capacity, decision_id, candidate_page_id, row_number() OVER (PARTITION BY capacity ORDER BY sha256(concat_ws('|', '7', decision_id, candidate_page_id))[1:16], decision_id, candidate_page_id) AS r FROM c) SELECT capacity, decision_id, 'obj_' || sha256('salt|' || candidate_page_id)[1:24] AS candidate_page_id, true AS candidate_page_id_original_present FROM h WHERE r <= 15"
    q["hidden_pages"] = lambda s, d: release.hide_pages(_view(s, d), "salt", ["2-HIGH", "5-LOW"]).select(*DECISION_KEY, "optimal_candidate_page_ids"), f"WITH {_D} SELECT {K}, CASE WHEN trace_family IN ('2-HIGH', '5-LOW') THEN array_to_string(list_transform(string_split(optimal_candidate_page_ids, '|'), lambda x: 'obj_' || sha256('salt|' || x)[1:24]), '|') ELSE optimal_candidate_page_ids END AS optimal_candidate_page_ids FROM d"
    q["release_footers"] = lambda s, d: files.file_rows(files.footers(s, _release(s, d))).select(*files.partition_values(F.col("path"), KINDS), "rows").groupBy(*PARTITIONS).agg(F.sum("rows").alias("row_count")), f"WITH {_C} SELECT split, trace_family, capacity, horizon, count(*) AS row_count FROM c GROUP BY ALL"
    q["footer_statistics"] = lambda s, d: files.footers(s, _release(s, d)).where(F.col("column").isin("decision_t", "decision_chunk_id")).groupBy("column").agg(F.sum("rows").alias("row_count"), F.sum("nulls").alias("nulls"), F.min(F.expr("try_cast(low as bigint)")).alias("low"), F.max(F.expr("try_cast(high as bigint)")).alias("high")), f"""WITH {_C} SELECT 'decision_t' AS "column", count(*) AS row_count, count(*) - count(decision_t) AS nulls, min(decision_t) AS low, max(decision_t) AS high FROM c UNION ALL SELECT 'decision_chunk_id', count(*), count(*) - count(decision_chunk_id), min(decision_chunk_id), max(decision_chunk_id) FROM c"""
    q["release_recount"] = lambda s, d: files.recount(files.file_rows(files.footers(s, _release(s, d))), candidates(s, d).where("split <> 'test'").groupBy(*PARTITIONS).agg((F.count("*") + (F.col("capacity") == 64).cast("int")).alias("row_count")), KINDS).groupBy("split", "state").agg(F.count("*").alias("partitions"), F.sum("found").alias("found")), f"WITH {_C}, p AS (SELECT split, capacity, trace_family, horizon, count(*) AS n FROM c GROUP BY ALL) SELECT split, CASE WHEN split = 'test' THEN 'not listed' WHEN capacity = 64 THEN 'differs' ELSE 'ok' END AS state, count(*) AS partitions, sum(n)::BIGINT AS found FROM p GROUP BY ALL"
    q["release_rows_read_back"] = lambda s, d: tables.read_partitions(s, _release(s, d)).groupBy("split").agg(F.count("*").alias("row_count"), F.sum("y_loss").alias("losses"), F.count_distinct("decision_id").alias("decisions")), f"WITH {_C} SELECT split, count(*) AS row_count, sum(y_loss) AS losses, count(DISTINCT decision_id) AS decisions FROM c GROUP BY split"
    q["release_compacted"] = lambda s, d: s.read.parquet(written_path(s, d, "compacted", lambda p: _compacted(s, d, p))).groupBy("trace_family", "split").agg(F.count("*").alias("row_count"), F.sum("y_loss").alias("losses"), F.count_distinct("decision_id").alias("decisions")), f"WITH {_C} SELECT trace_family, split, count(*) AS row_count, sum(y_loss) AS losses, count(DISTINCT decision_id) AS decisions FROM c GROUP BY ALL"
    q["trace_scan"] = lambda s, d: tables.read_trace(s, written_path(s, d, "trace-files", lambda p: _trace_files(s, d, p)), "view", strict=False).withColumn("t", F.col("t").cast("long")), f"WITH {_T} SELECT trace, t, item FROM t WHERE trace = 'view'"
    q["trace_faults"] = lambda s, d: tables.trace_faults(s, written_path(s, d, "trace-files", lambda p: _trace_files(s, d, p))).agg(F.sum("requests").alias("requests"), F.sum("bad").alias("bad")), f"WITH {_T} SELECT count(*) AS requests, count(*) FILTER (t % 50 = 7) AS bad FROM t WHERE trace = 'view'"
    q["family_of_path"] = lambda s, d: tables.family_of_path(_shards(s, d), _known(s, d)), f"""WITH {_C}, e AS (SELECT DISTINCT trace_family, capacity, split FROM c), p AS (SELECT DISTINCT unnest(['x/trace_family=' || trace_family || '/part_' || capacity, 'up/' || trace_family || '_cap' || capacity || '_' || split || '.csv', trace_family[1:3] || '_' || capacity || '_' || split, 'other_' || trace_family || '_' || split]) AS path FROM e),
      k AS (SELECT DISTINCT unnest([trace_family, trace_family[1:3], trace_family || '_cap' || capacity]) AS name FROM e), m AS (SELECT path, max_by(name, length(name)) AS name FROM p JOIN k ON starts_with(string_split(path, '/')[-1], name || '_') GROUP BY path)
      SELECT path, coalesce(nullif(regexp_extract(path, '(?:^|/)trace_family=([^/]+)', 1), ''), name) AS family FROM p LEFT JOIN m USING (path)"""
    q["linkage"] = _linked, f"WITH {_C}, {_LINK.format(K=K)} SELECT trace_family, capacity, horizon, a AS offline_lru_regret, b AS offline_mru_regret, r AS offline_random_regret, x AS lru_miss_ratio, y AS mru_miss_ratio, z AS random_miss_ratio, round(b - a, 9) AS offline_mru_gap, round(r - a, 9) AS offline_random_gap, round(y - x, 9) AS closed_mru_gap, round(z - x, 9) AS closed_random_gap, sign(round(b - a, 9))::INT = sign(round(y - x, 9))::INT AS mru_agrees, sign(round(r - a, 9))::INT = sign(round(z - x, 9))::INT AS random_agrees, a = 0 AND b = 0 AND r = 0 AS degenerate FROM off JOIN cl USING (trace_family, capacity)"
    q["top_cells"] = lambda s, d: _rounded(_cells(s, d), "x", "y").orderBy(F.desc("x"), "trace_family", "capacity").limit(5), f"WITH {_CELLS} SELECT trace_family, capacity, round(x, 9) AS x, round(y, 9) AS y FROM cells ORDER BY round(x, 9) DESC, trace_family, capacity LIMIT 5"
    q["size_categories"] = lambda s, d: candidates(s, d).groupBy("trace_family").agg(F.count("*").alias("n")).select("trace_family", S.size_category(F.col("n")).alias("category")), f"WITH {_C} SELECT trace_family, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS category FROM c GROUP BY trace_family"
    q["horizon_capacity"] = lambda s, d: _view(s, d).groupBy("capacity", "horizon").agg(F.round(F.avg(F.col("regret_mean") / F.col("horizon")), 9).alias("regret_per_request"), F.round(F.first(F.col("horizon") / F.col("capacity")), 9).alias("ratio")), f"WITH {_D} SELECT capacity, horizon, round(avg(regret_mean / horizon), 9) AS regret_per_request, round(horizon / capacity, 9) AS ratio FROM d GROUP BY ALL"
    return q


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries().items() if sql}
