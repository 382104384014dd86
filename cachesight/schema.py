"""The candidate relation: one row for each page that could have been replaced at one full-cache miss.

Fixed values: the column names, their order and their groups.
"""

from pyspark.sql import types as T

BASE = [
    "trace_name", "trace_family", "dataset_source", "capacity", "horizon", "decision_id", "decision_t", "decision_chunk_id", "candidate_page_id", "split",
    "y_loss", "y_value",
]
FEATURES = [
    "request_bucket", "request_confidence", "candidate_bucket", "candidate_confidence", "candidate_recency_rank", "candidate_age_norm", "candidate_predictor_score",
    "candidate_lru_score", "candidate_is_predictor_victim", "candidate_is_lru_victim", "score_gap_to_predictor_best", "score_gap_to_lru_victim",
    "bucket_gap_to_predictor_best", "bucket_gap_to_lru_victim", "confidence_gap_to_predictor_best", "confidence_gap_to_lru_victim", "cache_bucket_mean",
    "cache_bucket_std", "cache_bucket_min", "cache_bucket_max", "cache_unique_bucket_count", "cache_confidence_mean", "cache_confidence_std",
    "predictor_lru_disagree", "recent_candidate_request_rate", "recent_candidate_hit_rate",
]
ACTIVE_FEATURES = ["candidate_recency_rank", "candidate_age_norm", "candidate_lru_score", "candidate_is_lru_victim", "score_gap_to_lru_victim", "recent_candidate_request_rate", "recent_candidate_hit_rate"]
LABELS = ["y_loss", "y_value"]
DECISION_KEY = [c for c in BASE if c not in ["candidate_page_id", *LABELS]]
DEPRECATED_FEATURES = [c for c in FEATURES if c not in ACTIVE_FEATURES]
STRINGS = ["trace_name", "trace_family", "dataset_source", "decision_id", "split", "candidate_page_id"]
LONGS = ["capacity", "horizon", "decision_t", "decision_chunk_id"]
CANONICAL = BASE + FEATURES
PARTITIONS = ["split", "trace_family", "capacity", "horizon"]
#: A table names its middle split in one of two ways, not in both.
SPLITS = ["train", "val", "validation", "test"]

_KIND = {c: T.StringType() for c in STRINGS} | {c: T.LongType() for c in LONGS}
SCHEMA = T.StructType([T.StructField(c, _KIND.get(c, T.DoubleType())) for c in CANONICAL])
