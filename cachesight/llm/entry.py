"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cachesight.llm import archives, block_max, compact_windows, credentials, decontaminate, main_text, merkle, neighbours, packing, quality, signature_trees, token_counts, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = [
        token_counts.op1_token_counts, archives.op2_arc_to_warc, compact_windows.op3_substring_dedup, main_text.op4_main_text, decontaminate.op5_decontaminate,
        quality.op6_quality, neighbours.op7_nearest, packing.op8_packing, signature_trees.op9_jaccard_join, token_files.op10_token_files,
        block_max.op11_ranked_search, credentials.op12_secret_scan, merkle.op13_merkle_manifest,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.OP5_SQL, "op7_nearest": neighbours.OP7_SQL, "op11_ranked_search": block_max.OP11_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
