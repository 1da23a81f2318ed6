"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_multiprobe_neighbours
from .bpe import op1_byte_bpe
from .chat import op2_chat_format
from .knn import op5_kd_tree_top_k
from .langid import op6_rank_order_language
from .neardup import op4_near_duplicates
from .oracles import ORACLES
from .packing import op8_best_fit
from .scoring import op9_bloom_lm_scores
from .sharding import op10_minimax_shards
from .substrings import op7_substring_dedup

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chat_format": op2_chat_format,
    "op3_multiprobe_neighbours": op3_multiprobe_neighbours,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_kd_tree_top_k": op5_kd_tree_top_k,
    "op6_rank_order_language": op6_rank_order_language,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_best_fit": op8_best_fit,
    "op9_bloom_lm_scores": op9_bloom_lm_scores,
    "op10_minimax_shards": op10_minimax_shards,
}
