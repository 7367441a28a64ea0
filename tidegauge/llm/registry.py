"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from tidegauge.llm.bpe import op8_byte_bpe
from tidegauge.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from tidegauge.llm.language_id import op4_language_id
from tidegauge.llm.near_dedup import op2_near_duplicates
from tidegauge.llm.packing import op10_best_fit_packing
from tidegauge.llm.pii import op6_pii
from tidegauge.llm.quality import op3_quality
from tidegauge.llm.token_counts import op1_token_counts
from tidegauge.llm.topk import OP9_SQL, op9_exact_top_k
from tidegauge.llm.urls import OP5_SQL, op5_url_filters

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_url_filters": op5_url_filters,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES = {"op5_url_filters": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op9_exact_top_k": OP9_SQL}
