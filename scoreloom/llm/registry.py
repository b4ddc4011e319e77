"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import best_fit_packing, exact_dedup, language_id, metric_search, near_dedup, pii_surrogates, source_mixing, suffix_dedup, toxicity, warc_archives

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_pii_surrogates": pii_surrogates.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_warc_archives": warc_archives.op4,
    "op5_toxicity": toxicity.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_best_fit_packing": best_fit_packing.op8,
    "op9_source_mixing": source_mixing.op9,
    "op10_metric_search": metric_search.op10,
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_warc_archives": warc_archives.SQL,
    "op9_source_mixing": source_mixing.SQL,
    "op10_metric_search": metric_search.SQL,
}
