"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import class_lm, decontaminate, line_dedup, mixing, ngram_join, pii_surrogates, quality_rules, source_audit, suffix_dedup, token_alignment, toxicity, url_filter, warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_pii_surrogates": pii_surrogates.op2_pii_surrogates,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_warc_fixity": warc_fixity.op7_warc_fixity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_class_lm": class_lm.op11_class_lm,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_warc_fixity": warc_fixity.OP7_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
}
