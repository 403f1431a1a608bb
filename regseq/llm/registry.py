"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regseq.llm import divergence, license_scan, resampling
from regseq.llm.backoff_lm import op4_backoff_automaton
from regseq.llm.bpe import op5_trie_bpe
from regseq.llm.decontaminate import op2_fm_decontaminate
from regseq.llm.factorization import op10_factorization_machine
from regseq.llm.language_mixture import op1_language_mixture
from regseq.llm.minhash_forest import op3_minhash_forest
from regseq.llm.packing import op11_slack_packing
from regseq.llm.quality_rules import op7_quality_rules
from regseq.llm.sharding import op9_virtual_slots
from regseq.llm.suffix_dedup import op8_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_language_mixture": op1_language_mixture,
        "op2_fm_decontaminate": op2_fm_decontaminate,
        "op3_minhash_forest": op3_minhash_forest,
        "op4_backoff_automaton": op4_backoff_automaton,
        "op5_trie_bpe": op5_trie_bpe,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_virtual_slots": op9_virtual_slots,
        "op10_factorization_machine": op10_factorization_machine,
        "op11_slack_packing": op11_slack_packing,
        "op12_divergence_tree": divergence.op12_divergence_tree,
        "op13_regular_resampling": resampling.op13_regular_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_scan.ORACLE_SQL, "op12_divergence_tree": divergence.ORACLE_SQL, "op13_regular_resampling": resampling.ORACLE_SQL}
