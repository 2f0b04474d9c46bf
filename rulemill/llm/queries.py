"""The registered queries of this package and the SQL that gives the same rows where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulemill.llm import oracles
from rulemill.llm.decontamination import op12_decontamination
from rulemill.llm.merkle_audit import op5_merkle_audit
from rulemill.llm.merkle_manifest import op13_merkle_manifest
from rulemill.llm.mixing import op9_mixing
from rulemill.llm.near_dedup import op2_minhash_near_dedup
from rulemill.llm.neighbours import op8_neighbours
from rulemill.llm.packing import op3_packing
from rulemill.llm.quality_classifier import op1_quality_classifier
from rulemill.llm.quality_rules import op6_quality_rules
from rulemill.llm.secret_scan import op4_secret_scan
from rulemill.llm.source_divergence import op11_source_divergence
from rulemill.llm.substring_dedup import op7_substring_dedup
from rulemill.llm.suffix_dedup import op10_suffix_array_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_packing": op3_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_merkle_audit": op5_merkle_audit,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op12_decontamination": oracles.DECONTAMINATION,
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
