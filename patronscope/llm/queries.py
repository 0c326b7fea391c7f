"""The queries of this subpackage and their SQL, as the registry adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patronscope.llm.checks import all_checks
from patronscope.llm.conversation_trie import op11_conversation_trie
from patronscope.llm.decontamination import op2_decontamination
from patronscope.llm.fingerprints import op4_fingerprints
from patronscope.llm.language_id import op13_language_id
from patronscope.llm.licenses import op3_licenses
from patronscope.llm.line_dedup import op5_line_dedup
from patronscope.llm.mixing import op9_mixing
from patronscope.llm.near_duplicates import op10_near_duplicates
from patronscope.llm.quality import op7_quality
from patronscope.llm.sharding import op1_sharding
from patronscope.llm.spelling import op12_spelling
from patronscope.llm.suffix_dedup import op6_suffix_dedup
from patronscope.llm.toxicity import op8_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": op1_sharding,
        "op2_decontamination": op2_decontamination,
        "op3_licenses": op3_licenses,
        "op4_fingerprints": op4_fingerprints,
        "op5_line_dedup": op5_line_dedup,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_spelling": op12_spelling,
        "op13_language_id": op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return all_checks()
