"""The registered queries of this subpackage, and the SQL that checks them.

``TESTED_ONLY`` names the queries that SQL cannot express; ``tests/llm`` holds
them against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.chat_format import OP6_SQL, op6_chat_format
from triagelake.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from triagelake.llm.fingerprints import op8_fingerprints
from triagelake.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from triagelake.llm.language_id import op7_language_id
from triagelake.llm.license_scans import OP13_SQL, op13_license_scans
from triagelake.llm.mixing import OP2_SQL, op2_mixing
from triagelake.llm.packing import op5_packing
from triagelake.llm.quality_classifier import op9_quality_classifier
from triagelake.llm.quality_rules import OP4_SQL, op4_quality_rules
from triagelake.llm.resampling import OP12_SQL, op12_resampling
from triagelake.llm.sharding import op1_sharding
from triagelake.llm.token_output import op10_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_output": op10_token_output,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_resampling": op12_resampling,
    "op13_license_scans": op13_license_scans,
}

ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_resampling": OP12_SQL,
    "op13_license_scans": OP13_SQL,
}
