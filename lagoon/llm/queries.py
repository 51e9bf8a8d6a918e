"""The queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagoon.llm.alignment import op12_token_alignment
from lagoon.llm.chat import OP1_SQL, op1_chat_format
from lagoon.llm.decontaminate import op10_decontamination
from lagoon.llm.infill import OP11_SQL, op11_fill_in_middle
from lagoon.llm.licenses import op6_license_scan
from lagoon.llm.minhash import op2_near_duplicates
from lagoon.llm.oracles import NEAR_DUPLICATES, QUALITY
from lagoon.llm.packing import op8_packing
from lagoon.llm.personal import OP13_SQL, op13_personal_data
from lagoon.llm.quality import op5_quality_rules
from lagoon.llm.repeats import op4_repeated_strings
from lagoon.llm.sharding import op7_sharding
from lagoon.llm.token_counts import op3_token_counts
from lagoon.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_token_counts": op3_token_counts,
        "op4_repeated_strings": op4_repeated_strings,
        "op5_quality_rules": op5_quality_rules,
        "op6_license_scan": op6_license_scan,
        "op7_sharding": op7_sharding,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_decontamination": op10_decontamination,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_alignment": op12_token_alignment,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_near_duplicates": NEAR_DUPLICATES, "op5_quality_rules": QUALITY, "op11_fill_in_middle": OP11_SQL, "op13_personal_data": OP13_SQL}
