"""The queries of this subpackage, by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_byte_bpe
from .class_lm import op6_class_lm
from .minhash import ORACLE as NEAR_DUPLICATES_SQL
from .minhash import op10_hyperminhash
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import op5_line_dedup
from .mixing import op2_mixing
from .quality import op8_quality_rules
from .suffix_dedup import ORACLE as SUFFIX_DEDUP_SQL
from .suffix_dedup import op3_suffix_dedup
from .token_count import op9_token_counts
from .topk import ORACLE as TOP_K_SQL
from .topk import op4_max_score
from .toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_max_score": op4_max_score,
        "op5_line_dedup": op5_line_dedup,
        "op6_class_lm": op6_class_lm,
        "op7_toxicity": op7_toxicity,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_counts": op9_token_counts,
        "op10_hyperminhash": op10_hyperminhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": SUFFIX_DEDUP_SQL, "op4_max_score": TOP_K_SQL, "op5_line_dedup": LINE_DEDUP_SQL, "op10_hyperminhash": NEAR_DUPLICATES_SQL}
