"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, cover_tree, sharding
from .chat_format import op7_chat_format
from .cover_tree import op12_hard_negatives
from .decontamination import op5_decontamination
from .line_dedup import op4_line_dedup
from .minhash_dedup import op6_minhash_dedup
from .quality import op2_quality_sample
from .sentencepiece_scan import op1_sentencepiece
from .sharding import op9_sharding
from .substring_dedup import op10_substring_dedup
from .token_alignment import op11_token_alignment
from .token_files import op13_token_files
from .toxicity import op3_toxicity
from .transport_stream import op8_transport_stream

OPERATORS = (
    op1_sentencepiece, op2_quality_sample, op3_toxicity, op4_line_dedup, op5_decontamination, op6_minhash_dedup, op7_chat_format,
    op8_transport_stream, op9_sharding, op10_substring_dedup, op11_token_alignment, op12_hard_negatives, op13_token_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": chat_format.ORACLE, "op9_sharding": sharding.ORACLE, "op12_hard_negatives": cover_tree.ORACLE}
