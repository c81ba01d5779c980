"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, collocations, exact_dedup, filter_audit, lm_score, mixing, packing, quality_crf, simhash_dedup, spot_signatures, suffix_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spot_signatures": spot_signatures.query,
    "op2_chat_format": chat_format.query,
    "op3_lm_score": lm_score.query,
    "op4_mixing": mixing.query,
    "op5_token_files": token_files.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_simhash_dedup": simhash_dedup.query,
    "op8_packing": packing.query,
    "op9_quality_crf": quality_crf.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_filter_audit": filter_audit.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_collocations": collocations.query,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat_format.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}
