"""Queries of this subpackage and of corpus_pipeline.py, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import chat, decontaminate, lexical, licenses, near_dup, packing, pii, token_files, urls, variants
from strata.llm.byte_bpe import op10_byte_bpe
from strata.llm.fingerprint import op9_fingerprints
from strata.llm.language import op5_language_id


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # stands beside the package, and uses it

    return {
        "op1_personal_data": pii.op1_personal_data,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_url_filters": urls.op4_url_filters,
        "op5_language_id": op5_language_id,
        "op6_token_files": token_files.op6_token_files,
        "op7_near_duplicates": near_dup.op7_near_duplicates,
        "op8_chat_format": chat.op8_chat_format,
        "op9_fingerprints": op9_fingerprints,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_packing": packing.op12_packing,
        "op13_lexical_search": lexical.op13_lexical_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.ORACLE, "op3_license_scan": licenses.ORACLE, "op4_url_filters": urls.ORACLE, "op8_chat_format": chat.ORACLE, "op13_lexical_search": lexical.ORACLE}
