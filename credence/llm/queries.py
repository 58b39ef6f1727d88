"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from credence.llm import byte_bpe, collocations, exact_dedup, fingerprints, html_extract, language_id, license_scan, merkle, mixing, ngram_join, sharding, topk_search, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_language_id": language_id.op4_language_id,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_exact_topk": topk_search.op8_exact_topk,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_order_minhash": fingerprints.op11_order_minhash,
        "op12_collocations": collocations.op12_collocations,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.oracle(),
        "op6_sharding": sharding.ORACLE,
        "op8_exact_topk": topk_search.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op12_collocations": collocations.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
