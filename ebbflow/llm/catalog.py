"""The queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbflow.llm import bpe, decontaminate, exact_dedup, hard_negatives, html_extract, jaccard_join, merkle, mixing, packing, quality, sharding, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_html": html_extract.op10_html,
    "op11_mixing": mixing.op11_mixing,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE: dict[str, str] = {
    "op4_warc": warc.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
