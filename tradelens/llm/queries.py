"""Queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tradelens.llm import (bpe, collocations, fingerprints, langid, linededup, neardup, packing, runs, secrets,
                           sharding, suffixdedup, tokenfiles, topk)
from tradelens.llm.common import importable, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(read_table(importable(spark), sf_dir, table))
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _over("documents", linededup.op1),
        "op2_exact_topk": _over("embeddings", topk.op2),
        "op3_prefix_fingerprints": _over("documents", fingerprints.op3),
        "op4_setsketch_near_dedup": _over("documents", neardup.op4),
        "op5_byte_bpe": _over("documents", bpe.op5),
        "op6_language_id": _over("documents", langid.op6),
        "op7_suffix_array_dedup": _over("documents", suffixdedup.op7),
        "op8_best_fit_packing": _over("documents", packing.op8),
        "op9_ring_shards": _over("documents", sharding.op9),
        "op10_secret_scan": _over("documents", secrets.op10),
        "op11_phrase_collocations": _over("documents", collocations.op11),
        "op12_periodic_runs": _over("documents", runs.op12),
        "op13_token_files": _over("documents", tokenfiles.op13),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    # the others cannot be said in SQL; tests/llm has their brute-force checks
    return {"op1_line_dedup": linededup.ORACLE_SQL, "op2_exact_topk": topk.ORACLE_SQL,
            "op4_setsketch_near_dedup": neardup.ORACLE_SQL, "op11_phrase_collocations": collocations.ORACLE_SQL}
