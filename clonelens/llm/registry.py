"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from clonelens.llm import (
    collisions, language, lexical, line_dedup, mixing, packing, pivots, private_data, quality, sharding, ship_worker_code,
    simhash, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

_FUNCTIONS: list[Query] = [
    mixing.op1_mixing,
    line_dedup.op2_line_dedup,
    language.op3_language,
    quality.op4_quality,
    simhash.op5_simhash,
    packing.op6_packing,
    sharding.op7_sharding,
    pivots.op8_embedding_dedup,
    collisions.op9_ann,
    warc.op10_warc,
    whitening.op11_whitening,
    lexical.op12_lexical_search,
    private_data.op13_private_data,
]
# The others have no SQL: models, eigenvectors, XXH64 fingerprints, tokenizer ids and iterative or approximate searches.
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    ship_worker_code()
    return {**{f.__name__: f for f in _FUNCTIONS}, "pipeline": corpus_pipeline.run}
