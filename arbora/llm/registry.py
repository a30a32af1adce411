"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm.backoff import op2_backoff
from arbora.llm.bpe import op5_bpe
from arbora.llm.fingerprints import op1_fingerprints
from arbora.llm.language import op8_language
from arbora.llm.mixing import op10_mixing
from arbora.llm.quality import OP3_SQL, op3_quality
from arbora.llm.repair import op7_repair
from arbora.llm.sharding import op4_sharding
from arbora.llm.simhash import op6_simhash
from arbora.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_backoff, op3_quality, op4_sharding, op5_bpe, op6_simhash, op7_repair, op8_language, op9_toxicity, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3_SQL}
