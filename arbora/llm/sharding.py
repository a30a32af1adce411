"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 by ascending key.  A balanced Feistel network permutes the smallest even-bit power of two that holds N;
cycle walking (permuting again while the value is N or more) restricts it to 0..N-1, still a bijection.  With ``p`` the permuted
number, the shard is ``p mod S`` and the slot ``p div S``: shard sizes differ by one at most, slots have no gap, and both
directions are computable from the key alone, without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, numbered

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply) of ``x`` with a round key."""
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed bijection of 0..n-1 and its inverse, on numpy arrays."""

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = [int(_mix(np.array([seed], np.uint64), 0x9E3779B97F4A7C15 * (r + 1))[0]) for r in range(rounds)]

    def _pass(self, x: np.ndarray, forth: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        with np.errstate(over="ignore"):
            for k in self.keys if forth else reversed(self.keys):
                if forth:
                    left, right = right, left ^ (_mix(right, k) & mask)
                else:
                    left, right = right ^ (_mix(left, k) & mask), left
        return (left << h) | right

    def _walk(self, x: np.ndarray, forth: bool) -> np.ndarray:
        out = self._pass(np.asarray(x).astype(np.uint64), forth)
        while len(off := np.flatnonzero(out >= np.uint64(self.n))):
            out[off] = self._pass(out[off], forth)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, False)


def permuted(df: DataFrame, number: str, n: int, seed: int, name: str = "position") -> DataFrame:
    """``df`` with ``name``: the place of row ``number`` in the shuffled order of ``n`` rows."""

    @F.pandas_udf("bigint")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).forward(x.to_numpy()))

    return df.withColumn(name, place(F.col(number)))


def shard(df: DataFrame, *order: str, shards: int = 40, seed: int = 20_24) -> DataFrame:
    """``df`` with ``row_number``, ``position``, ``shard`` and ``slot``.

    Rows are numbered by ``order``; the caller adds a tie-break column where keys repeat.  Nulls sort first.  An empty table gives an
    empty result.  Columns of the four names are replaced, all others stay.  The result is the same however ``df`` is partitioned.  Keep ``df`` narrow: payloads need not move, since shard and slot follow from the number.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = numbered(df.drop("row_number", "position", "shard", "slot"), *order, label="shard")
    n = rows.count()
    return permuted(rows, "row_number", n, seed).withColumn("shard", F.expr(f"cast(position % {shards} as int)")).withColumn("slot", F.expr(f"position div {shards}"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``.  A null text has size 16 and the CRC of no bytes; equal rows are interchangeable."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Only these columns move; texts stay where they are read.
    narrow = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(narrow, "doc_id", "text_crc32", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
