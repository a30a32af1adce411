"""Stupid-backoff language-model scores of every document against counts over the whole corpus.

A word's score after its history is ``c(history word) / c(history)`` for the longest history whose n-gram occurs, times ``BACKOFF`` for each
word of history given up; without history it is ``c(word) / N``.  The table counts every n-gram of all documents; since the document that is
scored is among them, what it counts itself is taken off (else no n-gram of it would ever be unseen), and a word that nothing else holds
counts as one occurrence.  A document's score is the sum of natural logarithms.

The tables are relations of n-gram hashes, partitioned by hash.  A row per n-gram and document would move the corpus many times over, so
rows travel packed: documents are dealt into batches by a hash of their key, and what a batch sends to a partition of the count table is
one row with the batch's different n-grams of that hash range, sorted, and their counts (so a frequent n-gram costs a row per batch, not one
per occurrence).  A partition adds up the counts of all batches and answers each batch in its own order; the answers are joined to the
batch's exploded n-grams, and scores are summed per document.

A null text counts as empty: no words, score 0 and a null mean.  Repeated rows are documents of their own, dealt to batches each for itself, and
so are rows that share a key or have none.  An empty table gives an empty result.  Only key and text are read, so other columns may have any name.

A batch's row for a partition holds the batch's n-grams of a hash range, so there are never more rows than n-grams; where batches and partitions
are very many, rows get short and the packing gains less, but nothing grows faster than the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, tasks

ORDER = 2
BACKOFF = 0.4
#: Bytes of text in a batch, and of all texts for each partition of the count table; both bound a task's memory.
BATCH_BYTES = 8 << 20
#: The key that counts all words.
ALL = np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words each text has; for each length the hash of the n-gram that ends at each word, 0 where the text begins later."""
    sizes, index, at = np.zeros(len(texts), np.int64), {}, []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sizes[i] = len(words)
        at.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
    distinct = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in index), np.uint64, len(index))
    place = np.concatenate(at) if at else np.zeros(0, np.int64)
    del at, index
    with np.errstate(over="ignore"):
        word = _mix(distinct)[place] | np.uint64(1)  # never ALL, never the mark for none
        inside = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = [word]
        for k in range(2, order + 1):
            longer = np.zeros(len(word), np.uint64)
            if len(word):
                longer[1:] = _mix(found[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(k)) | np.uint64(1)
            longer[inside < k - 1] = 0
            found.append(longer)
    return sizes, found


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, which shuffle compression makes short where high bytes are alike."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's share of the sorted ``keys`` begins, and the end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _own(owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each one's document holds its n-gram: pairs of document and n-gram, counted."""
    pair = owner * (int(of.max(initial=0)) + 1) + of
    order = np.argsort(pair, kind="stable")
    ordered = pair[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(pair) else np.zeros(0, np.int64)
    sizes, out = np.diff(first, append=len(pair)), np.empty(len(pair), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def score(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``log_score``, ``mean_log_score`` and ``n_backoffs`` (words of history given up) of each row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(2 * tasks(spark), math.ceil(total / BATCH_BYTES))
    parts = max(tasks(spark), math.ceil(total / BATCH_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    # Both uses of this table share one exchange.
    place = F.pmod(F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id()), F.lit(batches)).cast("int")
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), place.alias("batch")).repartition(max(tasks(spark), batches // 4), "batch")

    def ask(table: pa.Table) -> pa.Table:
        sizes, found = grams(table["text"].to_pylist(), order)
        every = np.concatenate([h[h != 0] for h in found])
        keys, counts = np.unique(every, return_counts=True)
        keys, counts = np.concatenate([[ALL], keys]), np.concatenate([[sizes.sum()], counts])
        at = _bounds(keys, parts)
        full = np.flatnonzero(np.diff(at))
        rows = [(keys[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in full]
        # Sorted keys as differences have fewer bytes.
        asked = [pack(np.diff(k, prepend=np.uint64(0))) for k, _ in rows]
        batch = table["batch"][0].as_py()
        return pa.table({"batch": pa.array([batch] * len(full), pa.int32()), "part": pa.array(full, pa.int32()), "keys": pa.array(asked, pa.binary()), "counts": pa.array([pack(c) for _, c in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(b), dtype=np.uint64) for b in table["keys"].to_pylist()]
        counts = np.concatenate([unpack(b) for b in table["counts"].to_pylist()])
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.uint64)
        np.add.at(sums, of, counts)
        told = np.split(sums[of], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"batch": table["batch"], "part": table["part"], "counts": pa.array([pack(x) for x in told], pa.binary())})

    def scores(texts: pa.Table, told: pa.Table) -> pa.Table:
        sizes, found = grams(texts["text"].to_pylist(), order)
        every = np.concatenate([h[h != 0] for h in found])
        _, of = np.unique(every, return_inverse=True)
        told = told.sort_by("part")
        counts = np.concatenate([unpack(b) for b in told["counts"].to_pylist()]).astype(np.float64)
        n, counts = counts[0], counts[1:][of]
        held, at = [], 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for h in found:
            c, there = np.zeros(len(h)), h != 0
            here = int(there.sum())
            c[there] = counts[at : at + here] - _own(owner[there], of[at : at + here])
            at += here
            held.append(c)
        place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        history = np.minimum(place, order - 1)
        # From no history to the longest: the last that is held counts.
        log, used = np.log(np.maximum(held[0], 1) / np.maximum(n - sizes, 1)[owner]), np.zeros(len(place), np.int64)
        for k in range(1, order):
            seen = held[k] > 0
            before = np.concatenate([[0.0], held[k - 1][:-1]])
            log[seen] = np.log(held[k][seen] / before[seen])
            used[seen] = k
        given_up = history - used
        log = log + given_up * math.log(BACKOFF)
        sums = np.bincount(owner, log, len(sizes))
        return pa.table({"key": texts["key"], "n_words": pa.array(sizes), "log_score": pa.array(sums), "n_backoffs": pa.array(np.bincount(owner, given_up, len(sizes)).astype(np.int64))})

    asked = dealt.groupBy("batch").applyInArrow(ask, "batch int, part int, keys binary, counts binary")
    told = asked.repartition(parts, "part").groupBy("part").applyInArrow(answer, "batch int, part int, counts binary")
    found = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(scores, f"key {kind}, n_words bigint, log_score double, n_backoffs bigint")
    return found.select(F.col("key").alias(key), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "n_backoffs")


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return score(documents(spark, sf_dir))
