"""SimHash near-duplicates: fingerprints of word shingles, and components of those that differ in few bits.

**Candidates.**  Of ``B`` bit blocks, two fingerprints within distance ``r`` agree on at least ``B - r``.  Each distinct fingerprint is
therefore sent once for every choice of ``B - r`` blocks, keyed by the choice and those blocks' bits.  ``B`` grows with the number of
fingerprints, so that a key holds few of them; the search is exact for any ``B``.

**Index.**  Within a key, fingerprints are sorted by Gray rank, which puts those that share bit patterns side by side.  Runs of them form
leaves, runs of leaves form nodes, and so on.  A node factors out the bits on which all below it agree (a mask and a pattern); what its
parent has factored out is left away.  A search goes down from the root, adds up the differences on each node's own mask, and drops a
whole group once the sum exceeds ``r``.

**Hot keys.**  A key with more than ``GROUP`` fingerprints is dealt into chunks by hash, and every pair of chunks is searched as a group of
its own, so no task holds an unbounded group and no pair is missed.  A task returns only a spanning forest of the links that it finds.

Components come from alternating large-star and small-star rounds on the forest, as joins and minima.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import cut, documents, durable, slices, tasks

BITS = 64
SEED = 42
GROUP = 2048
LEAF, FAN = 16, 8
#: Pairs of query and code that a search may have in hand at once.
BLOCK = 1_000_000
#: Rows of the candidate table in a task.
TASK_ROWS = 250_000
#: Parts that the rows of a key, root or fingerprint are dealt into.
SALTS = 64


# ---------------------------------------------------------------- fingerprints


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        part = np.asarray(hashes[at : at + 65_536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes.  A null text has no words; without words the fingerprint is 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: lower() changes A-Z only, split() takes U+0020 and U+0009 to U+000D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[:n].tolist(), ends[width - 1 :].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    return majority(np.array(hashes, np.uint64))


def with_fingerprint(df: DataFrame, text: str = "text", width: int = 4, name: str = "fingerprint") -> DataFrame:
    """``df`` with ``name`` bigint: the whole text's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, width) for x in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, name])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.mapInArrow(run, ", ".join([*rest, f"`{name}` bigint"]))


# ---------------------------------------------------------------- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Codes in Gray order under nodes that hold the bits their codes share; a tree of its own for each group of codes."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes = codes[self.order]
        sizes = np.unique(group, return_counts=True)[1]
        # Upwards: over each run of codes, then of nodes, the bits on which it agrees.
        ones, zeros, counts, levels = self.codes, ~self.codes, sizes, []
        while not levels or counts.max(initial=0) > 1:
            wide = FAN if levels else LEAF
            first, runs = np.cumsum(counts) - counts, -(-counts // wide)
            start = np.repeat(first - wide * (np.cumsum(runs) - runs), runs) + wide * np.arange(int(runs.sum()))
            end = np.minimum(start + wide, np.repeat(first + counts, runs))
            if len(start):
                ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_and.reduceat(zeros, start)
            levels.insert(0, (start, end, ones | zeros, ones))
            counts = runs
        # Downwards: a node keeps only what those above it have not factored out.
        self.levels, above = [], np.zeros(len(sizes), np.uint64)
        for start, end, mask, pattern in levels:
            self.levels.append((start, end, mask & ~above, pattern))
            above = np.repeat(mask, end - start)
        self.rest, self.sizes = ~above, sizes

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of positions in ``codes`` as given, of one group, at a distance of ``radius`` or less; both directions and self."""
        root = np.repeat(np.arange(len(self.sizes)), self.sizes)
        load = np.cumsum(np.repeat(self.sizes, self.sizes)) // BLOCK
        for a, b in itertools.pairwise([*np.flatnonzero(np.diff(load, prepend=-1)), len(root)]):
            q = np.arange(a, b)
            node, spent = root[a:b], np.zeros(b - a, np.uint8)
            for start, end, mask, pattern in self.levels:
                spent = spent + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
                near = spent <= radius
                q, node, spent = q[near], node[near], spent[near]
                width = end[node] - start[node]
                first = np.repeat(start[node] - (np.cumsum(width) - width), width)
                q, spent, node = np.repeat(q, width), np.repeat(spent, width), first + np.arange(int(width.sum()))
            spent = spent + np.bitwise_count((self.codes[q] ^ self.codes[node]) & self.rest[node])
            near = spent <= radius
            yield self.order[q[near]], self.order[node[near]]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position in each position's component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if not (off := low < high).any():
                break
            np.minimum.at(root, high[off], low[off])
            while (root[root] != root).any():
                root = root[root]
            a, b = a[off], b[off]
    return root


# ---------------------------------------------------------------- links


def block_count(n: int, radius: int) -> int:
    """The least number of blocks (over ``radius``) for which a key holds ``GROUP`` of ``n`` codes or fewer on average."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n / 2 ** (BITS * (blocks - radius) / blocks) <= GROUP:
            return blocks
    return 2 * radius


def links(codes: DataFrame, radius: int = 4, name: str = "fingerprint") -> DataFrame:
    """A spanning forest of the links between the distinct ``codes``: columns ``a`` > ``b``, perhaps with repeats."""
    n = codes.count()
    blocks = block_count(n, radius)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << BITS) if m >> 63 else m for m in masks]
    keyed = codes.select(F.col(name).alias("code"), F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("choice", "mask"))
    keyed = keyed.select("code", "choice", F.col("code").bitwiseAND(F.col("mask")).alias("bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members")).filter("members > 1")
    keyed = keyed.join(sizes, ["choice", "bits"])
    # One chunk where the key is small; else every chunk meets every chunk.
    chunks = F.ceil(F.col("members") / (GROUP // 2))
    keyed = keyed.withColumn("chunks", F.when(F.col("members") <= GROUP, 1).otherwise(chunks).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = keyed.select("code", "choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    # By number, so that adaptive execution doesn't join these small but laborious partitions.
    parts = max(tasks(codes.sparkSession), math.ceil(2 * n * len(masks) / TASK_ROWS))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["code", "choice", "bits", "low", "high"], dtype=np.int64)])
        group = rows.groupby(["choice", "bits", "low", "high"]).ngroup().to_numpy()
        values, at = np.unique(rows["code"].to_numpy(np.int64), return_inverse=True)
        index = GrayIndex(values[at].view(np.uint64), group)
        root = forest(len(values), ((at[x], at[y]) for x, y in index.links(radius)))
        off = np.flatnonzero(root != np.arange(len(values)))
        yield pd.DataFrame({"a": values[off], "b": values[root[off]]})

    return keyed.repartition(parts, "choice", "bits", "low", "high").mapInPandas(search, "a bigint, b bigint")


def with_least(rows: DataFrame, key: str, value: str, by: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the least ``value`` among the rows of their ``key``, null if it has none.

    A key may hold a third of all rows: both the minimum and the join back are dealt by the key and a salt, a hash of ``by``.  The salts
    that a key has, ``SALTS`` at most, travel with its minimum, so each salted group meets one row.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    least = salted.groupBy(key, "__salt").agg(F.min(value).alias(name)).groupBy(key).agg(F.min(name).alias(name), F.collect_list("__salt").alias("__salts"))
    least = least.select(key, name, F.explode("__salts").alias("__salt"))
    return salted.join(least, [key, "__salt"]).drop("__salt")


def components(pairs: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node that each node of the links ``a``, ``b`` reaches.  Nodes without links are left away.

    Alternates large-star (every greater neighbour to the least) and small-star (every lesser neighbour to the least) until the edges
    stay the same; each round's edges are checkpointed.
    """
    edges = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "b", "m").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_least(large, "a", "b", "b", "m").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        mark = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``carry``, ``fingerprint`` bigint and ``component_id``: the least key that the row reaches over links, itself included.

    Exact and repeated texts share a fingerprint and so a component; null and wordless texts have fingerprint 0 and link like any other.
    Repeated rows each have a result, as have rows that share a key; a component of rows without a key has none.
    An empty table gives an empty result.  Only keys and 8-byte codes move, never texts.  Columns ``carry`` may have any name but those of the result and ``salt``.
    """
    prints = durable(with_fingerprint(df.select(key, *carry, text), text, width), "simhash").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    # Per code, however many rows share it, one row from here on.
    by_salt = prints.groupBy("fingerprint", "salt").agg(F.min(key).alias("least"))
    codes = durable(by_salt.groupBy("fingerprint").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts")), "simhash-codes")
    roots = components(links(codes.select("fingerprint"), radius))
    rooted = codes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", "salts", F.coalesce("root", "fingerprint").alias("root"))
    named = with_least(rooted, "root", "least", "fingerprint", "component_id")
    # Copies share a fingerprint, perhaps a third of all rows: a code meets them by salt.
    named = named.select("fingerprint", "component_id", F.explode("salts").alias("salt"))
    return prints.join(named, ["fingerprint", "salt"]).select(key, *carry, "fingerprint", "component_id")


def hex64(column: str) -> Column:
    """A signed number's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex64("fingerprint").alias("fingerprint"), "component_id")
