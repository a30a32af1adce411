"""SimHash near-dedup at a similarity: components of texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

**SimHash.**  Every set has a SimHash fingerprint, and the Gray-order index links those within ``RADIUS`` bits.  That finds copies of about 0.95 and more;
at 0.8 two fingerprints differ in 10 bits of 64 on average, a radius in which the index would have to be asked about most of a large corpus.

**Beyond the radius.**  ``BANDS`` bands of ``ROWS`` minima each: two sets of similarity s agree on a band with chance s^ROWS, so of the pairs at 0.8
about 5 in 10^8 agree on none.  Sets that agree on a band share a bucket.  Each member of a bucket is
compared with one member, another in each band, which joins large groups of copies without all their pairs.  Buckets that then still hold
several components have all pairs between these compared, but for those that sizes and parity sketches rule out: a bit of a sketch is the
parity of the shingles that fall on it, so two sets differ in at least as many shingles as their sketches in bits.

Every candidate from either is checked against the sets themselves before it links; no estimate decides.  Sets travel as the texts they come
from.  Texts with equal sets are one code from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm import simhash
from arbora.llm.common import durable, release, slices, tasks
from arbora.llm.simhash import GROUP, SALTS, SEED, components

WIDTH, LEAST, RADIUS = 5, 0.8, 4
BANDS, ROWS = 32, 4
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Rows of buckets in a task, about.
TASK_ROWS = 100_000
_MINIMA = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes of ``width`` words in a row, sorted; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends + 1).tolist()]
    last = ends[width - 1 :].tolist() or ends[-1:].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64))


def code_of(found: np.ndarray) -> int:
    """A signed number that stands for a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED) | 1).view(np.int64)) if len(found) else 0


def bands(found: np.ndarray) -> np.ndarray:
    """A bucket for each band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 4096):  # bounded memory for very long texts
        x = found[None, at : at + 4096] * _MINIMA[0] + _MINIMA[1]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _MINIMA[0]).min(1))
    x = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """Bit b is 1 if an odd number of the set's shingles fall on it."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def with_bands(df: DataFrame, text: str, width: int) -> DataFrame:
    """``df`` with ``code``, ``fingerprint`` and ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x, width) for x in batch.column(text).to_pylist()]
            code, buckets = pa.array([code_of(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            prints = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, code, prints, buckets], names=[*batch.schema.names, "code", "fingerprint", "buckets"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "code bigint", "fingerprint bigint", "buckets array<bigint>"]))


def checked(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``a``, ``b`` whose sets are alike.  Many pairs may share their ``b``: its text meets them by salt."""
    pairs = pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    ends = pairs.select("b", "salt").distinct().join(texts.select(F.col("code").alias("b"), F.col("text").alias("text_b")), "b")
    both = pairs.join(texts.select(F.col("code").alias("a"), F.col("text").alias("text_a")), "a").join(ends, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets: dict[int, np.ndarray] = {}
            keep = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                for code, text in ((a, x), (b, y)):
                    if code not in sets:
                        sets[code] = shingles(text, width)
                keep.append(alike(sets[a], sets[b]) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """``code``, ``size`` and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(map(len, sets), pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["code", "size", "sketch"])

    return texts.mapInArrow(run, "code bigint, size bigint, sketch binary")


def possible(root: np.ndarray, size: np.ndarray, sketches: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of different roots that neither sizes nor sketches rule out."""
    for at in range(0, len(root), 64):
        q = slice(at, at + 64)
        both = size[q, None] + size[None]
        far = np.zeros(both.shape, np.int64)
        for k in range(sketches.shape[1]):
            far += np.bitwise_count(sketches[q, None, k] ^ sketches[None, :, k])
        low = np.minimum(size[q, None], size[None])
        # Jaccard s means a difference of (1 - s) / (1 + s) of both sizes together; the little more is for rounding.
        fits = (far <= both * (1 - least) / (1 + least) + 1e-6) & (low >= least * (both - low) - 1e-6)
        x, y = np.nonzero(fits & (root[q, None] != root[None]))
        before = x + at < y
        yield x[before] + at, y[before]


def salted(by: str) -> Column:
    """The part that a row of a bucket is dealt to, so that no bucket lands in one task."""
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts_of(salt: str) -> Column:
    """An aggregate: the salts that a group has, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def each_salt(salts: str) -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> ({salts} & shiftleft(1L, i)) <> 0)"))


def with_root(rows: DataFrame, roots: DataFrame, code: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the root of ``code``, itself where it has no link."""
    return rows.join(roots.select(F.col("node").alias(code), F.col("root").alias(name)), code, "left").withColumn(name, F.coalesce(name, code))


def between(placed: DataFrame, roots: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs ``a``, ``b`` of different components that share a bucket and may be alike."""
    rows = with_root(placed.filter("n > 2").select("bucket", "salt", "code", "n"), roots, "code", "root")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), salts_of("salt").alias("salts")).filter("x <> y").select("bucket", each_salt("salts").alias("salt"))
    rows = rows.join(mixed, ["bucket", "salt"]).join(sketched(texts, width), "code")
    # One chunk where the bucket is small; else every chunk meets every chunk.
    rows = rows.withColumn("chunks", F.when(F.col("n") <= GROUP, 1).otherwise(F.ceil(F.col("n") / (GROUP // 2))).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("bucket", "code", "root", "size", "sketch", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        for _, g in pd.concat(held).groupby(["bucket", "low", "high"]) if held else ():
            codes, sketches = g["code"].to_numpy(np.int64), np.frombuffer(b"".join(g["sketch"]), "<u8").reshape(len(g), -1)
            for x, y in possible(g["root"].to_numpy(np.int64), g["size"].to_numpy(np.int64), sketches, least):
                yield pd.DataFrame({"a": np.maximum(codes[x], codes[y]), "b": np.minimum(codes[x], codes[y])})

    parts = max(tasks(placed.sparkSession), placed.count() // TASK_ROWS)
    return rows.repartition(parts, "bucket", "low", "high").mapInPandas(search, "a bigint, b bigint")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``key``, the columns ``carry`` and ``root``, a number that the rows of a component share.

    A null text counts as empty; texts without words are copies of each other.  Repeated rows each have a result.  An empty table gives an empty one.
    """
    marked = with_bands(df.select(key, *carry, F.col(text).alias("text")), "text", width)
    salt = F.pmod(F.xxhash64(key, *carry), F.lit(SALTS)).cast("int")
    prints = durable(marked.withColumn("salt", salt).withColumn("at", F.monotonically_increasing_id()), "near-copies")
    # Of the rows of a code, one.
    first = prints.groupBy("code").agg(F.min("at").alias("at"))
    codes = durable(prints.select("at", "code", "fingerprint", "buckets").join(first.select("at"), "at", "left_semi"), "near-copies-codes")

    # Codes of a fingerprint with the least of them, and those of fingerprints that the index links.
    named = simhash.with_least(codes.select("fingerprint", "code"), "fingerprint", "code", "code", "rep")
    reps = codes.groupBy("fingerprint").agg(F.min("code").alias("rep"))
    near = simhash.links(reps.select("fingerprint"), RADIUS)
    for end in ("a", "b"):
        near = near.join(reps.select(F.col("fingerprint").alias(end), F.col("rep").alias(f"{end}_rep")), end)
    pairs = named.filter("code <> rep").select(F.col("code").alias("a"), F.col("rep").alias("b")).union(near.select("a_rep", "b_rep"))
    # The least of code xor bucket is another member in each band.
    rows = codes.select("code", F.explode("buckets").alias("bucket"), salted("code").alias("salt"))
    shared = rows.groupBy("bucket").agg(F.min(F.col("code").bitwiseXOR(F.col("bucket"))).alias("pick"), F.count("*").alias("n"), salts_of("salt").alias("salts")).filter("n > 1")
    shared = shared.select("bucket", "n", F.col("pick").bitwiseXOR(F.col("bucket")).alias("rep"), each_salt("salts").alias("salt"))
    placed = durable(rows.join(shared, ["bucket", "salt"]).select("bucket", "salt", "code", "n", "rep"), "near-copies-placed")
    pairs = durable(pairs.union(placed.select("code", "rep")).filter("a <> b").distinct(), "near-copies-pairs")
    places = codes.select("code", "at").join(pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct(), "code", "left_semi").select("at")
    texts = durable(prints.select("at", "code", "text").join(places, "at", "left_semi").select("code", "text"), "near-copies-texts")
    found = durable(checked(pairs, texts, width, least), "near-copies-links")
    roots = components(found)
    more = durable(checked(between(placed, roots, texts, width, least), texts, width, least), "near-copies-more")
    if not more.isEmpty():
        roots = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    release(texts, placed, pairs, found, more)
    named = prints.select("code", "salt").distinct().join(roots, F.col("code") == F.col("node"), "left").select("code", "salt", F.coalesce("root", "code").alias("root"))
    return prints.select(key, *carry, "code", "salt").join(named, ["code", "salt"]).select(key, *carry, "root")
