"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set: its lower-cased words, weighted by how often each occurs.  For every sample ``k`` and word, a hash of the
two gives uniform numbers and from them ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``.  With weight ``S``, ``t = floor(ln S / r + b)`` and
``ln a = ln c - r (t - b + 1)``; the word with the least ``a`` is the sample.  Two documents' samples agree with a probability equal to
their generalised Jaccard similarity, the sum of lesser over the sum of greater weights.  Since ``a`` depends on the word and ``t`` alone,
the least ``ln a`` itself identifies the sample, and a signature is one minimum per ``k``.

Texts move once, to range buckets of the key, where each also meets its successor; everything after that is grouped inside buckets.
A document without words has empty samples, which equal only other empty samples.  A null text counts as empty.  Null keys come first and
rows that share a key are ordered by a hash of their texts, so that a key with many rows fills several buckets; repeated rows follow each
other and each has a result.  An empty table gives an empty result.  Only key and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import documents, tasks
from arbora.llm.quality import words

SAMPLES = 64
#: Samples taken in one pass over a document's words.
GROUP = 8
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 4 << 20
_UNIT = 2.0**-32


def _uniform(h: Column, shift: int) -> Column:
    """32 bits of ``h`` as a number above 0 and below 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(0xFFFFFFFF) + F.lit(0.5)) * F.lit(_UNIT)


def log_sample(term: Column, k: Column, log_weight: Column) -> Column:
    """``ln a`` of a word (by 64-bit hash) in sample ``k``; null for a null weight."""
    g1, g2, g3 = (F.xxhash64(term, k, F.lit(salt)) for salt in (1, 2, 3))
    r = -F.log(_uniform(g1, 0) * _uniform(g1, 32))
    log_c = F.log(-F.log(_uniform(g2, 0) * _uniform(g2, 32)))
    b = _uniform(g3, 0)
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row for each ``keys`` and ``part`` (of ``GROUP`` samples), with an array of samples for each of the ``weights``.

    ``terms`` has one row for each document and word: ``keys``, ``term`` (its hash; null for a document without words) and the weights,
    null where a text does not hold the word.
    """
    parts = -(-samples // GROUP)
    spread = terms.withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(parts)])))
    logs = spread.select(*keys, "part", "term", *[F.log(F.col(w)).alias(f"__{w}") for w in weights])
    least = [F.min(log_sample(F.col("term"), F.col("part") * GROUP + j, F.col(f"__{w}"))).alias(f"{w}{j}") for w in weights for j in range(GROUP)]
    found = logs.groupBy(*keys, "part").agg(*least)
    return found.select(*keys, "part", *[F.array(*[F.col(f"{w}{j}") for j in range(GROUP)]).alias(w) for w in weights])


def _agreeing(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(j)).eqNullSafe(F.get(b, F.lit(j))).cast("int") for j in range(GROUP)), F.lit(0))


def _hex(samples: Column) -> Column:
    """Eight hex digits of a hash of each sample; zeros for an empty one."""
    digits = [F.lpad(F.lower(F.hex(F.xxhash64(s).bitwiseAND(0xFFFFFFFF))), 8, "0") for s in (F.get(samples, F.lit(j)) for j in range(GROUP))]
    return F.concat(*[F.when(F.get(samples, F.lit(j)).isNull(), F.lit("0" * 8)).otherwise(d) for j, d in enumerate(digits)])


#: A place in the order of rows: 0 for a null key, the key, a hash of the text.
Place = tuple[int, int, int]
_PLACE = ("__known", "__key", "__hash")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("key").isNotNull().cast("bigint").alias("__known"), F.coalesce("key", F.lit(0)).cast("bigint").alias("__key"), F.xxhash64("text").alias("__hash"))


def _with_bucket(rows: DataFrame, bounds: list[Place]) -> DataFrame:
    """``__bucket``: the index of the last of ``bounds`` that is not above the row's place, by binary search in literal arrays."""
    arrays = [F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in range(3)]
    rows, step = rows.withColumn("__bucket", F.lit(0)), 1 << max(0, len(bounds) - 1).bit_length()
    while step >= 1:
        to = F.col("__bucket") + step
        below = F.lit(True)
        for array, name in reversed(list(zip(arrays, _PLACE, strict=True))):
            there = F.get(array, to)
            below = (there < F.col(name)) | ((there == F.col(name)) & below)
        rows, step = rows.withColumn("__bucket", F.when((to < len(bounds)) & below, to).otherwise(F.col("__bucket"))), step // 2
    return rows


def _bounds(rows: DataFrame) -> list[Place]:
    """The first place of each bucket.  A key that fills several buckets, or a null key, is cut by the hash of its texts."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("key").alias("known")).first()
    buckets = max(4 * tasks(rows.sparkSession), math.ceil((size["bytes"] or 0) / BUCKET_BYTES))
    cut = lambda known, key, parts: [(known, key, (i << 64) // parts - (1 << 63)) for i in range(parts)]
    found = cut(0, 0, max(1, math.ceil(buckets * (size["n"] - size["known"]) / max(1, size["n"]))))
    keys = rows.agg(F.percentile_approx("key", [i / buckets for i in range(buckets)], 10 * buckets + 1000)).first()[0]
    for key, parts in sorted(Counter(keys or []).items()):
        found += cut(1, key, parts)
    firsts = _with_bucket(rows, found).groupBy("__bucket").agg(F.min(F.struct(*_PLACE)).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in firsts) or [(0, 0, 0)]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket``, ``place``, ``guest``, ``key``, ``text``, ``next_text``: each row beside the next by ascending integer ``key`` (null first; ties by a hash of the text).

    The last row's next is the first.  A bucket also holds the first row of the next bucket as a ``guest``, for what has to be known of it there.
    """
    rows = _placed(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    bounds = _bounds(rows)
    rows, n = _with_bucket(rows, bounds), len(bounds)
    first = F.lit(True)
    for i, name in enumerate(_PLACE):
        first = first & (F.get(F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>"), F.col("__bucket")) == F.col(name))
    bucket = F.col("__bucket")
    own, guest = F.struct(bucket.alias("b"), F.lit(False).alias("guest")), F.struct(((bucket + n - 1) % n).alias("b"), F.lit(True).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("bucket").orderBy("guest", *_PLACE, "text")
    rows = rows.select(F.col("at.b").alias("bucket"), F.col("at.guest").alias("guest"), "key", "text", *_PLACE)
    return rows.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop(*_PLACE)


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are to each other and to the next text's.

    The edited text has its last quarter (in code points, rounded down) replaced by the next text's first as many.  Returns ``key``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    rows = with_next(df, key, text)
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), size - cut)
    edited = F.concat(head, F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(F.coalesce(edited, F.lit(""))))
    # Words that both texts begin with are taken once: all of the common head but its last, which may be cut.
    keys = ["bucket", "place", "guest", "key"]
    split = rows.select(*keys, words(F.lower("text")).alias("w"), words(F.lower("edited")).alias("e"), F.greatest(F.size(words(F.lower(head))) - 1, F.lit(0)).alias("common"))
    split = split.withColumn("common", F.when(F.col("guest"), 0).otherwise(F.least("common", F.size("w"), F.size("e"))))
    tail = F.slice(F.col("e"), F.col("common") + 1, F.size("e"))
    each = split.select(*keys, "common", F.size("w").alias("own"), F.posexplode_outer(F.concat("w", tail)).alias("at", "word"))
    pos, there = F.col("at"), F.col("word").isNotNull()
    each = each.select(*keys, F.when(there, F.xxhash64("word")).alias("term"), (there & (pos < F.col("own"))).cast("int").alias("a"), (there & ((pos < F.col("common")) | (pos >= F.col("own")))).cast("int").alias("b"))
    terms = each.groupBy(*keys, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    terms = terms.select(*keys, "term", F.when(F.col("a") > 0, F.col("a")).alias("a"), F.when(F.col("b") > 0, F.col("b")).alias("b"))
    found = signatures(terms, keys, ["a", "b"], samples)
    found = found.withColumn("next", F.lead("a").over(Window.partitionBy("bucket", "part").orderBy("place"))).filter("not guest")
    per_part = found.select("bucket", "place", "part", _agreeing(F.col("a"), F.col("b")).alias("e"), _agreeing(F.col("a"), F.col("next")).alias("n"), _hex(F.col("a")).alias("fa"), _hex(F.col("b")).alias("fb"))
    joined = per_part.groupBy("bucket", "place").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "fa", "fb"))).alias("f"))
    total = GROUP * -(-samples // GROUP)
    joined = joined.select(
        "bucket",
        "place",
        F.array_join(F.transform("f", lambda x: x["fa"]), "").alias("fingerprint"),
        F.array_join(F.transform("f", lambda x: x["fb"]), "").alias("edited_fingerprint"),
        (F.col("e") / total).alias("near_edited"),
        (F.col("n") / total).alias("near_next"),
    )
    facts = rows.filter("not guest").select("bucket", "place", "key", size.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(joined, ["bucket", "place"]).select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's and every edited document's fingerprint."""
    return fingerprint(documents(spark, sf_dir))
