"""The corpus pipeline: language, quality, near duplicates, mixture and token ids, each stage on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe, common, language, mixing, nearcopies, quality
from arbora.session import ship

#: Documents whose predicted language has a lower probability are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.4

#: SQL can express neither a trained network nor components of near duplicates: tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or of no clear language; fills in a null ``lang``."""
    ship(spark)
    net = language.learn(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    found = language.identify(docs, net, keep_text=True)
    known = (F.col("lang_pred") != language.UNDEFINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the quality rules; those kept lose their failing lines."""
    judged = quality.clean_lines(docs)
    # A filter would be pushed below the rules and make them run twice for each text; a generator is not.
    verdict = F.filter(F.array(F.struct("kept", "cleaned")), lambda v: v["kept"])
    kept = judged.select(*[c for c in docs.columns if c not in ("text", "n_chars")], F.explode(verdict).alias("__v")).withColumn("text", F.col("__v.cleaned"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document stays: the least ``doc_id``, of its texts that share it the one with the least hash.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: SimHash fingerprints in the Gray-order index, and bands
    of minima for what lies beyond its radius; every link is checked.
    Rows are told apart by ``doc_id`` and text; those equal in both stay once.  Rows without ``doc_id`` stay, once for each text.
    """
    ship(spark)
    marked = docs.withColumn("__text", F.xxhash64("text"))
    found = nearcopies.near_copies(marked, carry=("__text",)).filter("doc_id is not null")
    # Per component, not per doc_id: unlike texts may share the least one. A text is of one component, so no other's row is meant.
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "__text")).alias("__first")).select("__first.*").withColumn("__stays", F.lit(True))
    # Equal keys in the join and the distinct: one exchange.
    kept = marked.join(stay, ["doc_id", "__text"], "left").filter("doc_id is null or __stays")
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says: a rate of 1 or more never drops it.  Rows without ``doc_id`` stay once.

    Rows that share a ``doc_id`` are told apart by their texts, so repeated rows are not multiplied with each other.
    """
    ship(spark)
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marked = docs.withColumn("__text", F.xxhash64("text"))
    copies = mixing.mix(marked, labels, mixing.TARGETS, carry=("__text",)).filter("doc_id is not null").select("doc_id", "__text", "copies")
    # Equal keys have equal copies; the join needs the same exchange as the distinct.
    both = marked.join(copies.dropDuplicates(["doc_id", "__text"]), ["doc_id", "__text"], "left")
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1))))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it.  A null text counts as empty: no ids, and decoded rightly."""
    ship(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("quality", clean_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's table goes once the next one is written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, common.durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(before)
    return docs
