"""The pipeline's stages on odd documents and on none."""

from __future__ import annotations

import random

import corpus_pipeline
from arbora.llm import mixing, nearcopies, simhash


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, odd).collect()}
    assert not kept & {12, 15, 18, 21} and {0, 3, 24, 27, 30} <= kept
    clean = corpus_pipeline.clean_quality(spark, docs, odd)
    assert clean.columns == docs.columns and not {r["doc_id"] for r in clean.collect()} & {39, 42, 12, 15}
    once = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs.union(docs), odd).collect()}
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert once == groups and corpus_pipeline.drop_near_duplicates(spark, docs.union(docs), odd).count() == len(groups)
    tokens = corpus_pipeline.encode_tokens(spark, docs.union(docs), odd).collect()
    assert len(tokens) == 2 * docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_stages_keep_repeated_rows_and_long_texts(spark, odd):
    """Language and quality judge each row for itself: a repeated row goes or stays as often as it is there, and the very long text is whole."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.clean_quality):
        twice = stage(spark, docs.union(docs), odd).groupBy("doc_id", "text").count().collect()
        assert twice and {r["count"] for r in twice} == {2}
        (long,) = (r["text"] for r in twice if r["doc_id"] == 33)
        assert len(long.split()) == 30_000
    (tokens,) = corpus_pipeline.encode_tokens(spark, docs.filter("doc_id = 33"), odd).collect()
    assert tokens["round_trip"] and tokens["n_tokens"] > 30_000


def test_shared_ids(spark, odd):
    """Different texts under one ``doc_id``: none is lost to another's group, and none is multiplied."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # 27 copies 24; the texts of 0 and 3 under one id are of two groups.
    renamed = docs.filter("doc_id in (0, 3, 24, 27)").selectExpr("if(doc_id in (3, 27), 100, doc_id) doc_id", *[c for c in docs.columns if c != "doc_id"])
    kept = corpus_pipeline.drop_near_duplicates(spark, renamed, odd)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(0, texts[0]), (24, texts[24]), (100, texts[3])])
    shared = docs.filter("doc_id in (0, 3, 33)").withColumn("doc_id", docs["doc_id"] * 0)
    mixed = [r["text"] for r in corpus_pipeline.mix_sources(spark, shared, odd).collect()]
    rates = {r["__text"]: r["copies"] for r in mixing.mix(shared.selectExpr("*", "text as __text"), mixing.quality_domains(spark.read.parquet(f"{odd}/labels.parquet")), mixing.TARGETS, carry=("__text",)).collect()}
    assert {t: mixed.count(t) for t in rates} == rates


def test_unlike_texts_of_one_id(spark, odd):
    """Each component keeps a document, though the least ``doc_id`` of several is the same; a copy under a greater one goes."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shared = docs.filter("doc_id in (0, 3, 33, 24, 27)").selectExpr("if(doc_id = 27, 100, 5) doc_id", *[c for c in docs.columns if c != "doc_id"])
    kept = corpus_pipeline.drop_near_duplicates(spark, shared, odd)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((5, texts[k]) for k in (0, 3, 33, 24))


def test_near_copies_of_four_fifths(spark, odd):
    """Edited copies on both sides of 0.8: components are those of all pairs' exact similarity."""
    rng, texts = random.Random(4), []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for edits in (2, 4, 5, 6, 9):
            texts.append(" ".join(f"x{rng.randrange(5000)}" if i in {199 * k // edits for k in range(edits)} else w for i, w in enumerate(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert 12 < len(set(root)) < len(texts) - 12
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "", 0.5, 1, 2) for i, t in enumerate(texts)], spark.read.parquet(f"{odd}/documents.parquet").schema)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, odd).collect()} == set(root)


def test_links_between_components_of_a_bucket():
    """What sizes and sketches rule out is below 0.8; nothing else is."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(120)]
    sets = [nearcopies.np.unique(nearcopies.np.array([x if rng.random() > cut else rng.getrandbits(64) for x in base], "u8")) for cut in (0.02, 0.05, 0.1, 0.15) for _ in range(25)]
    size, sketches = nearcopies.np.array([len(s) for s in sets]), nearcopies.np.array([nearcopies.sketch(s) for s in sets])
    got = {(int(a), int(b)) for x, y in nearcopies.possible(nearcopies.np.arange(len(sets)), size, sketches, 0.8) for a, b in zip(x, y, strict=True)}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if nearcopies.alike(sets[i], sets[j]) >= 0.8}
    assert near and near <= got and len(got) < len(sets) * (len(sets) - 1) // 2


def test_empty(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
