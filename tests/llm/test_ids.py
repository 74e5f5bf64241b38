"""Ids over 2^53 beside a null, and a caller's other columns, come out as they went in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordsync.llm import align, decontam, linededup, lm, media, negatives, onebit, packing, quality, simhash, toxicity
from recordsync.llm._common import tokenizer_path

BIG, ITEM = 2**60, "the quick brown fox jumps over the lazy dog near the old river bank today"
IDS = [BIG + 1, None, BIG + 3]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{' '.join(w + str(k) for k in range(12))}\nshared line of words that stands in all three of these texts\n{ITEM}" for w in ("red", "green", "blue")]
    return spark.createDataFrame([(i, t, BIG + 7 if i else None) for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, extra long").coalesce(1)


def ids(df, column="doc_id"):
    return sorted({r[0] for r in df.select(column).collect()}, key=repr)


def same(df, column="doc_id"):
    assert ids(df, column) == sorted(IDS, key=repr)


def test_operators_keep_ids(spark, docs):
    rng = np.random.default_rng(0)
    same(quality.rank(docs, quality.fit_pairs(rng.normal(size=(20, quality.N_STATS)), np.arange(20) % 2)))
    same(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))
    same(simhash.near_groups(docs))
    same(lm.score(docs, lm.train(docs)))
    same(align.scores(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
    assert simhash.near_groups(docs).where("component_id is not null").select("component_id").distinct().first()[0] in (BIG + 1, BIG + 3)


def test_toxicity_keeps_all_columns(spark, docs, sf):
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxic_scores(docs.withColumn("list", F.array("extra", F.lit(None))), real, labels)
    assert sorted((r.doc_id, r.extra, tuple(r["list"])) for r in got.collect() if r.doc_id) == [(i, BIG + 7, (BIG + 7, None)) for i in IDS if i]
    same(got)


def test_leaks_keep_both_ids(spark, docs):
    items = spark.createDataFrame([(BIG + 11, ITEM), (None, ITEM.replace("quick", "slow")), (BIG + 13, "nothing of the kind stands in any of them")], "item_id long, text string").coalesce(1)
    got = decontam.leaks(docs, items)
    same(got)
    assert ids(got, "item_id") == sorted([BIG + 11, None], key=repr)


def test_earliest_line_stays(spark):
    """Twenty pairs of equal lines under neighbouring ids, and a null: the smaller id keeps its line."""
    rows = [(BIG + 2 * g + k, " ".join(f"{w}{g}" for w in "abcdefghij")) for g in range(20) for k in (1, 0)]
    docs = spark.createDataFrame([*rows, (None, "a text of its own without an id that has one line only")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_dropped for r in linededup.deduplicate(docs).collect()}
    assert got == {i: (i - BIG) % 2 for i, _ in rows} | {None: 0}


def test_vectors_and_pictures(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 1 + (i == BIG + 3)) for i in IDS], "vec_id long, embedding array<double>, label int").coalesce(1)
    drawn = media.pictures(vectors)
    assert ids(drawn, "image_id")[:2] == sorted([2 * i for i in IDS if i], key=repr)
    same(media.features(drawn.where("image_id is null or image_id % 2 = 0").select((F.col("image_id") / 2).cast("long").alias("x"), F.expr("image_id div 2").alias("image_id"), "width", "height", "pixels")), "image_id")
    v = vectors.select("vec_id", F.col("embedding").alias("v"))
    same(onebit.nearest(v, F.lit(True), 5), "query_id")
    same(onebit.nearest(v, F.lit(True), 5), "vec_id")
    whole = vectors.select("vec_id", F.lit(1).alias("label"), F.array(F.lit(1)).alias("v")).unionByName(vectors.select("vec_id", F.lit(2).alias("label"), F.array(F.lit(1)).alias("v")))
    assert ids(negatives.mine(whole, F.lit(True), low=0, high=100), "negative_id") == sorted(IDS, key=repr)


def test_pipeline_stages(spark, docs, sf):
    """The first four stages hand on ids and the extra column."""
    one = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        one = stage(spark, one, sf)
        same(one)
        assert {r.extra for r in one.collect()} == {BIG + 7, None}, name
    for name, stage in corpus_pipeline.STAGES[2:4]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and set(ids(got)) <= set(IDS), name
    same(corpus_pipeline.STAGES[4][1](spark, docs, sf))
