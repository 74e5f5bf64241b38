import numpy as np
from pyspark.sql import functions as F

from recordsync.llm import quality, toxicity

SCHEMA = "doc_id long, text string, p_toxic string, y string, score string"


def corpus(n=400, seed=2):
    """Documents, of which some hold slurs and some are junk, and their labels."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.3, 60) % 900]
        toxic, junk = int(i % 5 == 0), int(i % 7 == 0)
        if toxic:
            words[3:3] = [f"slur{'abcdefgh'[x]}" for x in rng.integers(0, 8, 3)]
        if junk:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words), None, "y", "s"))
        labels.append((i, 1 - junk, toxic))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(None, None, None, None, None), (900, "", None, None, None), (901, "w1 " * 40000, None, None, None)], SCHEMA)
    lab = spark.createDataFrame([x for x in labels if x[0] < 250] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxic_scores(d, d, lab)
    assert sorted(out.columns) == sorted(["doc_id", "text", "y", "score", "p_low_quality", "p_toxic"])
    rows = out.collect()
    assert len(rows) == 403
    right = [(r.p_toxic >= 0.5) == (r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and 250 <= r.doc_id < 400]
    junk = [(r.p_low_quality >= 0.5) == (r.doc_id % 7 == 0) for r in rows if r.doc_id is not None and 250 <= r.doc_id < 400]
    assert np.mean(right) > 0.97 and np.mean(junk) > 0.97
    assert all(r.p_toxic < 0.5 for r in rows if r.doc_id in (None, 900, 901))


def test_earlier_probabilities_feed_later_models(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, (300, 2))
    y[:, 1] = y[:, 0]
    slots = [np.empty((0, 4), np.int32)] * 300
    dense = np.column_stack([y[:, 0] + rng.normal(0, 0.3, 300), rng.normal(0, 1, 300)])
    chain = toxicity.fit_rows(["a", "b"], y, dense, slots)
    mean, scale, weights = chain.models[1]
    assert len(weights) == len(chain.models[0][2]) + 1 and weights[-2] > 0.3


def test_no_labels_and_empty_tables(spark):
    docs, labels = corpus(20)
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    unknown = toxicity.toxic_scores(d, d, lab.where("false")).collect()
    assert len(unknown) == 20 and {r.p_toxic for r in unknown} == {None}
    assert toxicity.toxic_scores(none, d, lab).count() == 0
    one = toxicity.toxic_scores(d, d, lab.withColumn("toxic", F.lit(0))).collect()
    assert all(r.p_toxic < 0.5 for r in one)
    assert quality.rank(none, quality.fit(d, lab)).count() == 0
    assert {r.score for r in quality.rank(d, quality.fit(d, lab.where("false"))).collect()} == {0.5}
    assert {r.predicted for r in quality.rank(d, quality.fit(d, lab.where("quality = 0"))).collect()} == {0}


def test_ranking_on_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(None, None, None, None, None), (5, docs[5][1], None, None, None)], SCHEMA)
    lab = spark.createDataFrame([x for x in labels if x[0] < 250] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.rank(d, quality.fit(d, lab)).collect()
    assert len(rows) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 7 != 0) for r in rows if r.doc_id is not None and r.doc_id >= 250]) > 0.97
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_ranking_of_real_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = quality.rank(docs, quality.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97


def plain_logistic(x, y, l2, steps=4000, rate=0.5):
    """Weights of a penalised logistic regression by plain gradient steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w += rate * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - l2 * w) / len(x)
    return w


def test_ranking_against_plain_gradient_steps():
    """Weights from pairs equal those that plain steps find on the same pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 4))
    y = (x @ [1, -2, 0.5, 0] + rng.normal(0, 1, 60) > 0).astype(int)
    got = quality.fit_pairs(x, y, max_pairs=2000, l2=1.0, seed=5)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    draw = np.random.default_rng(5)
    d = z[draw.choice(np.flatnonzero(y == 1), 2000)] - z[draw.choice(np.flatnonzero(y == 0), 2000)]
    assert np.allclose(got.weights, plain_logistic(d, np.ones(2000), 1.0), atol=1e-3)
    s = z @ got.weights
    right = lambda t: np.mean((s >= t) == (y == 1))
    assert right(got.threshold) >= max(right(t) for t in np.quantile(s, np.linspace(0.005, 0.995, 199))) - 1e-9


def test_chain_against_its_parts():
    """The second link sees the first one's probabilities, each from a model that has not seen the row."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, (120, 2))
    dense = np.column_stack([y[:, 0] + rng.normal(0, 0.5, 120), y[:, 1] + rng.normal(0, 0.5, 120)])
    chain = toxicity.fit_rows(["a", "b"], y, dense, [np.empty((0, 4), np.int32)] * 120, folds=4, seed=3)
    fold = np.random.default_rng(3).permutation(120) % 4
    x = np.hstack([dense, np.zeros((120, 8))])
    earlier = np.zeros(120)
    for f in range(4):
        earlier[fold == f] = toxicity._probability(toxicity._logistic(x[fold != f], y[fold != f, 0]), x[fold == f])
    mean, scale, w = toxicity._logistic(np.column_stack([x, earlier]), y[:, 1])
    assert np.allclose(chain.models[1][2], w) and np.allclose(chain.models[1][0], mean)
    z = np.column_stack([np.clip((np.column_stack([x, earlier]) - mean) / scale, -3, 3), np.ones(120)])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (y[:, 1] - p) - np.append(w[:-1], 1e-6 * w[-1])).max() < 1e-3  # where the loss is least


def test_fits_do_not_depend_on_partitions(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs + [(i, t + " more words", None, None, None) for i, t, *_ in docs[:40]], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fits = [quality.fit(d.repartition(n), lab) for n in (1, 7)]
    assert np.array_equal(fits[0].weights, fits[1].weights)
