import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsync.llm import lm

SCHEMA = "doc_id long, text string, token string, c string"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def test_filter_reads_levels_back():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**64, 4000, np.uint64)
    counts = rng.integers(1, 3000, 4000)
    shares, bits = 3, 20
    levels = lm.level(counts)
    order = grams >> np.uint64(61)
    data = np.concatenate([lm.enter(grams[order == s], levels[order == s], shares, bits) for s in range(8)])
    assert len(data) == 1 << bits - 3
    got = lm.probe(grams, data, shares, bits)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    for k in range(4):  # the same from a slice
        mine = grams >> np.uint64(62) == k
        assert (lm.probe(grams[mine], data[k * len(data) // 4 : (k + 1) * len(data) // 4], shares, bits, 2) == got[mine]).all()
    assert (lm.probe(rng.integers(0, 2**64, 4000, np.uint64), data, shares, bits) > 0).mean() < 0.05
    assert lm.level(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2, 3]


def corpus(spark, sf):
    docs = [(r.doc_id, r.text, "t", "c") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(None, None, None, None), (7, "", None, None), (docs[0][0], docs[0][1], None, None), (-1, "xylo PHONE " * 50000, None, None)]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in docs]
    return docs, held, spark.createDataFrame(docs, SCHEMA), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))


def brute_scores(docs, held):
    """Scores from exact counts: levels, weights of pairs by EM over all training tokens, probabilities."""
    count, pair = Counter(), Counter()
    for (_, t, *_), h in zip(docs, held, strict=True):
        if not h:
            w = words(t)
            count.update(w)
            pair.update(zip(["start", *w[:-1]], w, strict=True))
    n, v = sum(count.values()), len(count)
    lev = lambda c: 0 if c < 1 else 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
    least = lambda q: 0.0 if q == 0 else 1.5 ** (q - 1)
    alone = lambda q: min(1, (least(q) + 0.1) / (n + 0.1 * (v + 1)))
    ratio = lambda b, a, less: max(0, least(b) - less) / max(max(least(a), least(b)) - less, 1)

    def levels(t):
        w = words(t)
        for x, y in zip(["start", *w[:-1]], w, strict=True):
            yield lev(pair[x, y]), lev(count[None if x == "start" else x]), lev(count[y])

    cells = Counter(c for (_, t, *_), h in zip(docs, held, strict=True) if not h for c in levels(t))
    share = [0.1] * 64
    for _ in range(20):
        top, low = Counter(), Counter()
        for (b, a, w), k in cells.items():
            p, q = share[a] * ratio(b, a, 1), (1 - share[a]) * alone(w)
            top[a] += k * p / (p + q)
            low[a] += k
        share = [top[a] / low[a] if low[a] else share[a] for a in range(64)]
    share = [min(x, 0.99) for x in share]
    return [sum(math.log10(share[a] * ratio(b, a, 0) + (1 - share[a]) * alone(w)) for b, a, w in levels(t)) for _, t, *_ in docs]


@pytest.mark.parametrize("slice_bits", [30, 24])
def test_scores_against_exact_counts(spark, sf, slice_bits):
    """With filters so empty that no probe goes wrong, scores are those of a plain model; slices change nothing."""
    docs, held, df, out = corpus(spark, sf)
    trained = lm.train(df.where(~out), fill=2e-3, slice_bits=slice_bits)
    assert (trained.model.slices > 0) == (slice_bits == 24)
    got = sorted(((r.doc_id, r.score) for r in lm.score(df, trained).collect()), key=str)
    want = sorted(((d[0], s) for d, s in zip(docs, brute_scores(docs, held), strict=True)), key=str)
    near = [g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-6) for g, w in zip(got, want, strict=True)]
    assert np.mean(near) > 0.97


@pytest.mark.parametrize("slice_bits", [30, 24])
def test_texts_are_read_once_for_all_slices(spark, sf, slice_bits):
    """Counting, tallying and scoring read each text once, whatever the number of slices, and scores are the same."""
    _, _, df, _ = corpus(spark, sf)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    told = df.mapInArrow(counted, df.schema)
    trained = lm.train(told, fill=2e-3, slice_bits=slice_bits)
    assert (1 << trained.model.slices > 1) == (slice_bits == 24)
    got = sorted(r.score for r in lm.score(told, trained).collect())
    assert read.value == 3 * df.count()
    data = np.concatenate([part for _, part in trained.slices()])
    one = lm.Model(**{**vars(trained.model), "slices": 0})
    assert got == pytest.approx(sorted(one.scores([lm.tokens(r.text) for r in df.collect()], [data])))


@pytest.mark.parametrize("tables", ["sf0.001", "sf0.01"])
def test_filters_grow_with_the_corpus(spark, tables):
    docs = spark.read.parquet(f"/root/testdata/{tables}/documents.parquet")
    trained = lm.train(docs)
    for data in (trained.model.words, next(trained.slices())[1]):
        assert np.bitwise_count(data).sum() <= 0.26 * 8 * len(data)
    rows = lm.score(docs, trained).collect()
    assert len(rows) == docs.count() and all(r.score <= 0 for r in rows)


@pytest.mark.parametrize("head", [5, 100_000])
def test_scores(spark, sf, head):
    docs, held, df, out = corpus(spark, sf)
    got = sorted((tuple(r) for r in lm.score(df, lm.train(df.where(~out), head=head)).collect()), key=str)
    train = Counter(w for (_, t, *_), h in zip(docs, held, strict=True) if not h for w in words(t))
    n, v = sum(train.values()), len(train)
    want = []
    for d, t, *_ in docs:
        w = words(t)
        want.append((d, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and g[5] <= 0
    # Pairs help: held-out texts are likelier under the model than by word counts alone.
    ids = {d for (d, *_), h in zip(docs, held, strict=True) if h and d is not None}
    assert sum(g[5] for g in got if g[0] in ids) > sum(g[4] for g in got if g[0] in ids)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    trained = lm.train(none)
    assert lm.score(none, trained).count() == 0
    one = lm.score(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), trained).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (3, 0, 0) and one.base_score == pytest.approx(0)
