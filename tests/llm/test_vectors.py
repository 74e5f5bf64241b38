"""One-bit codes and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsync.llm import blocks, negatives, onebit

BIG = 2**60


def exact(q, x):
    total = 0.0
    for a, b in zip(q, x, strict=True):
        total += a * b
    return total


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def last(i):
    return (i is None, i or 0)


def nearest(rows, chosen, k):
    rows = [(i, v) for i, v in rows if good(v) and any(v)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i is not None and chosen(i):
            found = sorted(((-exact(q, v), last(j)) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q)))[:k]
            out += [(i, r + 1, None if j[0] else j[1], -s) for r, (s, j) in enumerate(found)]
    return sorted(out, key=repr)


def search(spark, rows, k, **parameters):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<double>, code string").repartition(4)
    return sorted(map(tuple, onebit.nearest(df, F.col("vec_id") % 20 == 0, k, **parameters).collect()), key=repr)


def test_odd_vectors(spark):
    """Nulls, zeros, NaN, infinities, other lengths, repeats, ties and ids beside a null."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6))
    rows = [(BIG + i, v.tolist()) for i, v in enumerate(base)]
    rows += [(None, base[3].tolist()), (BIG, base[0].tolist()), (40, [0.0] * 6), (60, None), (80, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (100, [math.nan] * 6), (120, [math.inf] * 6), (20, [1.0, 2.0]), (21, [2.0, 1.0]), (140, []), (160, [3.0])]
    rows += [(BIG + 1000 + i, base[5].tolist()) for i in range(45)]
    assert search(spark, rows, 20) == nearest(rows, lambda i: i % 20 == 0, 20)
    assert search(spark, rows[:3], 20) == nearest(rows[:3], lambda i: i % 20 == 0, 20)
    assert search(spark, [], 20) == []


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_recall(spark, shift):
    """Clustered vectors, also far from the origin, in small blocks: all that brute force finds."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(8, 32))
    x = (centre[rng.integers(0, 8, 3000)] + 0.6 * rng.normal(size=(3000, 32)) + shift).tolist()
    rows = list(enumerate(x))
    got = search(spark, rows, 10, row_block=700, query_block=40, bits=256)
    want = nearest(rows, lambda i: i % 20 == 0, 10)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.99 * len(want)


def test_first_scan_in_proportion(spark, monkeypatch):
    """Five times the blocks of rows give each query hardly more rows from the first scan, and the same neighbours as brute force."""
    made = spark.sparkContext.accumulator(0)

    def counted(scan, arguments, q, r):
        out = scan(q, r, *arguments)
        if scan is onebit._greatest:
            made.add(len(out))
        return out

    monkeypatch.setattr(onebit, "_call", counted)
    x = np.random.default_rng(4).normal(size=(2000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = search(spark, rows, 4, row_block=40, query_block=50, bits=128)
    # Of 50 blocks, 15 estimates of each would be 750 rows for each of the 100 queries.
    assert 0 < made.value < 100 * 300
    assert got == nearest(rows, lambda i: i % 20 == 0, 4)


def test_bounds_hold():
    """Estimates are off by more than the bound as seldom as it says, and smaller with more bits."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(400, 64)), rng.normal(size=(50, 64))
    errors = []
    for bits in (64, 512):
        codes, size, dot = onebit.encode(x, bits, 3)
        estimate, off = onebit.bounds(q, np.zeros(50), codes, size, dot, 2.0, 3)
        wrong = np.abs(estimate - q @ x.T)
        assert (wrong > off).mean() < 0.06
        errors.append(wrong.mean())
    assert errors[1] < errors[0] / 2


def test_width_and_rotation():
    assert onebit.width(64, 512) == 512 and onebit.width(700, 512) == 704 and onebit.width(3, 8) == 8
    r = onebit.rotation(10, 32, 1)
    assert np.allclose(r.T @ r, np.eye(10))


def test_first_k_takes_ties_in_order():
    s = np.array([[3, 1, 3, 3], [-9, -9, 2, -9]], np.int64)
    i, j = blocks.first_k(s, 2, -9)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 2), (1, 2)]
    i, j = blocks.first_k(np.array([[1.0, 2.0]]), 5, -np.inf)
    assert j.tolist() == [1, 0]


def mined(rows, chosen, low=50, high=95):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for n, (i, label, q) in enumerate(rows):
        if i is None or not chosen(i):
            continue
        order = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), last(j), l == label) for m, (j, l, v) in enumerate(rows) if m != n and len(v) == len(q))
        name = lambda j: None if j[0] else j[1]
        for p, pid, _ in [o for o in order if o[2]][:5]:
            hits = [(s, j) for s, j, same in order if not same and low * -p <= 100 * -s <= high * -p][:3]
            out += [(i, name(pid), r + 1, name(j), -p, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out, key=repr)


def mine(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, v array<long>, positive int").repartition(4)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, **parameters).collect()), key=repr)


def test_hard_negatives(spark):
    """Ties, repeats, nulls, ids over 2^53 and small blocks."""
    rng = np.random.default_rng(5)
    rows = [(BIG + i, int(rng.integers(0, 3)), rng.integers(-3, 6, 5).tolist()) for i in range(200)]
    rows += [(None, 1, [2, 3, 1, 0, 4]), (BIG + 10, 1, rows[10][2]), (30, None, [1] * 5), (40, 1, None), (50, 2, [1, None, 1, 1, 1]), (70, 1, [1, 2]), (71, 1, [1, 2]), (72, 2, [1, 1]), (90, 1, [])]
    want = mined(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert mine(spark, rows) == want
    assert mine(spark, rows, row_block=50, query_block=6) == want
    assert mine(spark, []) == [] and mine(spark, rows[:1]) == []


def test_huge_components(spark):
    """Beyond what floats hold, scores stay exact; beyond a long, components are held to what keeps them within."""
    rows = [(10, 1, [2**30, 3]), (11, 1, [2**30 + 1, 1]), (12, 2, [2**30 - 2**27, 1]), (13, 2, [2**29, 1])]
    assert mine(spark, rows) == mined(rows, lambda i: i == 10)
    assert {r[5] > 0 for r in mine(spark, [(10, 1, [2**62]), (11, 1, [2**62]), (12, 2, [2**30])])} == {True}


def test_keys_sort_as_pairs_do():
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(s), bool(p), None if i < -50 else int(i), int(n)) for a, s, p, i, n in zip(rng.integers(0, 3, 500), rng.integers(-(2**62), 2**62, 500) // rng.choice([1, 2**60], 500), rng.integers(0, 2, 500), rng.integers(-60, 60, 500), range(500), strict=True)]
    want = sorted(pairs, key=lambda x: (x[0], -x[1], not x[2], x[3] is None, x[3] or 0, x[4]))
    assert sorted(pairs, key=lambda x: negatives.pack(*x)) == want
    assert all(negatives.unpack(negatives.pack(*p)) == p[:4] for p in pairs)
