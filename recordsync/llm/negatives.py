"""Hard negatives by a secondary-sort shuffle.

Scored pairs are packed into keys (anchor, descending score, positives first, id), dealt by anchor and sorted within
partitions. One pass over the sorted keys opens a window below each of an anchor's first positives and gives out the first
negatives that fall into it; it holds the open windows of one anchor and nothing else.

Scores of all rows would be the square of the table, so each block of rows sends on only what can be among the first: the best
positives of each anchor, then, when the anchor's windows are known, the best negatives of each window. This drops no row that counts.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import materialise
from recordsync.llm.blocks import QUERY_BLOCK, ROW_BLOCK, block_join, first_k, matrix, tiles

_NONE = np.iinfo(np.int64).min
_PAIRS = "anchor long, anchor_id long, no long, vec_id long, positive boolean, score long"
#: Anchor, complement of the score, 1 for a negative, 1 for a null id, id, row.
_KEY = struct.Struct(">QQBBQQ")
_SIGN = 1 << 63


def pack(anchor: int, score: int, positive: bool, vec_id: int | None, no: int) -> bytes:
    """A key whose order as bytes is that of anchors, falling scores, positives before negatives, ids (null last) and rows."""
    return _KEY.pack(anchor, _SIGN - 1 - score, not positive, vec_id is None, (vec_id or 0) + _SIGN, no)


def unpack(key: bytes) -> tuple[int, int, bool, int | None]:
    """``(anchor, score, positive, vec_id)`` of a key."""
    anchor, score, negative, null, vec_id, _ = _KEY.unpack(key)
    return anchor, _SIGN - 1 - score, not negative, None if null else vec_id - _SIGN


def open_windows(pairs: Iterator[tuple[bytes, int | None]], n_positives: int, n_negatives: int, low: int, high: int) -> Iterator[tuple]:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from sorted keys with their anchor's id."""
    at, seen, windows = None, 0, []
    for key, anchor_id in pairs:
        anchor, score, positive, vec_id = unpack(key)
        if anchor != at:
            at, seen, windows = anchor, 0, []
        if positive:
            if seen < n_positives:
                windows.append([vec_id, score, 0])
            seen += 1
            continue
        for w in windows:
            if low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], vec_id, w[1], score
        # Scores fall, so a window that is full or lies above takes no more.
        windows = [w for w in windows if w[2] < n_negatives and 100 * score >= low * w[1]]


def _scores(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats where they hold them, else in 64-bit integers."""
    if not q.size or not r.size:
        return np.zeros((len(q), len(r)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(r).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    return q @ r.T


def _found(q: pa.Table, r: pa.Table, i: list[np.ndarray], j: list[np.ndarray], score: list[np.ndarray], positive: bool) -> pa.Table:
    i, j, score = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (i, j, score))
    return pa.table({
        "anchor": q["no"].take(i), "anchor_id": q["vec_id"].take(i), "no": r["no"].take(j), "vec_id": r["vec_id"].take(j),
        "positive": pa.array(np.full(len(i), positive)), "score": pa.array(score),
    })


def _in_order(r: pa.Table) -> pa.Table:
    """Rows by id, nulls last: equal scores then go by place."""
    return r.sort_by([("vec_id", "ascending"), ("no", "ascending")])


def _positives(q: pa.Table, r: pa.Table, k: int) -> pa.Table:
    """The first ``k`` positives in a block of rows, for each anchor of a block."""
    r = _in_order(r)
    x, y = matrix(q["v"], np.int64), matrix(r["v"], np.int64)
    labels, others, own, no = (t[c].to_numpy() for c in ("label", "no") for t in (q, r))
    i, j, got = [], [], []
    for part in tiles(len(x), len(y)):
        s = _scores(x[part], y)
        a, b = first_k(np.where((labels[part, None] == others) & (own[part, None] != no), s, _NONE), k, _NONE)
        i, j, got = [*i, a + part.start], [*j, b], [*got, s[a, b]]
    return _found(q, r, i, j, got, True)


def _negatives(q: pa.Table, r: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The first ``k`` negatives of a block of rows in each window of each anchor."""
    r = _in_order(r)
    x, y = matrix(q["v"], np.int64), matrix(r["v"], np.int64)
    labels, others = q["label"].to_numpy(), r["label"].to_numpy()
    windows = q["windows"].to_pylist()
    most = max(map(len, windows), default=0)
    # The least and greatest score of each window; anchors with fewer windows have empty ones.
    span = np.array([[(-(-low * p // 100), high * p // 100) for p in w] + [(0, -1)] * (most - len(w)) for w in windows], np.int64).reshape(len(windows), most, 2)
    i, j, got = [], [], []
    for part in tiles(len(x), len(y)):
        s = _scores(x[part], y)
        s = np.where(labels[part, None] != others, s, _NONE)
        taken = [np.zeros(0, np.int64)]
        for n in range(most):
            a, b = first_k(np.where((s >= span[part, n, :1]) & (s <= span[part, n, 1:]), s, _NONE), k, _NONE)
            taken.append(a * max(1, len(y)) + b)
        a, b = np.divmod(np.unique(np.concatenate(taken)), max(1, len(y)))
        i, j, got = [*i, a + part.start], [*j, b], [*got, s[a, b]]
    return _found(q, r, i, j, got, False)


def stream(pairs: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives from scored pairs (anchor, anchor_id, no, vec_id, positive, score; scores are longs, of all pairs or of those that can count)."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda p: (pack(p.anchor, p.score, p.positive, p.vec_id, p.no), p.anchor_id))
    dealt = keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    found = dealt.mapPartitions(functools.partial(open_windows, n_positives=n_positives, n_negatives=n_negatives, low=low, high=high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(found, schema, verifySchema=False)


def mine(
    vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, v: array of longs) for which ``anchor`` holds.

    For each of the first ``n_positives`` other rows of an anchor's label, the first ``n_negatives`` rows of other labels whose score, the inner product
    with the anchor, lies between ``low`` and ``high`` percent of the positive's; higher scores first, ties by smaller vec_id, null ids last. Rows with a null
    label or vector take no part, nor do components that are null. Repeated rows are rows of their own, an anchor's copy a positive of it. Vectors meet
    those of their own length only. Components are held to what keeps a score within a long. No rows give no rows; other columns are not looked at.
    """
    size = F.size("v")
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(size, F.lit(1)))).cast("long")
    held = F.transform("v", lambda x: F.greatest(F.least(x, most), -most))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<long>"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", lambda x: x.isNotNull()))
    rows = materialise(rows.select("vec_id", "label", held.alias("v"), size.alias("dim"), "is_anchor").withColumn("no", F.monotonically_increasing_id()))
    anchors, rows = rows.where("is_anchor").drop("is_anchor"), rows.drop("is_anchor")
    best = block_join(anchors, rows, functools.partial(_call, _positives, (n_positives,)), _PAIRS, row_block, query_block)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "no")
    best = materialise(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives).drop("place"))
    windows = best.groupBy(F.col("anchor").alias("no")).agg(F.array_sort(F.collect_set("score")).alias("windows"))
    worst = block_join(anchors.join(windows, "no"), rows, functools.partial(_call, _negatives, (n_negatives, low, high)), _PAIRS, row_block, query_block)
    return stream(best.unionByName(worst), n_positives, n_negatives, low, high)


def _call(scan, arguments: tuple, q: pa.Table, r: pa.Table) -> pa.Table:
    return scan(q, r, *arguments)
