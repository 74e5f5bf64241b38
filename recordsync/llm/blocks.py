"""A stated set of queries against all rows, block by block: each task has one bounded block of either side."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a block.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024
#: Scores made at once in a task: 16 MB of them.
_TILE = 2_000_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))


def block_join(queries: DataFrame, rows: DataFrame, scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """What ``scan`` gives for each block of ``queries`` with each block of ``rows``; both have no (a long) and dim, and only equal dims meet.

    Both are dealt by a hash of no, so blocks have about ``query_block`` and ``row_block`` rows whatever the data; each side is copied once
    for each block of the other.
    """
    n_rows, n_queries = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))
    place = lambda n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Aliases of their own, since both sides may come from one table.
    queries, rows = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (queries, rows))
    left = queries.withColumn("qb", place(n_queries)).withColumn("rb", every(n_rows))
    right = rows.withColumn("rb", place(n_rows)).withColumn("qb", every(n_queries))
    keys = ["dim", "qb", "rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, schema)


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def tiles(n_queries: int, n_rows: int) -> list[slice]:
    """Runs of queries whose scores over all rows of a block are held at once."""
    step = max(1, _TILE // max(1, n_rows))
    return [slice(i, i + step) for i in range(0, n_queries, step)]


def first_k(scores: np.ndarray, k: int, nothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest scores of each row, ties to earlier columns; ``nothing``, the least, is never taken."""
    n = scores.shape[1]
    bar = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), nothing, scores.dtype)
    i, j = np.nonzero((scores >= bar[:, None]) & (scores > nothing))
    got = scores[i, j]
    # The complement of an integer turns its order round without overflow.
    order = np.lexsort((j, ~got if got.dtype.kind == "i" else -got, i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]
