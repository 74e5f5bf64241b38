"""Nearest vectors by inner product through randomly rotated one-bit codes.

A vector x, less the centre c, is turned by a random rotation into more dimensions; the signs of its components are its code. With
the unit vector o along x - c and the code's unit vector s, the inner product of a query q with o is about <s, q> / <s, o>, and it is off by more than
``eps * |q| * sqrt(1 - <s, o>^2) / <s, o> / sqrt(bits - 1)`` only as often as a normal variable is beyond ``eps`` deviations. Kept with a code are
the correction scalars |x - c| and <s, o>.

Codes are scanned in blocks. A first scan finds the vectors of the greatest estimates, whose exact scores set a bar for each query; a second
one finds all whose upper bound reaches the bar. The first scan goes over parts of the rows, each several times as many as those before: of a later part only estimates
that reach the k-th so far are sent on, so their number is that of the queries and parts, not that of the blocks. Only these are joined with the original vectors and ranked again. Equal vectors are one
entry, whose copies are told apart at the end: ties of thousands of copies don't multiply.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import materialise
from recordsync.llm.blocks import QUERY_BLOCK, ROW_BLOCK, block_join, first_k, matrix, tiles, usable

BITS, EPS = 1024, 3.5
#: Of how many rows the first scan's parts are dealt, and how many times as many rows each has with those before it.
_DEAL, STEP = 1 << 30, 8


@functools.lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` x ``dim``: a random rotation of the vectors, padded with zeros to ``bits`` components."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0] if dim else np.zeros((bits, 0))


def width(dim: int, bits: int) -> int:
    """Bits of a code: a multiple of eight, and no fewer than there are components."""
    return -(-max(bits, dim) // 8) * 8


def encode(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes of the rows of ``x``, their lengths, and the inner product of each code with the row's direction."""
    turned = x @ rotation(x.shape[1], bits, seed).T
    size = np.linalg.norm(x, axis=1)
    return np.packbits(turned >= 0, axis=1, bitorder="little"), size, np.abs(turned).sum(axis=1) / np.sqrt(bits) / np.where(size > 0, size, 1)


def bounds(q: np.ndarray, offset: np.ndarray, codes: np.ndarray, size: np.ndarray, dot: np.ndarray, eps: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded rows, and how far off they may be. offset: of each query with the centre."""
    bits = 8 * codes.shape[1]
    signs = np.unpackbits(codes, axis=1, bitorder="little").astype(np.float32) * 2 - 1
    turned = (q @ rotation(q.shape[1], bits, seed).T).astype(np.float32)
    dot = np.where(size > 0, dot, 1)
    scale = size / dot / np.sqrt(bits)
    off = eps * np.linalg.norm(q, axis=1)[:, None] * (size * np.sqrt(np.maximum(0, 1 - dot**2)) / dot / np.sqrt(bits - 1))
    return (turned @ signs.T) * scale + offset[:, None], off


def centres(rows: DataFrame) -> DataFrame:
    """``(dim, centre)``: the mean of the vectors of each length, from sums of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                total = matrix(pa.chunked_array([batch["v"].filter(pa.array(dims == dim))])).sum(axis=0)
                n = int((dims == dim).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, n))], ["dim", "pos", "total", "n"])

    parts = rows.select("dim", "v").mapInArrow(run, "dim int, pos int, total double, n long")
    means = parts.groupBy("dim", "pos").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centre"))


def index(rows: DataFrame, bits: int = BITS, seed: int = 12) -> DataFrame:
    """``(no, dim, code, size, dot, offset)`` of each row (no, dim, v): its code, correction scalars, and its inner product with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch.filter(pa.array(dims == dim))])
                v, centre = matrix(part["v"]), matrix(part["centre"])
                codes, size, dot = encode(v - centre, width(dim, bits), seed)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield from pa.table({"no": part["no"], "dim": part["dim"], "code": packed, "size": size, "dot": dot, "offset": (v * centre).sum(axis=1)}).to_batches()

    return rows.select("no", "dim", "v").join(centres(rows), "dim").select("no", "dim", "v", "centre").mapInArrow(run, "no long, dim int, code binary, size double, dot double, offset double")


def _estimates(q: pa.Table, r: pa.Table, eps: float, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The place of the first query of each tile, its estimates, and how far off they may be."""
    if not len(q) or not len(r):
        return
    codes = np.frombuffer(b"".join(r["code"].to_pylist()), np.uint8).reshape(len(r), -1)
    x, offset, size, dot = matrix(q["v"]), q["offset"].to_numpy(), r["size"].to_numpy(), r["dot"].to_numpy()
    for part in tiles(len(x), len(codes)):
        yield part.start, *bounds(x[part], offset[part], codes, size, dot, eps, seed)


def _pairs(q: pa.Table, r: pa.Table, i: list[np.ndarray], j: list[np.ndarray], score: list[np.ndarray]) -> pa.Table:
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (i, j))
    return pa.table({"query": q["no"].take(i), "no": r["no"].take(j), "estimate": pa.array(np.concatenate([np.zeros(0), *score]).astype(np.float64))})


def _greatest(q: pa.Table, r: pa.Table, k: int, seed: int) -> pa.Table:
    """The ``k`` greatest estimates of each query in a block, of those that reach the query's floor."""
    i, j, got = [], [], []
    for start, estimate, _ in _estimates(q, r, 0, seed):
        a, b = first_k(np.where(estimate >= q["floor"].to_numpy()[start : start + len(estimate), None], estimate, -np.inf), k, -np.inf)
        i, j, got = [*i, a + start], [*j, b], [*got, estimate[a, b]]
    return _pairs(q, r, i, j, got)


def _reaching(q: pa.Table, r: pa.Table, eps: float, seed: int) -> pa.Table:
    """All of a block whose upper bound reaches the query's bar."""
    i, j, got = [], [], []
    for start, estimate, off in _estimates(q, r, eps, seed):
        a, b = np.nonzero(estimate + off >= q["bar"].to_numpy()[start : start + len(estimate), None])
        i, j, got = [*i, a + start], [*j, b], [*got, estimate[a, b]]
    return _pairs(q, r, i, j, got)


def _scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query, no, vec_id, score)``: the inner products of the original vectors, summed from the first component on."""
    both = pairs.select("query", "no").join(rows.select(F.col("no").alias("query"), F.col("v").alias("q")), "query").join(rows.select("no", "vec_id", "v"), "no")
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return both.select("query", "no", "vec_id", score.alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "no")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _parts(rows: DataFrame, size: int) -> list[DataFrame]:
    """``rows`` (no) in parts by a hash: the first has about ``size`` at most, and with each further one there are ``STEP`` times as many."""
    n, ends = rows.count(), [_DEAL]
    while n * ends[0] > size * _DEAL:
        ends.insert(0, -(-ends[0] // STEP))
    place = F.pmod(F.xxhash64("no", F.lit("part")), F.lit(_DEAL))
    return [rows.where((place >= start) & (place < end)) for start, end in zip([0, *ends], ends)]


def candidates(queries: DataFrame, rows: DataFrame, k: int, bits: int = BITS, eps: float = EPS, seed: int = 12, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query, no, vec_id, score)``: rows (no, dim, vec_id, v) among which the ``k`` best of each of ``queries`` (no) are, with exact scores; the query's own row is one of them."""
    coded = materialise(index(rows, bits, seed))
    asked = rows.join(queries.select("no"), "no", "left_semi").select("no", "dim", "v").join(coded.select("no", "offset"), "no")
    codes = coded.select("no", "dim", "code", "size", "dot")
    schema = "query long, no long, estimate double"
    # Among three times as many the k best are near the true ones, so the bar is high.
    order = Window.partitionBy("query").orderBy(F.desc("estimate"), "no")
    first = None
    for part in _parts(codes, row_block):
        if first is None:
            asking = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floors = first.where(F.col("place") == k).select(F.col("query").alias("no"), F.col("estimate").alias("floor"))
            asking = asked.join(floors, "no", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        got = block_join(asking, part, functools.partial(_call, _greatest, (3 * k, seed)), schema, row_block, query_block)
        got = got if first is None else got.unionByName(first.drop("place"))
        first = materialise(got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3 * k))
    # Where fewer than k rows are there, all count.
    bars = _best(_scored(first, rows), k).groupBy(F.col("query").alias("no")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bar"))
    bars = materialise(bars)
    found = block_join(asked.join(bars, "no"), codes, functools.partial(_call, _reaching, (eps, seed)), schema, row_block, query_block)
    return _scored(found, rows)


def _call(scan, arguments: tuple, q: pa.Table, r: pa.Table) -> pa.Table:
    return scan(q, r, *arguments)


def nearest(vectors: DataFrame, query: Column, k: int = 20, **parameters) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` (vec_id, v) of the greatest inner product with each row for which ``query`` holds.

    A row is no neighbour of itself, but a repeat of it is. Ties go to smaller vec_id, null ids last; where fewer rows are there, all are returned.
    Null or zero vectors and those with null or non-finite components take no part; vectors meet those of their own length only. Scores
    are sums of products in double precision, from the first component on. No rows give no rows; other columns are not looked at. See
    :func:`candidates` for ``parameters``: bits of a code, eps of its bounds, seed, and the sizes of blocks.
    """
    all_rows = vectors.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"), F.coalesce(query, F.lit(False)).alias("asked"))
    all_rows = all_rows.where(usable(F.col("v"))).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    all_rows = materialise(all_rows.withColumn("no", F.monotonically_increasing_id()))
    # Equal vectors are one entry, named by its first row.
    entries = all_rows.groupBy("v").agg(F.min_by("no", F.struct(F.col("vec_id").isNull(), "vec_id", "no")).alias("entry"), F.max("asked").alias("asked"), F.count("*").alias("copies"))
    entries = materialise(entries)
    named = all_rows.join(entries.select("v", "entry"), "v").select("no", "vec_id", "entry", "asked")
    # One more than k: a query's own row goes later.
    by_id = Window.partitionBy("entry").orderBy(F.asc_nulls_last("vec_id"), "no")
    first = materialise(named.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).select("entry", "no", "vec_id"))
    rows = entries.join(all_rows.select("no", "vec_id", "dim"), F.col("entry") == F.col("no")).select("no", "vec_id", "dim", "v", "asked")
    rows = materialise(rows)
    best = _best(candidates(rows.where("asked"), rows, k + 1, **parameters), k + 1)
    members = best.select("query", F.col("no").alias("entry"), "score").join(first, "entry").select("query", "no", "vec_id", "score")
    members = _best(members, k + 1).drop("rank")
    asked = named.where("asked").select(F.col("entry").alias("query"), F.col("no").alias("own"), F.col("vec_id").alias("query_id"))
    others = members.join(asked, "query").where("no <> own")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "no"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
