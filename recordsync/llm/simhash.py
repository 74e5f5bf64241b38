"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments; each segment has a table from its value to fingerprints.
Every fingerprint looks up the small Hamming ball around each of its segments, and the
complete distance decides. Equal fingerprints are one node from the start.

Buckets that hold many different fingerprints (one large group of near copies) would give a
number of pairs that grows with the square of the group. They take another exact way: for bounds of
two bits, fingerprints share a point of their radius-1 balls if and only if they link, so all
that share a point link to the least of them; for larger bounds all are compared with the least one first, and
then only what is not connected yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import bloom_bits, bloom_filter, bloom_holds, free_name, map_frames, materialise, row_key
from recordsync.llm.components import components, linked, settled

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words, repeats included.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space. A text with
    fewer words gives the one hash of all of them; a text with none gives no hash.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(line, SEED)], np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return np.array([h(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One 0/1 for each of ``bits`` positions: 1 where over half of the hashes have a 1.

    Bits past the first 64 come from mixing each hash with the number of its word of 64.
    """
    out = np.zeros(bits, np.uint8)
    if not len(hashes):
        return out
    for k in range(bits // 64):
        x = hashes if k == 0 else hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        if k:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        ones = np.zeros(64, np.int64)
        rows = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(rows), 255):
            ones += rows[i : i + 255].sum(axis=0, dtype=np.uint8)
        out[64 * k : 64 * k + 64] = 2 * ones > len(hashes)
    return out


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64, width: int = 32) -> DataFrame:
    """``(key, doc_id, fp, segments)`` for each document of ``docs`` (doc_id, text).

    fp: the fingerprint as longs of 64 bits; segments: its consecutive runs of ``width`` bits,
    highest first. Bits past the last whole segment belong to none.
    """
    n = bits // width
    powers = (1 << np.arange(width, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, segments = [], []
            for text in pdf["text"]:
                b = majority_bits(shingle_hashes(text, shingle), bits)
                fps.append(np.packbits(b, bitorder="little").view("<i8"))
                segments.append((b[bits - n * width :].reshape(n, width) @ powers)[::-1])
            yield pd.DataFrame({"key": pdf["key"], "doc_id": pdf["doc_id"], "fp": fps, "segments": segments})

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_frames(rows, run, "key long, doc_id long, fp array<long>, segments array<long>")


def _probes(width: int, radius: int) -> F.Column:
    """The values to look up for the segment value ``val``: itself and, for radius 1, its 0 bits set in turn.

    A pair that differs in one bit is found from the side that has the 0.
    """
    own = F.array(F.col("val"))
    if radius == 0:
        return own
    flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
    return F.concat(own, F.transform(F.filter(flips, lambda b: F.col("val").bitwiseAND(b) == 0), lambda b: F.col("val").bitwiseOR(b)))


def links(
    nodes: DataFrame, distance: int, radii: list[int], width: int, heavy: int = 256, verifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """Links ``(a, b)`` among ``nodes`` (node, fp, segments): enough of those at ``distance`` bits or
    fewer to connect all that they connect.

    radii: ball radius (0 or 1) by segment. All such pairs are found if the radii, each plus one,
    add to more than ``distance`` (the pigeonhole bound), else those with a segment within its radius.
    heavy: buckets with more fingerprints take the other exact way; with several words all fingerprints in such a bucket's ball
    do, and no pair with one in it goes the common way. verifier: gets the nodes (node) of all candidates and
    gives a test of pairs that links have to pass as well. Fingerprints of several words are first told apart by their first
    64 bits, at four standard deviations over what the bound lets expect: of pairs at the bound one in 30,000 is lost.
    """
    spark = nodes.sparkSession
    n_words = len(nodes.select("fp").head(1)[0][0]) if nodes.head(1) else 1
    radius = F.element_at(F.array(*map(F.lit, radii)), F.col("seg") + 1)
    check = F.col("fp")[0].alias("chk")
    table = nodes.select("node", check, F.posexplode("segments").alias("seg", "val"))
    full = materialise(table.groupBy("seg", "val").count().where(F.col("count") > heavy).select("seg", "val"))
    some = bool(full.head(1))
    # With one word, those in full buckets look up others as well; else full buckets take in all within their ball.
    owners = table.join(full, ["seg", "val"], "left_anti") if n_words > 1 else table
    probe = owners.select(
        "node", "chk", "seg",
        F.explode(F.when(radius == 1, _probes(width, 1)).otherwise(_probes(width, 0))).alias("val"),
    )
    # With one word it is the whole fingerprint; else it spares most needless look-ups of whole ones.
    share = distance / (64 * n_words)
    bound = distance if n_words == 1 else min(64, math.ceil(64 * share + 4 * math.sqrt(64 * share * (1 - share))))
    p, t = probe.alias("p"), table.join(full, ["seg", "val"], "left_anti").alias("t")
    same = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & (F.col("p.node") != F.col("t.node"))
    pairs = p.join(t, same & (F.bit_count(F.col("p.chk").bitwiseXOR(F.col("t.chk"))) <= bound)).select(
        F.least("p.node", "t.node").alias("a"), F.greatest("p.node", "t.node").alias("b")
    )

    def near(x: str, y: str) -> Column:
        return sum(F.bit_count(F.col(f"{x}.fp")[k].bitwiseXOR(F.col(f"{y}.fp")[k])) for k in range(n_words)) <= distance

    def close(pairs: DataFrame) -> DataFrame:
        fp = nodes.select("node", "fp")
        both = pairs.join(fp.alias("x"), F.col("a") == F.col("x.node")).join(fp.alias("y"), F.col("b") == F.col("y.node"))
        return both.where(near("x", "y")).select("a", "b")

    pairs = pairs.distinct()
    if n_words > 1:
        pairs = materialise(close(pairs))
    if n_words > 1:
        flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
        own = F.array(F.col("val"))
        ball = full.select("seg", F.col("val").alias("centre"), F.explode(F.when(radius == 1, F.concat(own, flips)).otherwise(own)).alias("val"))
        members = table.join(ball, ["seg", "val"]).select("node", "seg", F.col("centre").alias("val"))
    else:
        members = probe.join(full, ["seg", "val"]).select("node", "seg", "val").distinct()
    keep: Callable[[DataFrame], DataFrame] = lambda pairs: pairs
    if verifier:
        there = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        keep = verifier((there.unionByName(members.select("node")) if some else there).distinct())
        pairs = settled(pairs, keep)
    if not some:
        return pairs
    if n_words == 1 and distance == 2:
        ball = F.concat(
            F.array("fp64"),
            F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fp64").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))),
        )
        points = materialise(
            nodes.join(members.select("node").distinct(), "node").select("node", F.col("fp")[0].alias("fp64")).select("node", F.explode(ball).alias("point"))
        )
        least = points.groupBy("point").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
        return pairs.unionByName(points.join(least, "point").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    # A full bucket holds all within its ball.
    entries = members.select(F.xxhash64("seg", "val").alias("bucket"), "node").join(nodes.select("node", "fp"), "node")
    return pairs.unionByName(linked(entries, lambda pairs: keep(close(pairs)), near))


def near_groups(
    docs: DataFrame, shingle: int = 3, bits: int = 64, width: int = 32, distance: int = 2, radii: list[int] | None = None, similarity: float = 0.0
) -> DataFrame:
    """``(key, doc_id, fp, component_id)``: the near-duplicate group of each document of ``docs`` (doc_id, text).

    Fingerprints of ``distance`` bits or fewer apart link; a group is all that links reach.
    component_id is its smallest doc_id. Null ids never win it, and it is null only where the whole
    group has none. With ``similarity``, links also need sets of shingles of that Jaccard similarity. A null text is empty; texts without words have fingerprint zero and link like any
    other. Repeated rows and further columns change nothing; no rows give no rows.
    """
    radii = radii or [1] + [0] * (bits // width - 1)
    rows = materialise(fingerprints(docs, shingle, bits, width))
    node = F.col("fp")[0] if bits == 64 else F.xxhash64("fp")
    rows = rows.withColumn("node", node)
    nodes = materialise(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("segments").alias("segments"), F.min("doc_id").alias("first"), F.min("key").alias("key")))
    verifier = (lambda some: _similar(docs, nodes.join(some, "node").select("node", "key"), shingle, similarity)) if similarity else None
    # Buckets that are well over the number of fingerprints that chance deals to each.
    heavy = 256 if bits == 64 else 8 + 8 * (nodes.count() >> width)
    groups = components(links(nodes, distance, radii, width, heavy, verifier))
    rooted = nodes.select("node", "first").join(groups, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("node", "component_id", "root"), "node").select(
        "key", "doc_id", "fp", "component_id", F.col("root").alias("group_key")
    )


def _similar(docs: DataFrame, some: DataFrame, shingle: int, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """A test of pairs (a, b) of the nodes of ``some`` (node, key): whether their shingle sets are so similar.

    Shingles are taken once, of the documents of ``some`` alone, told apart by 64-bit hashes.
    """
    some = materialise(some)
    bits = bloom_bits(some.select("key"))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_filter(some.select("key"), bits))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[bloom_holds(wanted.value, pdf["key"].to_numpy(np.int64), bits)]
            yield pd.DataFrame({"key": pdf["key"], "grams": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in pdf["text"]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for p, q in zip(pdf["p"], pdf["q"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    taken = docs.select(row_key().alias("key"), F.col("text").cast("string").alias("text")).mapInPandas(take, "key long, grams binary")
    sets = materialise(taken.join(some, "key").dropDuplicates(["node"]).select("node", "grams"))

    def keep(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("p")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("q")), "b")
        return both.select("a", "b", "p", "q").mapInPandas(compare, "a long, b long")

    return keep


def near_bound(bits: int, similarity: float) -> int:
    """Bits that fingerprints of sets of Jaccard ``similarity`` differ by: the mean and two standard deviations."""
    p = bit_change(similarity)
    return round(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def bit_change(similarity: float) -> float:
    """The chance that a bit differs between fingerprints of sets of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def look_up_plan(n: int, similarity: float = 0.8, missed: float = 0.035) -> tuple[int, int, int]:
    """``(bits, width, balls)`` for ``n`` fingerprints: segments as wide as their number has digits, so that chance deals about one to a table's value,
    and so many, each with its ball of radius 1, that a pair at just ``similarity`` misses all of them with that chance.

    Up to 2^20 fingerprints that is 25 segments of 20 bits, 16 with balls; look-ups of a fingerprint then grow with the square of the logarithm of n.
    """
    width = max(20, math.ceil(math.log2(max(2, n))))
    if width == 20:
        return 512, 20, 16
    p = bit_change(similarity)
    found = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    segments = math.ceil(math.log(missed) / math.log(1 - found))
    return 64 * math.ceil(segments * width / 64), width, segments


def deduplicate(docs: DataFrame, shingle: int = 5, bits: int | None = None, width: int = 20, similarity: float = 0.8, balls: int = 16) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the smallest doc_id (nulls last, then by key).

    Two documents link where their sets of ``shingle``-word runs have at least that Jaccard similarity, computed from the whole
    texts, and their fingerprints are near enough to be looked up: in ``bits`` bits they differ by no more than
    two standard deviations over the mean at that similarity, and one of the segments of ``width`` bits is equal or, for
    the first ``balls`` of these, one bit apart. For 0.8, 512 bits and 25 segments a pair at just 0.8 is found with
    probability 0.92, at 0.85 with 0.99; without ``bits``, all three follow the number of documents (see :func:`look_up_plan`). Rows that agree in doc_id and text are one document, and one row of it stays. All
    columns are kept, whatever their names.
    """
    if bits is None:
        bits, width, balls = look_up_plan(docs.count(), similarity)
    n = bits // width
    groups = near_groups(docs, shingle, bits, width, near_bound(bits, similarity), [1] * min(balls, n) + [0] * max(0, n - balls), similarity)
    groups = materialise(groups.select("key", "doc_id", "group_key"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = groups.groupBy("group_key").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    losers = groups.join(best, "group_key").where(F.col("key") != F.col("best.key")).select("key").distinct()
    key = free_name(docs, "near_key")
    keyed = docs.withColumn(key, row_key())
    return keyed.join(losers.withColumnRenamed("key", key), key, "left_anti").dropDuplicates([key]).drop(key)
