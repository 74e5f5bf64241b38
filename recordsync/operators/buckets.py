"""Summaries of a set of hex digests by bit prefix: the levels of a prefix tree as a flat table.

A bucket is (depth, prefix); a level has ``width`` bits. The depth is bounded by the digest's first 60 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsync.functions.ids import bit_prefix

#: A prime of 130 bits (2^130 - 5): the field of the sketches.
PRIME = 2**130 - 5


def elements(rows: DataFrame, digest: str = "hash", depths: int = 4, width: int = 2) -> DataFrame:
    """``(hash, depth, prefix)`` of each distinct digest at each depth from 0 to ``depths``."""
    each = rows.select(F.col(digest).alias("hash")).distinct()
    bits = bit_prefix(F.col("hash"), max(1, depths * width))
    level = F.explode(F.sequence(F.lit(0), F.lit(depths))).alias("depth")
    return each.select("hash", bits.alias("_bits"), level).select("hash", "depth", F.expr(f"substring(_bits, 1, depth * {width})").alias("prefix"))


def counts(rows: DataFrame, digest: str = "hash", depths: int = 4, width: int = 2) -> DataFrame:
    """``(depth, prefix, n)``: the number of elements of each bucket at each depth.

    Elements are counted at the deepest level alone; the levels above are sums of those counts, so the
    rows that are expanded are buckets, not elements.
    """
    deepest = rows.select(F.col(digest).alias("hash")).distinct().groupBy(bit_prefix(F.col("hash"), max(1, depths * width)).alias("_bits")).agg(F.count("*").alias("n"))
    level = deepest.select("_bits", "n", F.explode(F.sequence(F.lit(0), F.lit(depths))).alias("depth"))
    return level.groupBy("depth", F.expr(f"substring(_bits, 1, depth * {width})").alias("prefix")).agg(F.sum("n").alias("n"))


def digests(rows: DataFrame, digest: str = "hash", depths: int = 4, width: int = 2) -> DataFrame:
    """``(depth, prefix, n, check)``: counts, and the exclusive or of the elements' 64-bit hashes."""
    keyed = rows.select(F.col(digest).alias("hash")).distinct()
    deepest = keyed.groupBy(bit_prefix(F.col("hash"), max(1, depths * width)).alias("_bits")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hash")).alias("check"))
    level = deepest.select("_bits", "n", "check", F.explode(F.sequence(F.lit(0), F.lit(depths))).alias("depth"))
    return level.groupBy("depth", F.expr(f"substring(_bits, 1, depth * {width})").alias("prefix")).agg(F.sum("n").alias("n"), F.bit_xor("check").alias("check"))


def depth_for(rows: DataFrame, per_bucket: int = 1000, width: int = 2, most: int = 60) -> int:
    """The least depth at which a bucket holds about ``per_bucket`` rows or fewer, for digests that spread evenly; 1 at least."""
    n, depth = rows.count(), 1
    while n > per_bucket << depth * width and (depth + 1) * width <= most:
        depth += 1
    return depth


def leaves(bucket_counts: DataFrame, threshold: int = 50, width: int = 2) -> DataFrame:
    """``(depth, prefix, n, is_leaf)``: the buckets of the adaptive tree.

    A bucket is there if its parent holds more than ``threshold`` elements, and a leaf if it does not itself, or
    is at the last depth.
    """
    last = bucket_counts.agg(F.max("depth").alias("_last"))
    parent = bucket_counts.where(F.col("n") > threshold).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
    up = F.expr(f"substring(prefix, 1, (depth - 1) * {width})")
    split = bucket_counts.where("depth > 0").withColumn("_parent", up).join(parent, ["depth", "_parent"], "left_semi").drop("_parent")
    tree = split.unionByName(bucket_counts.where("depth = 0"))
    leaf = (F.col("n") <= threshold) | (F.col("depth") == F.col("_last"))
    return tree.join(F.broadcast(last)).select("depth", "prefix", "n", leaf.alias("is_leaf"))


def leaf_of(rows: DataFrame, tree: DataFrame, digest: str = "hash", width: int = 2, depths: int = 4) -> DataFrame:
    """``(hash, depth, prefix)``: the leaf that each element is in."""
    return elements(rows, digest, depths, width).join(tree.where("is_leaf").select("depth", "prefix"), ["depth", "prefix"], "left_semi").select("hash", "depth", "prefix")


def shape(tree: DataFrame) -> DataFrame:
    """One row ``(depth, nodes, internal, leaves, elements)``."""
    return tree.agg(
        F.max("depth").alias("depth"), F.count("*").alias("nodes"), F.count_if(~F.col("is_leaf")).alias("internal"),
        F.count_if("is_leaf").alias("leaves"), F.coalesce(F.sum(F.when(F.col("is_leaf"), F.col("n"))), F.lit(0)).alias("elements"),
    )


def fold(tree: DataFrame, leaf: Column, combine: Column, width: int = 2) -> DataFrame:
    """``(depth, prefix, value)``: ``leaf`` is an aggregate over a leaf's row, ``combine`` one over the values of the leaves below.

    For aggregates that combine in any grouping (sums, extremes, exclusive or).
    """
    low = tree.where("is_leaf").groupBy("depth", "prefix").agg(leaf.alias("value"))
    up = low.select(F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("depth"), "prefix", "value")
    return up.groupBy("depth", F.expr(f"substring(prefix, 1, depth * {width})").alias("prefix")).agg(combine.alias("value"))


def set_digest(rows: DataFrame, group: str, item: Column) -> DataFrame:
    """``(group, digest)`` of each group's distinct items.

    Items are dealt to 4,096 parts by the first three hex digits of their MD5. A part's digest is the MD5 of its sorted items, each with
    its length before it; the group's is the MD5 of its parts' digests in order. No task holds a whole group.
    """
    each = rows.select(group, item.alias("_item"), F.left(F.md5(item), F.lit(3)).alias("_part")).distinct()
    framed = F.transform(F.array_sort(F.collect_list("_item")), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))
    parts = each.groupBy(group, "_part").agg(F.md5(F.array_join(framed, "")).alias("_d"))
    return parts.groupBy(group).agg(F.upper(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_d"))), lambda p: p["_d"]), ""))).alias("digest"))


def exact_set_digest(rows: DataFrame, group: str, item: Column) -> DataFrame:
    """``(group, digest)``: the MD5 of each group's distinct items, texts, in order of their bytes, each with its length in four bytes, highest first, before it.

    The digest as it is exchanged between hosts; a group has to fit in a row, so large ones take :func:`set_digest`.
    """
    each = rows.select(group, F.hex(F.encode(item, "UTF-8")).alias("_h")).distinct()
    framed = F.transform(F.array_sort(F.collect_list("_h")), lambda h: F.concat(F.lpad(F.hex((F.length(h) / 2).cast("long")), 8, "0"), h))
    return each.groupBy(group).agg(F.upper(F.md5(F.unhex(F.array_join(framed, "")))).alias("digest"))


def inconsistent(bucket_counts: DataFrame, width: int = 2) -> DataFrame:
    """``(depth, prefix, n, below)``: buckets that do not hold as many elements as the buckets below them."""
    last = bucket_counts.agg(F.max("depth").alias("_last"))
    below = bucket_counts.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.expr(f"substring(prefix, 1, (depth - 1) * {width})").alias("prefix"))
    sums = below.agg(F.sum("n").alias("below"))
    joined = bucket_counts.join(F.broadcast(last)).where("depth < _last").drop("_last").join(sums, ["depth", "prefix"], "full_outer")
    return joined.where("n is null or below is null or n <> below").select("depth", "prefix", "n", "below")


def points(m: int) -> list[int]:
    """The m + 1 points of a sketch: 0, -1, 1, -2, 2, ..."""
    return [(i // 2 if i % 2 == 0 else -(i + 1) // 2) % PRIME for i in range(m + 1)]


def to_element(digest: str) -> int:
    """A hex digest as a number, first byte lowest."""
    return int.from_bytes(bytes.fromhex(digest), "little")


def sketches(rows: DataFrame, m: int, depth: int, digest: str = "hash", width: int = 2) -> DataFrame:
    """``(prefix, n, samples)`` of each bucket at ``depth``: for each of m + 1 points the product of (point - element) modulo PRIME.

    Products of a partition's elements are made first, then those of each bucket: a product can be made in any grouping.
    samples are decimal texts. An element equal to a point is an error.
    """
    at = points(m)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for pdf in batches:
            for prefix, h in zip(pdf["prefix"], pdf["hash"], strict=True):
                e = to_element(h)
                if e in at:
                    raise ValueError(f"element {h} is a point of the sketch")
                cell = held.setdefault(prefix, [0, [1] * len(at)])
                cell[0] += 1
                cell[1] = [s * (x - e) % PRIME for s, x in zip(cell[1], at, strict=True)]
        yield pd.DataFrame([(p, n, [str(x) for x in s]) for p, (n, s) in held.items()], columns=["prefix", "n", "samples"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [1] * len(at)
        for s in pdf["samples"]:
            out = [a * int(b) % PRIME for a, b in zip(out, s, strict=True)]
        return pd.DataFrame({"prefix": [pdf["prefix"].iloc[0]], "n": [int(pdf["n"].sum())], "samples": [[str(x) for x in out]]})

    schema = "prefix string, n long, samples array<string>"
    keyed = rows.select(F.col(digest).alias("hash")).distinct().select("hash", (bit_prefix(F.col("hash"), depth * width) if depth else F.lit("")).alias("prefix"))
    # At most as many rows for a bucket as there are partitions.
    return keyed.mapInPandas(partial, schema).groupBy("prefix").applyInPandas(combine, schema)


def _product(table: DataFrame, m: int) -> DataFrame:
    """``(prefix, n, samples)``: the rows (prefix, n, samples) of each prefix multiplied, those with negative n by their inverses."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [1] * (m + 1)
        for n, samples in zip(pdf["n"], pdf["samples"], strict=True):
            out = [a * pow(int(b), 1 if n > 0 else -1, PRIME) % PRIME for a, b in zip(out, samples, strict=True)]
        return pd.DataFrame({"prefix": [pdf["prefix"].iloc[0]], "n": [int(pdf["n"].sum())], "samples": [[str(x) for x in out]]})

    return table.groupBy("prefix").applyInPandas(run, "prefix string, n long, samples array<string>")


def updated_sketches(held: DataFrame, added: DataFrame, removed: DataFrame, m: int, depth: int, digest: str = "hash", width: int = 2) -> DataFrame:
    """Sketches after elements have been ``added`` to a set and others ``removed``, from what changes alone. Empty buckets go."""
    plus, minus = sketches(added, m, depth, digest, width), sketches(removed, m, depth, digest, width)
    parts = held.select("prefix", "n", "samples").unionByName(plus).unionByName(minus.withColumn("n", -F.col("n")))
    return _product(parts, m).where("n > 0")  # three rows of a bucket at most


def consistent_sketches(upper: DataFrame, lower: DataFrame, m: int = 5, width: int = 2) -> DataFrame:
    """``(prefix, n, consistent)``: whether each bucket's sketch, and its count, is what those of the level below it make."""
    below = _product(lower.withColumn("prefix", F.expr(f"substring(prefix, 1, length(prefix) - {width})")), m)
    same = F.col("u.samples").eqNullSafe(F.col("b.samples")) & F.col("u.n").eqNullSafe(F.col("b.n"))
    return upper.alias("u").join(below.alias("b"), "prefix", "full_outer").select("prefix", F.coalesce("u.n", F.lit(0)).alias("n"), same.alias("consistent"))
