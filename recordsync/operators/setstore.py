"""Stored sets of hex digests with summaries that follow every batch: compared by summary, read only where they differ.

Elements lie in parts by their first hex digits; a summary (see :func:`buckets.digests`, two bits a level) goes down to the parts. Both are
tables of one store, so a batch changes them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsync.functions.ids import bit_prefix
from recordsync.operators import buckets, reconcile, store


def tables(digits: int) -> dict[str, store.Table]:
    return {"elements": store.Table(("hash",), digits, True), "summary": store.Table(("prefix", "depth"), 1)}


def digits_for(rows: DataFrame, per_part: int = 100_000, most: int = 3) -> int:
    """Hex digits such that a part holds about ``per_part`` elements or fewer; 1 to ``most``."""
    n, digits = rows.count(), 1
    while digits < most and n > per_part * 16**digits:
        digits += 1
    return digits


def create(spark: SparkSession, folder: str, rows: DataFrame, digits: int) -> None:
    """Store the distinct digests (hash) of ``rows``, and their summary."""
    elements = rows.select("hash").distinct()
    store.create(spark, folder, tables(digits), {"elements": elements, "summary": buckets.digests(elements, depths=2 * digits)})


def update(spark: SparkSession, folder: str, deletes: DataFrame, adds: DataFrame, digits: int) -> int:
    """Take elements out, then put some in, and return the new version.

    Only the parts of these elements and the buckets above them are read; deletes of what is not there and adds of what is change nothing.
    """
    kinds = tables(digits)
    gone, new = deletes.select("hash").distinct().join(adds, "hash", "left_anti"), adds.select("hash").distinct()
    there = store.look_up(spark, folder, "elements", kinds["elements"], gone.unionByName(new))
    gone, new = gone.join(there, "hash", "left_semi"), new.join(there, "hash", "left_anti")
    signed = gone.withColumn("_d", F.lit(-1)).unionByName(new.withColumn("_d", F.lit(1)))
    moved = _up(signed, 2 * digits).groupBy("depth", "prefix").agg(F.sum("_d").alias("n"), F.bit_xor(F.xxhash64("hash")).alias("check"))
    held = store.look_up(spark, folder, "summary", kinds["summary"], moved).join(moved.select("depth", "prefix"), ["depth", "prefix"], "left_semi")
    after = held.unionByName(moved).groupBy("prefix", "depth").agg(F.sum("n").alias("n"), F.bit_xor("check").alias("check"))
    return store.apply(spark, folder, kinds, {"elements": (gone, new), "summary": (after.where("n = 0"), after.where("n > 0"))})


def _up(rows: DataFrame, depths: int, low: Column | int = 0) -> DataFrame:
    """``rows`` (hash, ...) once for each depth from ``low`` on, with the prefix there."""
    bits = rows.withColumn("_bits", bit_prefix(F.col("hash"), max(1, 2 * depths)))
    low = F.lit(low) if isinstance(low, int) else low
    # From past the last depth on there is none.
    level = F.when(low <= depths, F.sequence(low, F.greatest(low, F.lit(depths))))
    return bits.withColumn("depth", F.explode(level)).withColumn("prefix", F.expr("substring(_bits, 1, depth * 2)")).drop("_bits")


def elements(spark: SparkSession, folder: str, digits: int, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    return store.read(spark, folder, "elements", tables(digits)["elements"], version, parts)


def summary(spark: SparkSession, folder: str, digits: int, version: int | None = None) -> DataFrame:
    return store.read(spark, folder, "summary", tables(digits)["summary"], version)


def parts_of(prefixes: DataFrame, digits: int) -> list[str]:
    """The parts, 16^digits at most, in which buckets (prefix, two bits a level) lie."""
    n = 4 * digits
    low = F.conv(F.rpad(F.left("prefix", F.lit(n)), n, "0"), 2, 10).cast("long")
    high = F.conv(F.rpad(F.left("prefix", F.lit(n)), n, "1"), 2, 10).cast("long")
    names = prefixes.select(F.explode(F.sequence(low, high)).alias("no")).distinct().select(F.lower(F.lpad(F.hex("no"), digits, "0")).alias("part"))
    return sorted(r["part"] for r in names.collect())


def difference(spark: SparkSession, here: str, there: str, digits: int) -> DataFrame:
    """``(hash, side)``: what only one of two stored sets holds.

    Summaries are compared level by level from the root, below differing buckets alone; then only the parts that differ are listed and read.
    """
    changed = reconcile.differing(summary(spark, here, digits), summary(spark, there, digits))
    front = changed.where("depth = 0").select("prefix")
    for depth in range(1, 2 * digits + 1):
        level = changed.where(F.col("depth") == depth).select("prefix", F.substring("prefix", 1, 2 * (depth - 1)).alias("_up"))
        front = level.join(front.withColumnRenamed("prefix", "_up"), "_up", "left_semi").select("prefix")
    parts = parts_of(front, digits)
    return reconcile.difference(elements(spark, here, digits, parts=parts), elements(spark, there, digits, parts=parts))


def updated_leaves(tree: DataFrame, changes: DataFrame, below: DataFrame, threshold: int = 50, depths: int = 4) -> DataFrame:
    """An adaptive tree (depth, prefix, n, is_leaf; see :func:`buckets.leaves`) after ``changes`` (hash, d: 1 for an element that came, -1 for one that went).

    Leaves with more than ``threshold`` elements split, down to ``depths``; a node that has come down to half of it, or less, becomes a leaf
    again. ``below``: the elements (hash) afterwards, of those leaves at least that split (see :func:`splitting`); no others are looked at.
    """
    node, over = _moved(tree, changes, threshold, depths)
    start = over.select(F.col("depth").alias("_low"), F.col("prefix").alias("_leaf"))
    inside = _up(below.select("hash").distinct(), depths).join(start, (F.col("depth") == F.col("_low")) & (F.col("prefix") == F.col("_leaf"))).select("hash", "_low")
    counted = _up(inside, depths, F.col("_low") + 1).groupBy("depth", "prefix", "_low").agg(F.count("*").alias("n"))
    big = counted.where(F.col("n") > threshold).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
    deeper = counted.withColumn("_up", F.expr("substring(prefix, 1, depth * 2 - 2)"))
    new = deeper.where("depth = _low + 1").unionByName(deeper.where("depth > _low + 1").join(big, ["depth", "_up"], "left_semi").select(deeper.columns))
    new = new.select("depth", "prefix", "n", ((F.col("n") <= threshold) | (F.col("depth") == depths)).alias("is_leaf"))
    split = over.select("depth", "prefix", F.lit(True).alias("_split"))
    kept = node.join(split, ["depth", "prefix"], "left").select("depth", "prefix", "n", (F.col("is_leaf") & F.col("_split").isNull()).alias("is_leaf"))
    return kept.unionByName(new)


def splitting(tree: DataFrame, changes: DataFrame, threshold: int = 50, depths: int = 4) -> DataFrame:
    """``(depth, prefix, n)`` of the leaves that ``changes`` make too large."""
    return _moved(tree, changes, threshold, depths)[1]


def _moved(tree: DataFrame, changes: DataFrame, threshold: int, depths: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with their new counts, those that came back together being leaves; and the leaves that are to split."""
    at = ["depth", "prefix"]
    moved = _up(changes.select("hash", "d"), depths).groupBy(*at).agg(F.sum("d").alias("d"))
    node = tree.join(moved, at, "left").withColumn("n", F.col("n") + F.coalesce("d", F.lit(0))).drop("d").where("n > 0")
    # An element may come below an inner node where there was none: a new leaf; or into an empty tree.
    inner = node.where("not is_leaf").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
    fresh = moved.join(tree, at, "left_anti").where("d > 0").withColumn("_up", F.expr("if(depth = 0, '', substring(prefix, 1, depth * 2 - 2))"))
    fresh = fresh.where("depth = 0").unionByName(fresh.join(inner, ["depth", "_up"], "left_semi").select(fresh.columns))
    node = node.unionByName(fresh.select("depth", "prefix", F.col("d").alias("n"), F.lit(True).alias("is_leaf")))
    joined = node.where(~F.col("is_leaf") & (F.col("n") <= threshold / 2)).select(F.col("depth").alias("_d"), F.col("prefix").alias("_p"))
    # Ancestors of each node that is not the root, to see whether one of them is a leaf now.
    above = node.where("depth > 0").select(*at, F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("_d")).withColumn("_p", F.expr("substring(prefix, 1, _d * 2)"))
    gone = above.join(joined, ["_d", "_p"], "left_semi").select(*at).distinct()
    node = node.join(gone, at, "left_anti").withColumn("is_leaf", F.col("is_leaf") | (F.col("n") <= threshold / 2))
    return node, node.where(F.col("is_leaf") & (F.col("n") > threshold) & (F.col("depth") < depths)).select(*at, "n")
