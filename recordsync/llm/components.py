"""Connected components of a large edge table by alternating star contractions, and the links of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns a and b, longs); root is the least node reachable.

    Each round points larger neighbours, then smaller ones, at the least neighbour; the
    number of rounds grows with the logarithm of a component's size. A round's edges are
    written to the shared folder. Loops and repeated edges are harmless; no edges give no rows.
    """
    e = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def linked(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Links ``(a, b)``, a < b, among nodes that share a bucket of ``entries`` (bucket, node): enough of those that
    ``verify`` keeps of pairs (a, b) to connect all that they connect.

    Each bucket's nodes are first compared with its least, as far as :func:`settled` needs it; then those that are not
    connected by then with one another, but for pairs within one component. near: of two aliases of ``entries``, whose further columns it may
    use, the condition that all pairs that ``verify`` keeps fulfil; it is a part of the join, so other pairs are never rows.
    """
    extra = [c for c in entries.columns if c not in ("bucket", "node")]
    least = entries.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").drop("b")
    shared = materialise(entries.join(least, "bucket").select("bucket", "node", "a", *extra).distinct())
    star = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = settled(star, verify)
    roots = materialise(components(links))
    rooted = shared.join(roots, "node", "left").select("bucket", "node", "a", F.coalesce("root", "node").alias("root"), *extra)
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("bucket")
    left = materialise(rooted.join(mixed, "bucket").where("node <> a").select("bucket", "node", "root", *extra))
    x, y = left.alias("x"), left.alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root"))
    more = x.join(y, same & near("x", "y") if near else same)
    more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return materialise(links.unionByName(verify(more)))


def settled(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of ``pairs`` (a, b), a < b, enough of those that ``verify`` keeps to connect all that they connect.

    Each node is first compared with the least of its partners; then the pairs that are not connected by then.
    """
    pairs = materialise(pairs.distinct())
    links = materialise(verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    roots = materialise(components(links))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rooted = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = rooted.where(apart).select("a", "b").join(pairs.groupBy("b").agg(F.min("a").alias("a")), ["a", "b"], "left_anti")
    return materialise(links.unionByName(verify(rest)))
