"""Differences of two large sets of digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsync.functions.ids import bit_prefix
from recordsync.operators import buckets
from recordsync.operators.buckets import PRIME
from recordsync.operators.order import numbered
from recordsync.sources.shared import stored


def difference(here: DataFrame, there: DataFrame, digest: str = "hash") -> DataFrame:
    """``(hash, side)``: each element that is only ``here`` or only ``there``."""
    a, b = (x.select(F.col(digest).alias("hash")).distinct() for x in (here, there))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "hash", "full_outer")
    return both.where("_a is null or _b is null").select("hash", F.when(F.col("_b").isNull(), "here").otherwise("there").alias("side"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def relation(a: DataFrame, b: DataFrame, digest: str = "hash") -> DataFrame:
    """One row ``(subset, superset, equal)``: whether all of ``a`` is in ``b``, all of ``b`` in ``a``, and both."""
    sides = difference(a, b, digest).agg(F.count_if(F.col("side") == "here").alias("x"), F.count_if(F.col("side") == "there").alias("y"))
    return sides.select((F.col("x") == 0).alias("subset"), (F.col("y") == 0).alias("superset"), ((F.col("x") == 0) & (F.col("y") == 0)).alias("equal"))


def differing(here: DataFrame, there: DataFrame) -> DataFrame:
    """``(depth, prefix)`` of the buckets whose summaries (count and check) are not the same on both sides."""
    a = here.select("depth", "prefix", F.col("n").alias("na"), F.col("check").alias("ca"))
    b = there.select("depth", "prefix", F.col("n").alias("nb"), F.col("check").alias("cb"))
    return a.join(b, ["depth", "prefix"], "full_outer").where("not (na <=> nb and ca <=> cb)").select("depth", "prefix")


def pruned_difference(here: DataFrame, there: DataFrame, here_summary: DataFrame, there_summary: DataFrame, digest: str = "hash", width: int = 2) -> DataFrame:
    """What :func:`difference` gives, from the elements of differing buckets alone.

    Summaries (see :func:`buckets.digests`) may be kept from earlier runs. Buckets are compared level by level
    from the root, and only those below a differing one are looked at; each level is a join of summaries. The
    number of levels is that of the summaries.
    """
    changed = differing(here_summary, there_summary)
    depths = here_summary.agg(F.max("depth")).first()[0] or 0
    front = changed.where("depth = 0").select("prefix")
    for depth in range(1, depths + 1):
        level = changed.where(F.col("depth") == depth).select("prefix", F.substring("prefix", 1, (depth - 1) * width).alias("_up"))
        front = level.join(front.withColumnRenamed("prefix", "_up"), "_up", "left_semi").select("prefix")
    bits = bit_prefix(F.col(digest), depths * width) if depths else F.lit("")
    a, b = (x.withColumn("prefix", bits).join(front, "prefix", "left_semi") for x in (here, there))
    return difference(a, b, digest)


def actions(here: DataFrame, there: DataFrame, mbar: int = 5, full_factor: int = 30, failed: DataFrame | None = None) -> DataFrame:
    """``(depth, prefix, action)`` for each bucket that differs: send its elements (``full``) where it is small on either side or
    at the last depth, else a ``sketch``; where that has ``failed`` (depth, prefix), ``descend`` into the buckets below.

    Small is under ``full_factor`` times ``mbar`` elements; a bucket that one side lacks counts as 0 there.
    """
    a = here.select("depth", "prefix", F.col("n").alias("na"), F.col("check").alias("ca"))
    b = there.select("depth", "prefix", F.col("n").alias("nb"), F.col("check").alias("cb"))
    both = a.join(b, ["depth", "prefix"], "full_outer").where("not (na <=> nb and ca <=> cb)")
    small = F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))) < full_factor * mbar
    if failed is None:
        return both.select("depth", "prefix", F.when(small, "full").otherwise("sketch").alias("action"))
    # A row: the last depth there is.
    last = here.select("depth").unionByName(there.select("depth")).agg(F.max("depth").alias("_last"))
    both = both.withColumn("_small", small).join(F.broadcast(last)).join(failed.select("depth", "prefix", F.lit(True).alias("_failed")), ["depth", "prefix"], "left")
    action = F.when(F.col("_small") | (F.col("_failed") & (F.col("depth") == F.col("_last"))), "full").when(F.col("_failed"), "descend").otherwise("sketch")
    return both.select("depth", "prefix", action.alias("action"))


def fetch_plan(here: DataFrame, there: DataFrame, size: int = 100, digest: str = "hash") -> DataFrame:
    """``(hash, bundle)``: what is missing here, in bundles of ``size`` by ascending hash."""
    from recordsync.operators.index import bundles

    missing = difference(here, there, digest).where("side = 'there'").select("hash")
    keyed = missing.withColumn("_k", F.conv(F.substring("hash", 1, 12), 16, 10).cast("long"))
    return bundles(keyed, "_k", "hash", size=size).drop("_k")


def peer_plan(here: DataFrame, peers: DataFrame, size: int = 100) -> DataFrame:
    """``(hash, peer, bundle)``: what is missing ``here`` (hash) and held by any of ``peers`` (peer, hash), each hash to be fetched from one holder.

    One aggregation makes a bitmap of holders for each hash. Hashes with the same holders are dealt to them in turn, in order of hash, so
    that their shares differ by one at most; a peer's hashes go in bundles of ``size`` by ascending hash. At most 62 peers.
    """
    names = sorted(r["peer"] for r in peers.select("peer").distinct().limit(63).collect())
    if len(names) > 62:
        raise ValueError("more than 62 peers")
    bit = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i))), F.col("peer")) if names else F.lit(0)
    all_rows = peers.select("hash", bit.cast("long").alias("_bit")).unionByName(here.select("hash", F.lit(1 << 62).alias("_bit")))
    missing = all_rows.groupBy("hash").agg(F.bit_or("_bit").alias("_held")).where(F.col("_held") < 1 << 62)
    dealt = stored(numbered(missing, "_held", "hash", name="_no"), "missing")
    first = dealt.groupBy("_held").agg(F.min("_no").alias("_first"))  # a row for each set of holders
    holders = F.array_compact(F.array(*(F.when(F.col("_held").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)))) if names else F.array(F.lit(""))
    chosen = F.get(holders, ((F.col("_no") - F.col("_first")) % F.size(holders)).cast("int"))
    owned = stored(numbered(dealt.join(first, "_held").select("hash", chosen.alias("peer")), "peer", "hash", name="_no"), "owned")
    start = owned.groupBy("peer").agg(F.min("_no").alias("_first"))
    return owned.join(start, "peer").select("hash", "peer", F.floor((F.col("_no") - F.col("_first")) / size).alias("bundle"))


def catch_up(summary: DataFrame, log: DataFrame, present: DataFrame, depths: int = 4, width: int = 2) -> DataFrame:
    """``summary`` (depth, prefix, n, check) after the events of ``log``, given the elements ``present`` before them."""
    return summed(summary.select("depth", "prefix", "n", "check").unionByName(changes(log, present, depths, width)))


def summed(parts: DataFrame) -> DataFrame:
    """A summary from its parts: counts add up, checks are combined; empty buckets go."""
    return parts.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.bit_xor("check").alias("check")).where("n > 0")


def changes(log: DataFrame, present: DataFrame, depths: int = 4, width: int = 2) -> DataFrame:
    """``(depth, prefix, n, check)``: what the events of ``log`` add to a summary, n negative for what goes.

    Only what changes is told: a hash that is added though present, or deleted though absent, changes nothing.
    """
    from recordsync.operators.changelog import last_events

    last = last_events(log).select("hash", "op")
    added = last.where("op = 'Add'").join(present.select("hash"), "hash", "left_anti").select("hash", F.lit(1).alias("d"))
    gone = last.where("op = 'Delete'").join(present.select("hash"), "hash", "left_semi").select("hash", F.lit(-1).alias("d"))
    return summary_changes(added.unionByName(gone), depths, width)


def summary_changes(signed: DataFrame, depths: int = 4, width: int = 2) -> DataFrame:
    """``(depth, prefix, n, check)``: what elements (hash, d: 1 for one that comes, -1 for one that goes) add to a summary."""
    level = signed.select("d", F.xxhash64("hash").alias("x"), bit_prefix(F.col("hash"), max(1, depths * width)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(depths))).alias("depth"))
    delta = level.select("depth", F.expr(f"substring(b, 1, depth * {width})").alias("prefix"), F.col("d").cast("long").alias("n"), F.col("x").alias("check"))
    return delta.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.bit_xor("check").alias("check"))


def _interpolate(values: list[int], at: list[int], size: int) -> tuple[list[int], list[int]] | None:
    """Monic polynomials p and q, lowest term first, whose ratio takes ``values`` and whose degrees differ by ``size``; None if there are none."""
    m = len(values)
    dp = (m + size) // 2
    dq = dp - size
    if dp < 0 or dq < 0:
        return None
    k = dp + dq
    rows = []
    for v, x in zip(values[:k], at[:k], strict=True):
        powers = [pow(x, i, PRIME) for i in range(max(dp, dq) + 1)]
        rows.append([*powers[:dp], *(-v * p % PRIME for p in powers[:dq]), (v * powers[dq] - powers[dp]) % PRIME])
    solved = _solve(rows, k)
    return None if solved is None else ([*solved[:dp], 1], [*solved[dp:], 1])


def _solve(rows: list[list[int]], k: int) -> list[int] | None:
    """A solution of linear equations modulo PRIME (free unknowns 0), or None."""
    pivots, top = [], 0
    for c in range(k):
        r = next((i for i in range(top, len(rows)) if rows[i][c]), None)
        if r is None:
            continue
        rows[top], rows[r] = rows[r], rows[top]
        inverse = pow(rows[top][c], -1, PRIME)
        rows[top] = [x * inverse % PRIME for x in rows[top]]
        for i in range(len(rows)):
            if i != top and rows[i][c]:
                f = rows[i][c]
                rows[i] = [(x - f * y) % PRIME for x, y in zip(rows[i], rows[top], strict=True)]
        pivots.append(c)
        top += 1
    if any(row[-1] for row in rows[top:]):
        return None
    out = [0] * k
    for i, c in enumerate(pivots):
        out[c] = rows[i][-1]
    return out


def _mod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of polynomials, lowest term first."""
    a, q = list(a), [0] * max(1, len(a) - len(b) + 1)
    inverse = pow(b[-1], -1, PRIME)
    while len(a) >= len(b):
        f = a[-1] * inverse % PRIME
        q[len(a) - len(b)] = f
        for i, y in enumerate(b):
            a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - f * y) % PRIME
        a.pop()
    while a and not a[-1]:
        a.pop()
    return q, a


def _gcd(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, _mod(a, b)[1]
    inverse = pow(a[-1], -1, PRIME)
    return [x * inverse % PRIME for x in a]


def _times(a: list[int], b: list[int], modulus: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1) if a and b else []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] = (out[i + j] + x * y) % PRIME
    while out and not out[-1]:
        out.pop()
    return _mod(out, modulus)[1]


def _power(base: list[int], n: int, modulus: list[int]) -> list[int]:
    out = [1]
    base = _mod(base, modulus)[1]
    while n:
        if n & 1:
            out = _times(out, base, modulus)
        base, n = _times(base, base, modulus), n >> 1
    return out


def _roots(p: list[int], shift: int = 0) -> list[int] | None:
    """The distinct roots of a monic polynomial that has as many as its degree, or None."""
    if len(p) == 1:
        return []
    if len(p) == 2:
        return [-p[0] % PRIME]
    if shift == 0:
        x = _power([0, 1], PRIME, p)
        x = [*x, 0, 0][: max(2, len(x))]
        x[1] = (x[1] - 1) % PRIME
        if any(x):
            return None
    for s in range(shift + 1, shift + 60):
        half = [*_power([s, 1], (PRIME - 1) // 2, p)] or [0]
        half[0] = (half[0] - 1) % PRIME
        while half and not half[-1]:
            half.pop()
        if not half:
            continue
        g = _gcd(p, half)
        if 1 < len(g) < len(p):
            left, right = _roots(g, s), _roots(_mod(p, g)[0][: len(p) - len(g) + 1], s)
            return None if left is None or right is None else left + right
    return None


def solve(mine: list[int], theirs: list[int], n_mine: int, n_theirs: int, at: list[int]) -> tuple[list[int], list[int]] | None:
    """Elements that only one of two sets has, from their samples at the points ``at``; None if there are too many.

    The last sample is kept back to check the answer.
    """
    size = n_mine - n_theirs
    values = [a * pow(b, -1, PRIME) % PRIME for a, b in zip(mine, theirs, strict=True)]
    m = len(at) - 1
    if abs(size) > m:
        return None
    m -= (m + size) % 2
    found = _interpolate(values[:m], at[:m], size)
    if found is None:
        return None
    p, q = found
    common = _gcd(p, q)
    p, q = (_mod(x, common)[0][: len(x) - len(common) + 1] for x in (p, q))
    value = lambda f, x: sum(c * pow(x, i, PRIME) for i, c in enumerate(f)) % PRIME
    if value(p, at[-1]) != values[-1] * value(q, at[-1]) % PRIME:
        return None
    here, there = _roots(p), _roots(q)
    return None if here is None or there is None else (here, there)


def sketch_difference(here: DataFrame, there: DataFrame, m: int, size: int = 16) -> DataFrame:
    """``(prefix, hash, side)`` from two tables of sketches (see :func:`buckets.sketches`), without the elements.

    A bucket that differs in more than ``m`` elements gives one row whose hash is null and whose side is ``too many``.
    size: bytes of a digest. A bucket that one side lacks counts as empty there.
    """
    at = buckets.points(m)

    def run(batches):
        for pdf in batches:
            rows = []
            for prefix, a, b, na, nb in zip(pdf["prefix"], pdf["a"], pdf["b"], pdf["na"], pdf["nb"], strict=True):
                x = [int(v) for v in a] if a is not None else [1] * len(at)
                y = [int(v) for v in b] if b is not None else [1] * len(at)
                got = solve(x, y, int(na), int(nb), at)
                if got is None or any(e >> 8 * size for side in got for e in side):
                    rows.append((prefix, None, "too many"))
                else:
                    rows += [(prefix, e.to_bytes(size, "little").hex().upper(), s) for side, s in zip(got, ("here", "there"), strict=True) for e in side]
            yield pd.DataFrame(rows, columns=["prefix", "hash", "side"])

    a = here.select("prefix", F.col("n").alias("na"), F.col("samples").alias("a"))
    b = there.select("prefix", F.col("n").alias("nb"), F.col("samples").alias("b"))
    both = a.join(b, "prefix", "full_outer").where("not (a <=> b)")
    both = both.select("prefix", "a", "b", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    return both.mapInPandas(run, "prefix string, hash string, side string")


def reconcile(here: DataFrame, there: DataFrame, m: int = 5, depth: int = 3, digest: str = "hash", width: int = 2) -> DataFrame:
    """What :func:`difference` gives: by sketches where a bucket differs little, by its elements where it differs more."""
    found = sketch_difference(buckets.sketches(here, m, depth, digest, width), buckets.sketches(there, m, depth, digest, width), m)
    found = stored(found, "sketches")
    rest = found.where("side = 'too many'").select("prefix")
    bits = bit_prefix(F.col(digest), depth * width) if depth else F.lit("")
    a, b = (x.withColumn("prefix", bits).join(rest, "prefix", "left_semi") for x in (here, there))
    return found.where("side <> 'too many'").select("hash", "side").unionByName(difference(a, b, digest))


def reach(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """``(node, hop)``: the nodes that edges (src, dst) reach from ``start`` (node), with the fewest hops, at most ``hops`` if given.

    Goes on until a step reaches nothing new. Each step's nodes are stored, which cuts the lineage.
    """
    # Repeated edges only repeat rows that a step makes distinct anyway.
    edges = stored(edges.select("src", "dst"), "edges")
    seen = front = stored(start.select("node", F.lit(0).alias("hop")).distinct(), "front")
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
