"""Many searches, bucketed tables, peers, exact medians and posting audits against plain loops."""

import math
import os
import random
import uuid
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recordsync.operators import index, reconcile
from recordsync.operators.order import order_statistic
from recordsync.sources import text


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(2)
    records = {f"h{i}": {rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))} for i in range(60)}
    words = spark.createDataFrame([(w, h) for h, ws in records.items() for w in ws for _ in range(1 + (w == "a"))], "word string, hash string")
    asked = {i: [rng.choice("abcdefghz") for _ in range(rng.randrange(1, 4))] for i in range(25)} | {98: [], 99: None}
    searches = spark.createDataFrame(list(asked.items()), "search int, words array<string>")
    status, hits = index.search_many(words, searches, rare_cap=20, cap=9)
    found = defaultdict(set)
    for r in hits.collect():
        found[r.search].add(r.hash)
    got = {r.search: (r.rarest, r.matches, r.status) for r in status.collect()}
    for i, ws in asked.items():
        sizes = [sum(w in x for x in records.values()) for w in ws or []]
        rarest = min(sizes, default=0)
        want = {h for h, x in records.items() if ws and set(ws) <= x}
        state = "not specific enough" if rarest > 20 else "too many" if len(want) >= 9 else "ok"
        assert got[i] == (rarest, None if rarest > 20 else len(want), state), i
        assert found[i] == (want if state == "ok" else set()), i
    one = index.search_status(words, ["a", "b"], 20, 9).first()
    both = index.search_many(words, spark.createDataFrame([(1, ["b", "a", "a"])], "search int, words array<string>"), 20, 9, beyond=True)[0].first()
    assert (one.rarest, one.matches, one.status) == (both.rarest, both.matches, both.status)


def test_bucketed_table_stays_where_it_lies(spark, tmp_path):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("hash"), "id")
    held = index.write_buckets(rows, f"t_{uuid.uuid4().hex}", "hash", str(tmp_path / "t"), 16)
    ask = spark.range(0, 9000, 3).select(F.md5(F.col("id").cast("string")).alias("hash"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = index.multi_get(held, ask)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # The table comes first: nothing is shuffled before its scan, only what is asked, to the table's buckets.
        before = plan[: plan.index("FileScan")]
        assert "Bucketed: true" in plan and "Exchange" not in before and "Exchange hashpartitioning(hash" in plan[len(before) :]
        assert got.count() == len(range(0, 5000, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_ids_many_at_once(spark):
    rows = [("a" * 32 + "01234567", ["b" * 32 + "89ABCDEF"]), ("c" * 32 + "01234567", None), ("d" * 40, [])]
    records = spark.createDataFrame(rows, "fp string, subs array<string>")
    wanted = spark.createDataFrame([("01234567",), ("a" * 8 + "01234567",), ("b" * 32 + "89ABCDEF",), ("x" * 32,), ("f" * 8,), (None,), ("01234567",)], "wanted string")
    got = sorted((r.wanted, r.fp) for r in index.refine_many(records, wanted, "fp", "subs").collect())
    assert got == sorted([("01234567", rows[0][0]), ("01234567", rows[1][0]), ("a" * 8 + "01234567", rows[0][0]), ("b" * 32 + "89ABCDEF", rows[0][0])])


def test_peers_share_what_several_hold(spark):
    rng = random.Random(3)
    holders = {f"{i:032X}": {p for p in "abc" if rng.random() < 0.5} for i in range(400)}
    peers = spark.createDataFrame([(p, h) for h, ps in holders.items() for p in ps for _ in range(1 + (p == "a"))], "peer string, hash string")
    here = {h for h in holders if rng.random() < 0.3}
    got = reconcile.peer_plan(spark.createDataFrame([(h,) for h in here], "hash string"), peers, 10).collect()
    assert {r.hash for r in got} == {h for h, ps in holders.items() if ps} - here and len({r.hash for r in got}) == len(got)
    assert all(r.peer in holders[r.hash] for r in got)
    for ps in {frozenset(p) for p in holders.values() if p}:
        shares = Counter(r.peer for r in got if holders[r.hash] == ps)
        assert max(shares.values()) - min(shares.get(p, 0) for p in ps) <= 1
    for p in "abc":
        mine = sorted((r.hash, r.bundle) for r in got if r.peer == p)
        assert [b for _, b in mine] == [i // 10 for i in range(len(mine))]
    none = spark.createDataFrame([], "peer string, hash string")
    assert reconcile.peer_plan(spark.createDataFrame([("x",)], "hash string"), none).count() == 0


def test_order_statistic(spark):
    """Ties, nulls, neighbours among doubles, huge spans, one value, a null group."""
    rng = random.Random(6)
    groups = {
        "many": [rng.gauss(0, 1) for _ in range(999)], "ties": [1.0] * 50 + [2.0] * 49 + [3.0], "near": [math.nextafter(1.0, 2) if i % 3 else 1.0 for i in range(30)],
        "wide": [-1e300, 1e-300, 1e300, 0.0, 5e-324], "one": [7.0], "none": [None], "some": [None, 4.0, None, 2.0], None: [3.0, 1.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for part in (0.5, 0.0, 0.9, 1.0):
        want = {}
        for g, vs in groups.items():
            vs = sorted(v for v in vs if v is not None)
            if vs:
                want[g] = vs[max(1, math.ceil(len(vs) * part)) - 1]
        assert {r.g: r.v for r in order_statistic(df, "g", "v", part, bins=4).collect()} == want
    assert order_statistic(df.where("false"), "g", "v").count() == 0
    assert order_statistic(spark.range(1001).select(F.lit(1).alias("g"), "id"), "g", "id").first().id == 500


def test_audit_finds_every_wrong_pair(spark):
    rng = random.Random(8)
    records = {f"h{i}": [rng.choice("abcdef") for _ in range(rng.randrange(0, 4))] for i in range(50)}
    right = {(w, h) for h, ws in records.items() for w in ws}
    held = {p for p in right if rng.random() < 0.9} | {("z", "h3"), ("a", "gone")}
    words = spark.createDataFrame([p for p in held for _ in range(1 + (p[0] == "b"))], "word string, hash string")
    table = spark.createDataFrame([*records.items(), ("h1", records["h1"]), ("nul", None)], "hash string, words array<string>")
    got = {(r.word, r.hash, r.problem) for r in index.audit_postings(words, table).collect()}
    assert got == {(*p, "missing") for p in right - held} | {(*p, "dangling") for p in held - right}


def test_crc_of_long_data_equals_byte_by_byte():
    for n in (0, 1, 2047, 2048, 5000, 70_001):
        data, crc = os.urandom(n), text._START
        for byte in data:
            crc ^= byte << 16
            for _ in range(8):
                crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
        assert text.crc24(data) == crc & 0xFFFFFF
