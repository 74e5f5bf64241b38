"""Properties of merging, summaries, reconciliation, order and sinks."""

import functools
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsync.functions.text import escape_field, word_set
from recordsync.operators import buckets as bk
from recordsync.operators import changelog as cl
from recordsync.operators import index, order, sinks
from recordsync.operators import reconcile as rc
from recordsync.operators import records as rec


def digest(i):
    return hashlib.md5(str(i).encode()).hexdigest().upper()


def table(spark, ids):
    return spark.createDataFrame([(digest(i),) for i in ids], "hash string")


@pytest.mark.parametrize("seed", range(3))
def test_all_ways_to_reconcile_agree(spark, seed):
    rng = np.random.default_rng(seed)
    a = set(rng.integers(0, 3000, 600).tolist())
    b = (a - set(rng.choice(sorted(a), 3 + 20 * seed).tolist())) | set(rng.integers(3000, 4000, 2 + 25 * seed).tolist())
    here, there = table(spark, a), table(spark, b)
    want = {(digest(i), "here") for i in a - b} | {(digest(i), "there") for i in b - a}
    rows = lambda df: {(r.hash, r.side) for r in df.collect()}
    assert rows(rc.difference(here, there)) == want
    assert rows(rc.pruned_difference(here, there, bk.digests(here), bk.digests(there))) == want
    assert rows(rc.reconcile(here, there, m=6, depth=2)) == want
    assert rows(rc.reconcile(here, here)) == set()


def test_solver_recovers_up_to_its_bound():
    rng = np.random.default_rng(1)
    for _ in range(25):
        m = int(rng.integers(1, 9))
        n = int(rng.integers(0, m + 1))
        cut = int(rng.integers(0, n + 1))
        values = [int.from_bytes(rng.bytes(16), "little") for _ in range(n + 30)]
        mine, theirs, both = values[:cut], values[cut:n], values[n:]
        at = bk.points(m)
        sketch = lambda els: [functools.reduce(lambda s, e, x=x: s * (x - e) % bk.PRIME, els, 1) for x in at]
        got = rc.solve(sketch(mine + both), sketch(theirs + both), len(mine + both), len(theirs + both), at)
        if (m + cut - (n - cut)) % 2 == 0 or n < m:
            assert got is not None and sorted(got[0]) == sorted(mine) and sorted(got[1]) == sorted(theirs)
        far = [int.from_bytes(rng.bytes(16), "little") for _ in range(2 * m + 3)]
        assert rc.solve(sketch(far + both), sketch(both), len(far + both), len(both), at) is None


def test_sketches_are_products(spark):
    got = {r.prefix: (r.n, [int(x) for x in r.samples]) for r in bk.sketches(table(spark, range(200)).repartition(5), 3, 1).collect()}
    want = {}
    for i in range(200):
        prefix = f"{int(digest(i)[0], 16):04b}"[:2]
        n, s = want.get(prefix, (0, [1] * 4))
        want[prefix] = (n + 1, [v * (x - bk.to_element(digest(i))) % bk.PRIME for v, x in zip(s, bk.points(3), strict=True)])
    assert got == want


def test_counts_add_up(spark):
    c = bk.counts(table(spark, range(1000)))
    assert bk.inconsistent(c).count() == 0 and c.where("depth = 0").first().n == 1000
    assert bk.shape(bk.leaves(c)).first().elements == 1000


def test_merge_is_idempotent_and_order_free(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 8)), i % 40, int(rng.integers(0, 3)), int(rng.integers(0, 9))) for i in range(300)]
    schema = "identity int, record int, parent int, child int"
    once = rec.merge(spark.createDataFrame(rows, schema), "identity", "record", "parent", F.col("child"))
    again = rec.merge(spark.createDataFrame(rows[::-1] + rows, schema), "identity", "record", "parent", F.col("child"))
    both = once.select("identity", "parent", F.explode("children").alias("child")).withColumn("record", F.col("identity"))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(once) == plain(again) == plain(rec.canonical(both, "identity", "parent", F.col("child")))


def test_numbers_and_unique_times(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(t)) for i, t in enumerate(rng.integers(0, 400, 3000))] + [(5000, None)]
    df = spark.createDataFrame(rows, "seq long, v long")
    got = {r.seq: r.no for r in order.numbered(df, "v", "seq").collect()}
    ranked = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {seq: i + 1 for i, (seq, _) in enumerate(ranked)}
    log = df.where("v is not null").select("seq", F.timestamp_micros("v").alias("ts"))
    out = sorted((r.us, r.seq) for r in cl.unique_times(log).select("seq", F.unix_micros("ts").alias("us")).collect())
    last, want = -1, []
    for seq, v in ranked[1:]:
        last = max(v, last + 1)
        want.append((last, seq))
    assert out == want


def test_histogram_edges(spark):
    rows = [(1, "2024-01-01 00:00:00", "Add"), (2, "2024-01-03 00:00:00", "Delete"), (3, "2024-01-04 12:00:00", "Add")]
    log = spark.createDataFrame(rows, "seq long, t string, op string").select("seq", F.to_timestamp("t").alias("ts"), "op", F.col("seq").alias("hash"))
    got = [(r.bin, r.num_adds, r.num_dels) for r in cl.histogram(log, "day").orderBy("bin").collect()]
    assert got == [(0, 1, 0), (1, 0, 0), (2, 0, 1), (3, 0, 0), (4, 1, 0)]
    assert cl.histogram(log.where("false"), "day").count() == 0


def test_words_and_escapes(spark):
    df = spark.createDataFrame([("The thé THE x1",), ("",), (None,), ("100% a:b é",)], "t string")
    assert [r.w for r in df.select(word_set(F.col("t")).alias("w")).collect()] == [["the", "thé", "x1"], [], None, ["100", "a", "b", "é"]]
    assert df.select(word_set(F.col("t"), "latin1_bytes").alias("w")).first().w == ["the", "thã", "x1"]
    assert [r.e for r in df.select(escape_field(F.col("t")).alias("e")).collect()] == ["The th%C3%A9 THE x1", "", None, "100%% a%3Ab %C3%A9"]


def test_search_limits(spark):
    words = spark.createDataFrame([(w, h) for h in range(30) for w in (["a", "b"] if h % 2 else ["a"])], "word string, hash long")
    status = lambda w, **k: tuple(index.search_status(words, w, **k).first())
    assert status(["a", "b"], cap=16) == (15, 15, "ok") and status(["a", "b"], cap=15)[2] == "too many"
    assert status(["a"], rare_cap=30, cap=99)[2] == "ok" and status(["a"], rare_cap=29)[2] == "not specific enough"
    assert status(["a", "zz"]) == (0, 0, "ok") and status([]) == (0, 0, "ok")


def test_versions_and_shards(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda d: spark.createDataFrame(list(d.items()), "hash string, v int")
    assert sinks.apply_versioned(spark, folder, rows({}), rows({"a": 1, "b": 1})) == 1
    assert sinks.apply_versioned(spark, folder, rows({"a": 1}), rows({"b": 2, "c": 2})) == 2
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/v=2").collect())) == [("b", 2), ("c", 2)]
    assert sinks.version_log(spark, folder).count() == 5
    # A crash after the log of a batch and before its table: the batch does not count, and its repeat replaces what is there.
    rec.update_log(rows({"b": 2}), rows({"z": 1}), "hash").write.parquet(f"{folder}-log/version=3")
    assert sinks.current_version(spark, folder) == 2 and sinks.version_log(spark, folder).count() == 5
    assert sinks.apply_versioned(spark, folder, rows({"b": 2}), rows({"d": 1})) == 3
    assert sorted((r.hash, r.op) for r in sinks.version_log(spark, folder).where("version = 3").collect()) == [("b", "Delete"), ("d", "Add")]
    sinks.dump_shards(table(spark, range(25)), str(tmp_path / "dump"), 10)
    shards = spark.read.parquet(str(tmp_path / "dump")).groupBy("shard").agg(F.count("*").alias("n"), F.max("hash").alias("m")).orderBy("shard").collect()
    assert [r.n for r in shards] == [10, 10, 5] and sorted(r.m for r in shards) == [r.m for r in shards]
    assert sinks.manifest(spark, str(tmp_path / "dump")).count() == 3
    totals = sinks.manifest_totals(spark, str(tmp_path / "dump")).first()
    assert (totals.n_files, totals.n_records, totals.n_shards) == (3, 25, 3) and totals.started <= totals.ended
    sinks.diff_log(table(spark, range(9)).withColumn("peer", F.lit("p")), str(tmp_path / "diff"))
    assert spark.read.text(str(tmp_path / "diff" / "peer=p")).count() == 9


def test_clean_skips_what_was_applied(spark):
    rows = [(1, 7, "PUS", [2, 2, 1]), (2, 7, "PUS", [3]), (3, 8, "SP", [1]), (4, 9, "P", [])]
    df = spark.createDataFrame(rows, "record int, identity int, letters string, children array<int>")
    out, marks = sinks.clean(df, [])
    assert sorted((r.record, r.children) for r in out.collect()) == [(1, [1, 2, 3]), (4, [])] and marks == list(sinks.STEPS)
    assert sinks.clean(df, sinks.STEPS)[0].count() == 4
    assert sinks.clean(df, ["canonicalise", "merge"])[0].count() == 3


def plain_cancel(ops):
    """Neighbours with opposite ops cancel, from the first on: the places of what is left."""
    left, i = [], 0
    while i < len(ops):
        if i + 1 < len(ops) and ops[i] != ops[i + 1]:
            i += 2
        else:
            left.append(i)
            i += 1
    return left


def test_neighbours_cancel(spark):
    rng = np.random.default_rng(4)
    cases = [["Add", "Add", "Delete", "Delete"], ["Add", "Delete", "Add"], ["Add", "Delete", "Delete", "Add"], ["Add"]] + [rng.choice(["Add", "Delete"], rng.integers(1, 12)).tolist() for _ in range(60)]
    rows = [(h, i, op) for h, ops in enumerate(cases) for i, op in enumerate(ops)]
    log = spark.createDataFrame(rows, "hash int, seq int, op string").withColumn("ts", F.timestamp_seconds("seq"))
    got = sorted((r.hash, r.seq) for r in cl.cancel_opposites(log).collect())
    assert got == [(h, i) for h, ops in enumerate(cases) for i in plain_cancel(ops)]


@pytest.mark.parametrize("n", [0, 1, 37, 100, 5000])
def test_newest_events(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, int(t)) for i, t in enumerate(rng.integers(0, 9000, 400))]
    log = spark.createDataFrame(rows, "seq int, s long").select("seq", F.timestamp_seconds("s").alias("ts"))
    got = sorted(r.seq for r in cl.newest(log, n).collect())
    assert got == sorted(seq for seq, _ in sorted(rows, key=lambda r: (-r[1], -r[0]))[:n])


def test_digests_frame_their_items(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a"), (2, "b"), (3, "b"), (3, "a")], "record int, item string")
    got = {r.record: r.hash for r in rec.digest(df, "record", F.col("item")).collect()}
    assert got[2] == got[3] != got[1] and got[2] == hashlib.md5(b"1:a1:b").hexdigest().upper()


def test_random_rows_do_not_depend_on_partitions(spark):
    ids = spark.range(300)
    one, two = ({r.id for r in index.random_rows(ids.repartition(n), 50, 7).collect()} for n in (1, 9))
    assert one == two and len(one) == 50 and {r.id for r in index.random_drop(ids, 50, 7).collect()} == set(range(300)) - one


def test_reach_goes_on_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (50, 51)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.hop) for r in rc.reach(edges, start).collect()} == {(i, i) for i in range(13)}
    assert rc.reach(edges, start, 2).count() == 3


def test_index_is_written_and_read(spark, tmp_path):
    words = spark.createDataFrame([(w, h) for h in range(30) for w in (["a", "b"] if h % 2 else ["a"])], "word string, hash long")
    index.write_index({"words": words}, str(tmp_path), 3)
    back = spark.read.parquet(str(tmp_path / "words"))
    assert sorted(r.hash for r in index.match_all(back, ["a", "b"]).collect()) == list(range(1, 30, 2))


def test_audit_of_postings(spark):
    records = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a"])], "hash string, words array<string>")
    words = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "x")], "word string, hash string")
    got = sorted(map(tuple, index.audit_postings(words, records).collect()))
    assert got == [("a", "y", "missing"), ("a", "z", "dangling"), ("b", "x", "missing")]


def test_empty_tables(spark):
    none = table(spark, [])
    assert bk.counts(none).count() == 0 and rc.difference(none, none).count() == 0 and rc.reconcile(none, none).count() == 0
    assert order.numbered(spark.createDataFrame([], "v long"), "v").count() == 0


def test_index_tables_are_sorted_and_distinct(spark, tmp_path):
    """A frequent word is spread over files, and repeated pairs are written once, without a shuffle of their own."""
    words = spark.createDataFrame([("the", i % 2000) for i in range(6000)], "word string, key long")
    index.write_index({"words": words}, str(tmp_path), 4, distinct=("words",))
    back = spark.read.parquet(str(tmp_path / "words"))
    assert back.count() == back.distinct().count() == 2000
    parts = back.groupBy(F.input_file_name()).agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("a").collect()
    assert len(parts) == 4 and all(x.b < y.a for x, y in zip(parts, parts[1:]))


def test_short_keys_tell_digests_apart(spark):
    digests = ["F" * 32, "0" * 32, "0" * 15 + "1" + "0" * 16]
    table = spark.createDataFrame([(d,) for d in digests], "hash string")
    assert {r.k for r in table.select(index.short_keys(table).alias("k")).collect()} == set(digests)
    some = table.where("hash < 'F' or hash = 'none'").limit(1).unionByName(table.where("hash > 'E'"))
    assert {r.k for r in some.select(index.short_keys(some).alias("k")).collect()} == {0, 16**15 - 1}
