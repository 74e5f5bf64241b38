"""Streams over a log that arrives in several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from recordsync.functions.ids import content_element
from recordsync.operators import buckets as bk
from recordsync.operators import changelog as cl
from recordsync.plans.log import log
from recordsync.plans.tables import table
from recordsync.streaming import log as st


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """The log in five files by time, and its schema."""
    d = str(tmp_path_factory.mktemp("log"))
    rows = log(spark, sf)
    n = rows.count()
    for i in range(5):
        low, high = i * n // 5, (i + 1) * n // 5
        cut = rows.withColumn("no", F.expr("row_number() over (order by ts, seq)")).where(f"no > {low} and no <= {high}").drop("no")
        cut.coalesce(1).write.mode("append").parquet(d)
    return d, rows.schema


def stream(spark, files):
    return st.follow(spark, files[0], files[1], files=1)


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_windows(spark, sf, files):
    got = st.last_values(st.collected(st.window_counts(stream(spark, files), "day", "40 days"), "update"), "start").where("num_adds + num_dels > 0")
    want = cl.histogram(log(spark, sf), "day").where("num_adds + num_dels > 0").select(F.col("lower").alias("start"), "num_adds", "num_dels")
    assert plain(got) == plain(want)
    gaps = st.filled(got.where("day(start) % 3 <> 0"), "day")
    assert gaps.where("num_adds + num_dels = 0").count() > 3 and gaps.where("num_adds > 0").count() == got.where("day(start) % 3 <> 0").count()


def test_closed_windows_in_append_mode(spark, sf, files):
    got = st.collected(st.window_counts(stream(spark, files), "day", "1 hour")).drop("batch")
    want = cl.histogram(log(spark, sf), "day").select(F.col("lower").alias("start"), "num_adds", "num_dels")
    assert set(plain(got)) <= set(plain(want)) and got.count() >= 20


def test_presence(spark, sf, files):
    got = st.last_values(st.collected(st.presence(stream(spark, files)), "update"), "hash")
    assert {r.hash for r in got.where("present").collect()} == {r.hash for r in cl.net(log(spark, sf)).collect()}


def test_first_seen(spark, sf, files):
    got = [r.hash for r in st.collected(st.first_seen(stream(spark, files))).collect()]
    assert sorted(got) == sorted(r.hash for r in log(spark, sf).select("hash").distinct().collect())


def test_summary_follows_the_log(spark, sf, files):
    present = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(content_element(F.col("c_custkey").cast("string")).alias("hash"))
    events = stream(spark, files).withColumn("hash", content_element(F.col("hash").cast("string")))
    got = st.tail_summary(events, bk.digests(present), present)
    last = cl.last_events(log(spark, sf).withColumn("hash", content_element(F.col("hash").cast("string"))))
    left = present.join(last.where("op = 'Delete'"), "hash", "left_anti").select("hash").unionByName(last.where("op = 'Add'").select("hash")).distinct()
    assert plain(got) == plain(bk.digests(left).select("depth", "prefix", "n", "check"))


def test_summary_goes_on_where_it_stopped(spark, sf, files, tmp_path):
    """Some files, then the others in a second call, then a batch again as after a crash: the same as all at once."""
    present = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(content_element(F.col("c_custkey").cast("string")).alias("hash"))
    import glob
    import shutil

    (tmp_path / "log").mkdir()
    parts = sorted(glob.glob(f"{files[0]}/part-*"))
    where = {"folder": str(tmp_path / "state"), "checkpoint": str(tmp_path / "checkpoint")}

    def follow():
        events = st.follow(spark, str(tmp_path / "log"), files[1], files=1).withColumn("hash", content_element(F.col("hash").cast("string")))
        return plain(st.tail_summary(events, bk.digests(present), present, **where))

    for some in (parts[:2], parts[2:]):
        for p in some:
            shutil.copy(p, tmp_path / "log")
        got = follow()
    events = stream(spark, files).withColumn("hash", content_element(F.col("hash").cast("string")))
    assert got == follow()
    last = max(int(f.name) for f in (tmp_path / "checkpoint" / "commits").glob("[0-9]*"))
    for f in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        f.unlink()
    assert got == follow()
    by_time = cl.last_events(spark.read.parquet(files[0]).withColumn("hash", content_element(F.col("hash").cast("string"))))
    assert {r.depth for r in st.tail_summary(events, bk.digests(present), present).collect()} == {g[0] for g in got} and by_time.count() > 0


def test_outbox_is_sent_once(spark, tmp_path):
    box, sent = str(tmp_path / "box"), []
    put = lambda rows: spark.createDataFrame(rows, "ts long, hash string").write.mode("append").parquet(box)
    drain = lambda: st.drain(st.follow(spark, box, "ts long, hash string"), lambda df, no: sent.append([r.hash for r in df.collect()]), str(tmp_path / "state"))
    put([(2, "b"), (1, "a")])
    drain()
    put([(3, "c")])
    drain()
    drain()
    assert [x for x in sent if x] == [["a", "b"], ["c"]]
