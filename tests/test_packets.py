"""Binary dumps, armored text and the spool, on packets made by hand."""

import hashlib
import random
import shutil
import struct

import pytest
from pyspark.sql import functions as F

from recordsync.functions.ids import fingerprint_v3, fingerprint_v4, pretty_fingerprint
from recordsync.operators import records as rec
from recordsync.operators import sinks, store
from recordsync.sources import packets as pk
from recordsync.sources import ranges as rg
from recordsync.sources import text
from recordsync.streaming import log as st


def old(tag, body):
    kind = 0 if len(body) < 256 else 1 if len(body) < 65536 else 2
    return bytes([0x80 | tag << 2 | kind]) + len(body).to_bytes(1 << kind, "big") + body


def new(tag, body):
    n = len(body)
    size = bytes([n]) if n < 192 else bytes([(n - 192 >> 8) + 192, n - 192 & 255]) if n < 8384 else b"\xff" + n.to_bytes(4, "big")
    return bytes([0xC0 | tag]) + size + body


KEY = b"\x04" + struct.pack(">I", 1_000_000_000) + b"\x01" + struct.pack(">H", 2048) + b"\x00" * 20
KEY3 = b"\x03" + struct.pack(">IHB", 900_000_000, 0, 1) + struct.pack(">H", 1024) + b"\x01" * 10
CURVE = b"\x04" + struct.pack(">I", 5) + b"\x13\x08" + bytes.fromhex("2A8648CE3D030107")


def sub(kind, body):
    return bytes([len(body) + 1, kind]) + body


def signature(sigtype=0x13, hashed=b"", unhashed=b""):
    return bytes([4, sigtype, 1, 8]) + struct.pack(">H", len(hashed)) + hashed + struct.pack(">H", len(unhashed)) + unhashed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dump")
    (d / "0000.pgp").write_bytes(old(13, b"stray") + old(6, KEY) + new(13, b"a" * 300) + old(2, signature()) + new(17, b"x" * 9000) + new(6, KEY3))
    (d / "0001.pgp").write_bytes(old(6, CURVE) + new(13, b"ok") + b"\xcd\xe1" + b"partial")
    (d / "0002.pgp").write_bytes(old(6, KEY) + old(13, b"cut off here")[:6])
    (d / "0003.txt").write_bytes(b"not a dump")
    return str(d)


def test_scan(spark, folder):
    rows = pk.read_packets(spark, folder).orderBy("file", "seq").collect()
    got = [(r.file[-8:-4], r.seq, r.tag, r.length, r.error) for r in rows]
    assert got == [
        ("0000", 0, 13, 5, None), ("0000", 1, 6, 28, None), ("0000", 2, 13, 300, None), ("0000", 3, 2, 8, None), ("0000", 4, 17, 9000, None), ("0000", 5, 6, 20, None),
        ("0001", 0, 6, 15, None), ("0001", 1, 13, 2, None), ("0001", 2, None, None, "partial length"), ("0002", 0, 6, 28, None), ("0002", 1, None, None, "cut off"),
    ]
    assert [r.offset for r in rows[:4]] == [0, 7, 37, 340]


def test_records_and_facts(spark, folder):
    p = pk.read_packets(spark, folder)
    found = pk.records(p).select("file", "rec", pk.grammar_letters(F.col("packets")).alias("l")).orderBy("file", "rec").collect()
    assert [r.l for r in found] == ["U", "PUSA", "P", "PU", "P"]
    info = {(r.version, r.alg, r.keylen, r.expiration_days) for r in pk.key_info(p).collect()}
    assert info == {(4, 1, 2048, None), (3, 1, 1024, None), (4, 19, 256, None)}
    raw = spark.createDataFrame([("f", 0, bytearray(b"\x09bad")), ("f", 9, bytearray(b"\x04"))], "file string, offset long, body binary").withColumn("tag", F.lit(6))
    assert {r.error for r in pk.key_info(raw).collect()} == {"short key"}


def test_signatures(spark):
    own = bytes(range(8))
    body = signature(
        0x10, sub(2, struct.pack(">I", 7)) + sub(2, struct.pack(">I", 8)) + sub(3, b"\0\0\0\0") + sub(9, struct.pack(">I", 60)) + sub(25, b"\x01") + sub(26, b"http://p")
        + sub(20, b"\x80\0\0\0" + struct.pack(">HH", 2, 3) + b"nmval"), sub(16, own) + sub(16, b"short") + sub(12, b"\x80\x01" + b"r" * 20) + sub(28, b"me"),
    )
    v3 = b"\x03\x05\x11" + struct.pack(">I", 99) + own + b"\x01\x02"
    rows = [("f", i, 2, bytearray(b)) for i, b in enumerate([body, v3, signature(), b"\x04", b"\x04\x10\x01\x08\x00\x03\x09zz\x00\x00"])]
    df = spark.createDataFrame(rows, "file string, offset long, tag int, body binary")
    got = {r.offset: r for r in pk.signatures(df).withColumn("ctime", F.unix_seconds("ctime")).collect()}
    assert set(got) == {0, 1, 2}
    a = got[0]
    assert (a.ctime, a.exp_secs, a.key_exp_secs, a.is_primary, a.policy_url, tuple(a.notation), a.signer_uid) == (8, None, 60, True, "http://p", ("nm", "val"), "me")
    assert (a.issuer, a.n_issuers, a.revoker) == (own.hex().upper(), 1, (b"r" * 20).hex().upper())
    assert (got[1].sigtype, got[1].ctime, got[1].issuer) == (0x11, 99, own.hex().upper())
    assert got[2].ctime is None and not got[2].is_primary
    mine = spark.createDataFrame([(16, 1, "A", "A"), (48, 1, "A", "A"), (19, 2, "A", "A"), (19, 1, "B", "A")], "sigtype int, n_issuers int, issuer string, id string")
    assert rec.self_signatures(mine).count() == 1


def test_fingerprints(spark):
    df = spark.createDataFrame([(bytearray(KEY), bytearray(b"n"), bytearray(b"e"))], "b binary, n binary, e binary")
    v4 = hashlib.sha1(b"\x99" + struct.pack(">H", len(KEY)) + KEY).hexdigest().upper()
    v3 = hashlib.md5(b"ne").hexdigest().upper()
    r = df.select(fingerprint_v4(F.col("b")).alias("v4"), fingerprint_v3(F.col("n"), F.col("e")).alias("v3")).select(
        "v4", "v3", pretty_fingerprint(F.col("v4")).alias("p4"), pretty_fingerprint(F.col("v3")).alias("p3")
    ).first()
    assert (r.v4, r.v3) == (v4, v3)
    fours, twos = [v4[i : i + 4] for i in range(0, 40, 4)], [v3[i : i + 2] for i in range(0, 32, 2)]
    assert r.p4 == " ".join(fours[:5]) + "  " + " ".join(fours[5:]) and r.p3 == " ".join(twos[:8]) + "  " + " ".join(twos[8:])


def test_digest_ignores_order_but_not_repeats(spark):
    a, b = (6, KEY), (13, b"uid")
    packets = [[a, b], [b, a], [a, b, b]]
    rows = [([(t, len(x), bytearray(x)) for t, x in p],) for p in packets]
    df = spark.createDataFrame(rows, "packets array<struct<tag:int,length:long,body:binary>>")
    got = [r.h for r in df.select(rec.packet_digest(F.col("packets")).alias("h")).collect()]
    want = hashlib.md5(b"".join(struct.pack(">II", t, len(x)) + x for t, x in sorted([a, b]))).hexdigest().upper()
    assert got[0] == got[1] == want != got[2]


def test_bytes_round_trip(spark):
    bodies = [(6, KEY), (13, b"u" * 300), (17, b"v" * 70000), (2, b"")]
    df = spark.createDataFrame([("p", [(t, len(x), bytearray(x)) for t, x in bodies])], "path string, packets array<struct<tag:int,length:long,body:binary>>")
    back = pk.parse_packets(df.select("path", sinks.packet_bytes(F.col("packets")).alias("content"))).orderBy("seq").collect()
    assert [(r.tag, bytes(r.body)) for r in back] == bodies


def test_armor(spark):
    data = old(6, KEY) + old(13, b"me") + old(2, signature())
    assert text.crc24(b"123456789") == 0x21CF02
    block = spark.createDataFrame([(bytearray(data),)], "content binary")
    good = text.armor(block).first().armored
    assert max(len(line) for line in good.split("\n")[2:-2]) <= 64
    bad = good.replace("\n=", "\n=A", 1)
    texts = [("good", "noise\n" + good), ("two", good + "\n" + good), ("crc", bad), ("none", "text"), ("null", None), ("open", good.split("\n=")[0])]
    out = {r.path: r for r in text.dearmor(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert bytes(out["good"].content) == bytes(out["two"].content) == data
    assert {k: out[k].error is not None for k in out} == {"good": False, "two": False, "crc": True, "none": True, "null": True, "open": True}


def test_spool(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    records = {name: old(6, KEY + bytes([i])) + old(13, name.encode()) + old(2, signature()) for i, name in enumerate("abc")}
    blocks = {k: text.armor(spark.createDataFrame([(bytearray(v),)], "content binary")).first().armored for k, v in records.items()}
    for name, body in (("1.ready", blocks["a"]), ("2.ready", "junk"), ("3.tmp", blocks["b"]), ("4.ready", blocks["a"])):
        (spool / name).write_text(body)
    where = [str(tmp_path / x) for x in ("table", "rejects", "checkpoint")]
    st.ingest_spool(spark, str(spool), *where)
    assert st.stored_records(spark, where[0]).count() == 1 and spark.read.parquet(where[1] + "/batch=*").count() == 1
    for name, body in (("5.ready", blocks["b"]), ("6.ready", blocks["a"])):
        (spool / name).write_text(body)
    st.ingest_spool(spark, str(spool), *where, outbox=str(tmp_path / "outbox"))
    assert st.stored_records(spark, where[0]).count() == 2
    assert spark.read.parquet(str(tmp_path / "outbox/batch=*")).count() == 1
    # A record of a known identity with another user id and signature is merged with what is stored.
    more = old(6, KEY + bytes([1])) + old(13, b"bb") + old(2, signature(0x10)) + old(13, b"b") + old(2, signature())
    (spool / "7.ready").write_text(text.armor(spark.createDataFrame([(bytearray(more),)], "content binary")).first().armored)
    st.ingest_spool(spark, str(spool), *where)
    now = st.stored_records(spark, where[0])
    assert sorted(r.letters for r in now.collect()) == ["PUS", "PUSUS"]


def test_spool_batch_takes_few_jobs(spark, tmp_path):
    """What a batch costs besides its files: most spools are many small batches."""
    spool = tmp_path / "spool"
    spool.mkdir()
    good = [old(6, KEY + bytes([i])) + old(13, b"name") + old(2, signature()) for i in range(3)]
    cut, strange = good[0] + old(13, b"rest")[:-1], old(13, b"no key")
    for i, data in enumerate([*good, cut, strange]):
        (spool / f"{i}.ready").write_text(text.armor(spark.createDataFrame([(bytearray(data),)], "content binary")).first().armored)
    (spool / "5.ready").write_text("junk")
    where = [str(tmp_path / x) for x in ("table", "rejects", "checkpoint")]
    count = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = count()
    st.ingest_spool(spark, str(spool), *where, files=2)
    jobs = count() - before
    assert st.stored_records(spark, where[0]).count() == 3
    assert sorted(r.error for r in spark.read.parquet(where[1] + "/batch=*").collect()) == ["cut off", "malformed", "no header"]
    assert jobs <= 3 * 15, jobs


def test_repeated_batch_loses_nothing(spark, tmp_path):
    """A batch whose end was not noted, as after a crash, is taken in again and gives the same."""
    spool = tmp_path / "spool"
    spool.mkdir()
    where = [str(tmp_path / x) for x in ("table", "rejects", "checkpoint")]
    for i, name in enumerate("ab"):
        data = old(6, KEY + bytes([i])) + old(13, name.encode()) + old(2, signature())
        (spool / f"{i}.ready").write_text(text.armor(spark.createDataFrame([(bytearray(data),)], "content binary")).first().armored)
        st.ingest_spool(spark, str(spool), *where)
    assert st.stored_records(spark, where[0]).count() == 2
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        f.unlink()
    st.ingest_spool(spark, str(spool), *where)
    assert st.stored_records(spark, where[0]).count() == 2 and store.current(spark, where[0]) == 2
    # Nor does one that broke off before the store's own commit.
    shutil.rmtree(f"{where[0]}/commits/v=2")
    assert st.stored_records(spark, where[0]).count() == 1
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        f.unlink()
    st.ingest_spool(spark, str(spool), *where)
    assert st.stored_records(spark, where[0]).count() == 2 and store.current(spark, where[0]) == 2


def test_canonical_form_of_a_long_record(spark):
    """Thousands of packets in one record: each signature goes to the packet before it that is none."""
    packet = lambda tag, body: (tag, len(body), bytearray(body))
    packets = [packet(6, b"key")]
    for i in range(3000):
        packets += [packet(13, b"user %d" % (i % 1000)), packet(2, b"sig %d" % i), packet(2, b"all")]
    df = spark.createDataFrame([("x", packets), ("y", packets[:1])], "identity string, packets array<struct<tag:int,length:bigint,body:binary>>")
    got = {r.identity: [(p.tag, bytes(p.body)) for p in r.packets] for r in rec.merged_packets(df).collect()}
    want = [(6, b"key")]
    for name in sorted(b"user %d" % i for i in range(1000)):
        i = int(name[5:])
        # By tag, length and body.
        want += [(13, name), *((2, b) for b in sorted({b"sig %d" % j for j in (i, i + 1000, i + 2000)} | {b"all"}, key=lambda b: (len(b), b)))]
    assert got["x"] == want and got["y"] == [(6, b"key")]


def test_log_file(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a").write_text("Title\n2024-01-01 00:00:01 Add AA\n2024-01-01 00:00:02 Del AA\nbroken\n")
    (tmp_path / "log" / "b").write_text("2024-01-01 00:00:03 Add BB\n2024-01-01 00:00:04 Add CC\n")
    assert [(r.op, r.hash) for r in text.read_change_log(spark, str(tmp_path / "log")).orderBy("ts").collect()] == [("Add", "AA"), ("Delete", "AA"), ("Add", "CC")]


def test_grammar_by_rows(spark):
    """Random letters against the pattern, keys included; a null letter fits nowhere."""
    import random
    import re

    rng = random.Random(5)
    records = {i: ("P" if rng.random() < 0.8 else "") + "".join(rng.choice("SSSUUAKKX" if rng.random() < 0.1 else "SU") for _ in range(rng.randrange(0, 6))) + "".join(rng.choice("SK") for _ in range(rng.randrange(0, 4))) for i in range(300)}
    records = {i: s for i, s in records.items() if s} | {900: "P", 901: "PKU", 902: "PP", 903: "S"}
    rows = spark.createDataFrame([(i, n, c) for i, s in records.items() for n, c in enumerate(s)] + [(950, 0, "P"), (950, 1, None)], "r int, seq int, letter string")
    got = {x.r: (x.v4, x.v3, x.n_after) for x in rec.grammar(rows, "r", ["seq"]).collect()}
    for i, s in records.items():
        prefix = re.match("(PS*([UA]S*)*(KS*)*)?", s).group()
        assert got[i] == (prefix == s, bool(re.fullmatch("PS*([UA]S*)*", s)), len(s) - len(prefix)), s
    assert got[950] == (False, False, 1)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """One file of packets of all lengths, one that is cut off, one with a bad header, and one without a last line end."""
    d, rng = tmp_path_factory.mktemp("large"), random.Random(5)
    sizes = [*(rng.choice((0, 1, 30, 190, 200, 300, 9000)) for _ in range(1500)), 70_000, 130_000, 3]
    some = [(old if rng.random() < 0.5 else new)(rng.choice((2, 6, 13, 14)), rng.randbytes(n)) for n in sizes]
    (d / "0.pgp").write_bytes(b"".join(some) + old(13, b"end\n"))
    (d / "1.pgp").write_bytes(b"".join(some[:300])[:-1])
    (d / "2.pgp").write_bytes(b"".join(some[300:600]) + b"\n" + b"".join(some[:5]))
    (d / "3.pgp").write_bytes(b"".join(some[-60:]) + old(13, b"end"))
    (d / "4.pgp").write_bytes(b"\n" * 40 + some[0])
    (d / "5.pgp").write_bytes(b"")
    (d / "6.pgp").write_bytes(new(13, b"\n" * 5000) + b"\xc6")
    return str(d)


def packet_rows(df):
    return sorted((r.file[-5], r.offset if r.offset is not None else -1, r.seq, r.tag, r.length, r.body, r.error) for r in df.collect())


@pytest.mark.parametrize(("split", "size", "block"), [(20_000, 3000, 4096), (300_000, 50_000, 7000), (1 << 27, 1 << 23, 1 << 23)])
def test_ranges_read_what_whole_files_hold(spark, large, split, size, block):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(split))
    try:
        ranges = rg.packet_ranges(spark, large, size=size)
        assert spark.conf.get(name) == str(split)
        got = packet_rows(rg.read_ranges(spark, large, ranges, block=block))
    finally:
        spark.conf.set(name, before)
    assert got == packet_rows(pk.read_packets(spark, large))
    if size == 3000:
        assert ranges.where("file like '%0.pgp'").count() > 100


def test_reading_goes_on_after_a_range(spark, large):
    ranges = rg.packet_ranges(spark, large, size=40_000)
    every = packet_rows(rg.read_ranges(spark, large, ranges))
    half = ranges.where("error is null and seq < 700")
    done = half.selectExpr("file", "end as offset")
    first, rest = (packet_rows(rg.read_ranges(spark, large, r)) for r in (half, rg.unread(ranges, done)))
    assert first and rest and sorted(first + rest) == every


def test_ranges_of_no_files(spark, tmp_path):
    (tmp_path / "a.pgp").write_bytes(b"")
    ranges = rg.packet_ranges(spark, str(tmp_path))
    assert ranges.count() == 0 and rg.read_ranges(spark, str(tmp_path), ranges).count() == 0
