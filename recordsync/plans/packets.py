"""Packet jobs over dumps that Spark makes of ``customer``: a key, a user id and a signature for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions.codes import PACKET_TAGS, algorithm_letter, label, signature_type
from recordsync.functions.ids import fingerprint_v3, fingerprint_v4, to_big_endian
from recordsync.operators import records as rec
from recordsync.operators import sinks
from recordsync.plans.registry import query
from recordsync.plans.tables import table
from recordsync.sources import packets as pk
from recordsync.sources import ranges as rg
from recordsync.sources import text
from recordsync.sources.shared import shared_folder

_KEY = "'04' || lpad(to_hex((1000000000 + c_custkey)::bigint), 8, '0') || lpad(to_hex([1, 17, 16, 3][c_custkey % 4 + 1]), 2, '0') || lpad(to_hex(1024 + c_nationkey::int), 4, '0') || 'FF'"
_FP = f"upper(sha1(unhex('990009' || {_KEY})))"


def _key_body():
    alg = F.element_at(F.array(*map(F.lit, (1, 17, 16, 3))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return F.concat(F.lit(b"\x04"), to_big_endian(F.lit(1_000_000_000) + F.col("c_custkey"), 4), to_big_endian(alg, 1), to_big_endian(F.lit(1024) + F.col("c_nationkey"), 2), F.lit(b"\xff"))


def _signature_body():
    """Version 4, a certification by the key itself, valid for some days; every fifth is not by itself."""
    sub = lambda kind, body, size: F.concat(to_big_endian(F.lit(size + 1), 1), to_big_endian(F.lit(kind), 1), body)
    own = F.unhex(F.right(fingerprint_v4(_key_body()), F.lit(16)))
    issuer = F.when(F.col("c_custkey") % 5 == 0, F.lit(b"\x00" * 7 + b"\x01")).otherwise(own)
    hashed = F.concat(sub(2, to_big_endian(F.lit(1_000_000_000) + F.col("c_custkey"), 4), 4), sub(9, to_big_endian(F.col("c_custkey") % 3 * 86_400, 4), 4), sub(25, to_big_endian(F.col("c_custkey") % 2, 1), 1))
    unhashed = sub(16, issuer, 8)
    return F.concat(F.lit(b"\x04"), to_big_endian(F.lit(16) + F.col("c_custkey") % 4, 1), F.lit(b"\x01\x08"), to_big_endian(F.octet_length(hashed), 2), hashed, to_big_endian(F.octet_length(unhashed), 2), unhashed)


def _record():
    item = lambda tag, body: F.struct(F.lit(tag).alias("tag"), F.octet_length(body).alias("length"), body.alias("body"))
    return F.array(item(6, _key_body()), item(13, F.encode("c_name", "UTF-8")), item(2, _signature_body()))


def _records(spark, sf):
    return table(spark, sf, "customer").withColumn("packets", _record())


def dumps(spark, sf):
    """``(path, content)``: files of two hundred records."""
    each = _records(spark, sf).select("c_custkey", F.hex(sinks.packet_bytes(F.col("packets"))).alias("h"))
    files = each.groupBy(F.expr("c_custkey div 200").alias("path")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "h"))).alias("r"))
    return files.select(F.col("path").cast("string").alias("path"), F.unhex(F.array_join(F.transform("r", lambda r: r["h"]), "")).alias("content"))


@query(
    "packet_scan",
    """with r as (select (c_custkey // 200)::varchar as file, (row_number() over (partition by c_custkey // 200 order by c_custkey) - 1) * 3 as seq, c_name from customer)
    select file, (seq + k)::int as seq, [6, 13, 2][k::int + 1] as tag, [9, length(c_name), 33][k::int + 1]::bigint as length from r, range(0, 3) as t(k)""",
)
def packet_scan(spark, sf):
    return pk.parse_packets(dumps(spark, sf)).where("error is null").select("file", "seq", "tag", "length")


_LARGE = """with c as (select c_nationkey, c_custkey, length(c_name) + 3 as u from customer), r as (select *, sum(u + 46) over (partition by c_nationkey order by c_custkey) - u - 46 as pos from c)
    select c_nationkey, (pos + [0, 11, 46][k::int + 1])::bigint as "offset", [6, 2, 13][k::int + 1] as tag, [9, 33, u - 2][k::int + 1]::bigint as length from r, range(0, 3) as t(k)"""


def _large_dumps(spark, sf):
    """A folder with one dump for each nation, written as text: the last byte of a record is the line's end."""
    item = lambda tag, body: F.struct(F.lit(tag).alias("tag"), F.octet_length(body).alias("length"), body.alias("body"))
    record = F.array(item(6, _key_body()), item(2, _signature_body()), item(13, F.encode(F.concat("c_name", F.lit("\n")), "UTF-8")))
    data = sinks.packet_bytes(record)
    each = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.substring(data, F.lit(1), F.octet_length(data) - 1).cast("string").alias("value"))
    folder = shared_folder(spark, "dumps")
    each.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(folder)
    return folder


def _placed(packets):
    nation = F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey")
    return packets.where("error is null").select(nation, "offset", "tag", "length")


@query("packet_ranges", _LARGE)
def packet_ranges(spark, sf):
    """Packets of large dumps, read range by range, with their places."""
    folder = _large_dumps(spark, sf)
    return _placed(rg.read_ranges(spark, folder, rg.packet_ranges(spark, folder, "*.txt", 16_384), "*.txt"))


@query("packet_ranges_resumed", _LARGE)
def packet_ranges_resumed(spark, sf):
    """The same in two goes: each file's first half, then what comes after the place where reading stopped."""
    folder = _large_dumps(spark, sf)
    ranges = rg.packet_ranges(spark, folder, "*.txt", 4096)
    sizes = ranges.groupBy("file").agg(F.max("end").alias("size"))
    first = ranges.join(sizes, "file").where(F.col("end") * 2 <= F.col("size")).drop("size")
    rest = rg.unread(ranges, first.select("file", F.col("end").alias("offset")))
    return _placed(rg.read_ranges(spark, folder, first, "*.txt").unionByName(rg.read_ranges(spark, folder, rest, "*.txt")))


@query("packet_records", "select (c_custkey // 200)::varchar as file, row_number() over (partition by c_custkey // 200 order by c_custkey)::bigint as rec, 'PUS' as letters, true as ok, false as lone from customer")
def packet_records(spark, sf):
    out = pk.records(pk.parse_packets(dumps(spark, sf)))
    letters = pk.grammar_letters(F.col("packets"))
    return out.select("file", F.col("rec").cast("long").alias("rec"), letters.alias("letters"), rec.well_formed(letters, F.lit(4)).alias("ok"), pk.is_lone_revocation(F.col("packets")).alias("lone"))


@query(
    "key_info",
    """select (c_custkey // 200)::varchar as file, 4 as version, make_timestamp((1000000000 + c_custkey) * 1000000) as ctime, [1, 17, 16, 3][c_custkey % 4 + 1] as alg,
        ['R', 'D', 'g', 's'][c_custkey % 4 + 1] as letter, (1024 + c_nationkey)::int as keylen from customer""",
)
def key_info(spark, sf):
    out = pk.key_info(pk.parse_packets(dumps(spark, sf)))
    return out.select("file", "version", "ctime", "alg", algorithm_letter(F.col("alg")).alias("letter"), "keylen")


def _other_keys(spark, sf):
    """Keys and other packets of suppliers: version 3 that expires, two curves, version 4 without an end; a revocation that stands alone for each fifth."""
    n = F.col("s_suppkey")
    when = to_big_endian(F.lit(900_000_000) + n, 4)
    old = F.concat(F.lit(b"\x03"), when, to_big_endian(n % 5, 2), F.lit(b"\x01"), to_big_endian(F.lit(1024) + n % 100, 2), F.lit(b"\xff"))
    small = F.concat(F.lit(b"\x04"), when, F.lit(b"\x13\x08"), F.unhex(F.lit("2A8648CE3D030107")), F.lit(b"\xff"))
    large = F.concat(F.lit(b"\x04"), when, F.lit(b"\x13\x05"), F.unhex(F.lit("2B81040023")), F.lit(b"\xff"))
    plain = F.concat(F.lit(b"\x04"), when, F.lit(b"\x01"), to_big_endian(F.lit(2048) + n % 100, 2), F.lit(b"\xff"))
    body = F.when(n % 4 == 0, old).when(n % 4 == 1, small).when(n % 4 == 2, large).otherwise(plain)
    revoked = F.concat(F.lit(b"\x04"), F.when(n % 2 == 0, F.lit(b"\x20")).otherwise(F.lit(b"\x13")), F.lit(b"\x01\x08\x00\x00\x00\x00"))
    item = lambda tag, data: F.struct(F.lit(tag).alias("tag"), F.octet_length(data).cast("long").alias("length"), data.alias("body"))
    packets = F.when(n % 5 == 0, F.array(item(2, revoked))).otherwise(F.array(item(6, body), item(13, F.encode("s_name", "UTF-8"))))
    return table(spark, sf, "supplier").select(n.cast("string").alias("path"), packets.alias("packets"))


@query(
    "other_key_info",
    """select s_suppkey::varchar as file, case when s_suppkey % 4 = 0 then 3 else 4 end as version, make_timestamp((900000000 + s_suppkey) * 1000000) as ctime,
        case when s_suppkey % 4 = 0 then (s_suppkey % 5)::int else -1 end as days, [1, 19, 19, 1][s_suppkey % 4 + 1] as alg,
        [1024 + s_suppkey % 100, 256, 521, 2048 + s_suppkey % 100][s_suppkey % 4 + 1]::int as keylen from supplier where s_suppkey % 5 <> 0""",
)
def other_key_info(spark, sf):
    """Facts of keys of version 3, with their days (-1 for none), and of curves, read from dumps."""
    files = _other_keys(spark, sf).select("path", sinks.packet_bytes(F.col("packets")).alias("content"))
    return pk.key_info(pk.parse_packets(files)).select("file", "version", "ctime", F.coalesce("expiration_days", F.lit(-1)).alias("days"), "alg", "keylen")


@query("lone_revocations", "select s_suppkey::varchar as file, s_suppkey % 5 = 0 and s_suppkey % 2 = 0 as lone, s_suppkey % 5 <> 0 as ok from supplier")
def lone_revocations(spark, sf):
    """Records that are one revocation alone, and those that follow the grammar."""
    files = _other_keys(spark, sf).select("path", sinks.packet_bytes(F.col("packets")).alias("content"))
    out = pk.records(pk.parse_packets(files))
    return out.select("file", pk.is_lone_revocation(F.col("packets")).alias("lone"), rec.well_formed(pk.grammar_letters(F.col("packets")), F.lit(4)).alias("ok"))


@query("packet_kinds", "select ['User ID Packet', 'Signature Packet', 'Public Key Packet'][k::int] as kind, case k when 2 then (count(*) filter (s_suppkey % 5 = 0)) else (count(*) filter (s_suppkey % 5 <> 0)) end as n from supplier, range(1, 4) as t(k) group by k")
def packet_kinds(spark, sf):
    """How many packets of each kind dumps hold, by name."""
    files = _other_keys(spark, sf).select("path", sinks.packet_bytes(F.col("packets")).alias("content"))
    return pk.parse_packets(files).groupBy(label(F.col("tag"), PACKET_TAGS).alias("kind")).agg(F.count("*").alias("n"))


@query("old_fingerprints", "select s_suppkey, upper(md5(unhex(lpad(to_hex(s_suppkey * 7919), 16, '0') || '010001'))) as fp from supplier")
def old_fingerprints(spark, sf):
    """Fingerprints of version 3 keys: of modulus and exponent."""
    modulus = to_big_endian(F.col("s_suppkey") * 7919, 8)
    return table(spark, sf, "supplier").select("s_suppkey", fingerprint_v3(modulus, F.lit(b"\x01\x00\x01")).alias("fp"))


@query("fingerprints", f"select c_custkey, {_FP} as fp, right({_FP}, 16) as id from customer")
def fingerprints(spark, sf):
    fp = fingerprint_v4(_key_body())
    return table(spark, sf, "customer").select("c_custkey", fp.alias("fp"), F.right(fp, F.lit(16)).alias("id"))


_SIGS = f"""select (c_custkey // 200)::varchar as file, (16 + c_custkey % 4)::int as sigtype, make_timestamp((1000000000 + c_custkey) * 1000000) as ctime,
    nullif(c_custkey % 3 * 86400, 0)::bigint as key_exp_secs, c_custkey % 2 = 1 as is_primary,
    case when c_custkey % 5 = 0 then '0000000000000001' else right({_FP}, 16) end as issuer from customer"""


@query("signatures", _SIGS)
def signatures(spark, sf):
    return pk.signatures(pk.parse_packets(dumps(spark, sf))).select("file", "sigtype", "ctime", "key_exp_secs", "is_primary", "issuer")


def _long_form(spark, sf):
    """Signatures with the id of the key before them and the user id, by file and record."""
    p = pk.parse_packets(dumps(spark, sf)).where("error is null")
    of = pk.assemble(p, "file", ["seq"], F.col("tag") == 6, F.struct("seq", "offset", "tag", "body")).select("file", "rec", F.inline("items"))
    keys = of.where("tag = 6").select("file", "rec", F.right(fingerprint_v4(F.col("body")), F.lit(16)).alias("id"))
    uids = of.where("tag = 13").select("file", "rec", F.decode("body", "UTF-8").alias("uid"))
    sigs = pk.signatures(p).join(of.where("tag = 2").select("file", "offset", "rec"), ["file", "offset"])
    return keys, uids, sigs.join(keys, ["file", "rec"]).join(uids, ["file", "rec"])


@query("self_signatures", f"select count(*) as n, (count(*) filter (is_primary)) as n_primary from ({_SIGS}) where issuer <> '0000000000000001'")
def self_signatures(spark, sf):
    return rec.self_signatures(_long_form(spark, sf)[2]).agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


@query(
    "verbose_listing",
    """select c_name as uid, ['Generic', 'Persona', 'Casual', 'Positive'][c_custkey % 4 + 1] || ' certification of a User ID and Public Key packet' as kind,
        strftime(make_timestamp((1000000000 + c_custkey) * 1000000), '%Y-%m-%d') as created, case when c_custkey % 5 <> 0 then c_name end as signer from customer""",
)
def verbose_listing(spark, sf):
    """A row for each signature: its kind, date and, where just one record has the issuer's id, the signer's name."""
    from recordsync.operators.index import enrich

    keys, uids, sigs = _long_form(spark, sf)
    names = keys.join(uids, ["file", "rec"]).select(F.col("id").alias("signer_id"), F.col("uid").alias("signer"))
    out = enrich(sigs.select("uid", "sigtype", "ctime", "issuer"), "issuer", names, "signer_id", "signer")
    return out.select("uid", signature_type(F.col("sigtype")).alias("kind"), F.date_format("ctime", "yyyy-MM-dd").alias("created"), "signer")


@query("armor_round_trip", "select c_custkey, true as same, null::varchar as error from customer")
def armor_round_trip(spark, sf):
    """Records written as armored text and read back."""
    raw = _records(spark, sf).select(F.col("c_custkey").cast("string").alias("path"), sinks.packet_bytes(F.col("packets")).alias("content"))
    back = text.dearmor(text.armor(raw), "path", "armored").select("path", F.col("content").alias("back"), "error")
    return raw.join(back, "path").select(F.col("path").cast("long").alias("c_custkey"), (F.col("content") == F.col("back")).alias("same"), "error")


@query("first_records", "select (c_custkey // 200)::varchar as file, row_number() over (partition by c_custkey // 200 order by c_custkey)::bigint as rec from customer order by file, rec limit 20")
def first_records(spark, sf):
    """The first twenty records of the dumps."""
    out = pk.records(pk.parse_packets(dumps(spark, sf))).select("file", F.col("rec").cast("long").alias("rec"))
    return out.orderBy("file", "rec").limit(20)


@query(
    "clean_job",
    """select min(l_orderkey) as record, l_orderkey // 2 as identity, count(distinct l_partkey) as n from lineitem where l_orderkey % 10 <> 3 group by 2""",
)
def clean_job(spark, sf):
    """Orders cleaned as records: a tenth breaks the grammar, pairs of orders share an identity."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(F.collect_list("l_partkey").alias("children"))
    letters = F.when(F.col("record") % 10 == 3, "SP").otherwise("PUS")
    rows = lines.select("record", F.expr("record div 2").alias("identity"), letters.alias("letters"), "children")
    return sinks.clean(rows, [])[0].select("record", "identity", F.size("children").cast("long").alias("n"))
