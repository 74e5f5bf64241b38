"""Listings over the shared tables: customers and orders as keys, user ids and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.operators import buckets as bk
from recordsync.operators import index, listing
from recordsync.operators import records as rec
from recordsync.plans.packets import _FP, _KEY, _key_body, _records
from recordsync.plans.registry import query
from recordsync.plans.sets import _docs
from recordsync.plans.tables import table


@query(
    "presented_parts",
    """select l_orderkey as record, l_partkey as component, count(*) as n from lineitem join orders on o_orderkey = l_orderkey
    where o_orderstatus <> 'P' and l_returnflag <> 'R' and l_partkey % 10 <> 0 group by all""",
)
def presented_parts(spark, sf):
    """Orders as records, parts as user ids (odd) and subkeys (even), lines as signatures: what is left of them to show."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("component"), (F.col("l_returnflag") != "R").alias("good"))
    kind = F.when(F.col("component") % 2 == 0, "subkey").otherwise("uid")
    parts = lines.select("record", "component").distinct().withColumn("kind", kind).withColumn("good", F.col("component") % 10 != 0)
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), (F.col("o_orderstatus") != "P").alias("good"))
    return listing.presented(keys, parts, lines)[1].groupBy("record", "component").agg(F.count("*").alias("n"))


_PRIMARY = "o_orderpriority in ('1-URGENT', '2-HIGH')"


def _uids(spark, sf):
    primary = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    name = F.concat("o_orderpriority", F.lit(" "), F.repeat(F.col("o_orderkey").cast("string"), F.lit(1) + (F.col("o_orderkey") % 300).cast("int")))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("pos"), name.alias("uid"), primary.alias("is_primary"), F.col("o_orderdate").alias("time"))


@query(
    "index_lines",
    f"""with u as (select o_custkey as record, row_number() over (partition by o_custkey order by {_PRIMARY} desc, case when {_PRIMARY} then o_orderdate end desc nulls last, o_orderkey) as no,
        o_orderpriority || ' ' || repeat(o_orderkey::varchar, (1 + o_orderkey % 300)::int) as uid from orders),
    r as (select o_custkey from orders group by 1 having bool_or(o_orderstatus = 'P'))
    select c_custkey as record, 0::bigint as no, 'pub  ' || lpad((1024 + c_nationkey)::varchar, 4, ' ') || ['R', 'D', 'g', 's'][c_custkey % 4 + 1] || '/' || right({_FP}, 8) || ' '
        || strftime(make_timestamp((1000000000 + c_custkey) * 1000000), '%Y-%m-%d') || case when c_custkey in (select o_custkey from r) then ' *** KEY REVOKED ***' else '' end as line from customer
    union all select record, no, case when octet_length(encode(uid)) > 1024 then '[' || octet_length(encode(uid)) || ' bytes]' else uid end from u""",
)
def index_lines(spark, sf):
    """The index listing: a line for each key, its user ids below it, primary ones first."""
    revoked = rec.revoked(table(spark, sf, "orders"), "o_custkey", ["P"], "o_orderstatus").select(F.col("o_custkey").alias("record"), "revoked")
    alg = F.element_at(F.array(*map(F.lit, (1, 17, 16, 3))), (F.col("record") % 4 + 1).cast("int"))
    keys = _records(spark, sf).select(
        F.col("c_custkey").alias("record"), (F.lit(1024) + F.col("c_nationkey")).alias("keylen"), F.right(index.packet_id(_key_body()), F.lit(16)).alias("id"),
        F.timestamp_seconds(F.lit(1_000_000_000) + F.col("c_custkey")).alias("ctime"),
    ).withColumn("alg", alg).join(revoked, "record", "left").fillna(False, ["revoked"])
    return listing.index_lines(keys, _uids(spark, sf))


@query(
    "signature_lines",
    """with s as (select o_custkey as record, o_orderkey as pos, case o_orderkey % 9 when 7 then 32 when 6 then 24 when 5 then 31 when 4 then 50 else 16 + o_orderkey % 4 end as t,
        right(upper(md5(o_custkey::varchar)), 8) as id, o_orderdate as ctime, case when o_orderkey % 3 > 0 then o_orderdate + to_days((o_orderkey % 3 * 200)::int) end as ends, * from orders),
    l as (select record, pos, [
        'sig ' || rpad(case when t between 16 and 19 then case when coalesce(ends < timestamp '1996-01-01', false) then 'exp' else 'sig' end || case when t = 16 then '' else (t - 16)::varchar end
            when t = 32 then 'revok' when t = 31 then 'dirct' when t = 24 then 'sbind' else '0x32' end, 6, ' ') || ' ' || case when o_orderkey % 7 = 0 then 'no keyid' else id end
            || ' ' || strftime(ctime, '%Y-%m-%d') || ' ' || coalesce(strftime(ends, '%Y-%m-%d'), '__________') || ' ' || case when o_orderkey % 2 = 1 then strftime(ctime + to_days(1), '%Y-%m-%d') else '__________' end
            || ' ' || case when o_orderkey % 11 = 0 then 'named' when o_orderkey % 7 = 0 then '[]' when o_orderkey % 5 = 0 then '[selfsig]' else 'signer ' || o_custkey end,
        case when o_orderkey % 13 = 0 then '    Policy URL: http://p/' || o_orderkey end, case when o_orderkey % 17 = 0 then '    Notation data: n v' end,
        case when o_orderkey % 19 = 0 then '    Revocation key fingerprint: ' || upper(sha1(o_custkey::varchar)) end] as lines from s)
    select record, pos, i - 1 as no, line from (select record, pos, [x for x in lines if x is not null] as lines from l), unnest(lines) with ordinality as t(line, i)""",
)
def signature_lines(spark, sf):
    """The detailed listing, orders as signatures."""
    k, day = F.col("o_orderkey"), 86_400
    own = F.right(F.upper(F.md5(F.col("o_custkey").cast("string"))), F.lit(16))
    issuer = F.when(k % 7 != 0, own)
    kind = F.when(k % 9 == 7, 32).when(k % 9 == 6, 24).when(k % 9 == 5, 31).when(k % 9 == 4, 50).otherwise(16 + k % 4)
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("record"), k.alias("pos"), kind.alias("sigtype"), issuer.alias("issuer"), F.when(k % 5 == 0, own).otherwise("other").alias("self_id"),
        F.when(k % 7 != 0, F.concat(F.lit("signer "), F.col("o_custkey").cast("string"))).alias("signer"), F.when(k % 11 == 0, "named").alias("signer_uid"),
        F.col("o_orderdate").alias("ctime"), (k % 3 * 200 * day).alias("exp_secs"), F.col("o_orderdate").alias("key_ctime"), F.when(k % 2 == 1, day).alias("key_exp_secs"),
        F.when(k % 13 == 0, F.concat(F.lit("http://p/"), k.cast("string"))).alias("policy_url"), F.when(k % 17 == 0, F.struct(F.lit("n").alias("name"), F.lit("v").alias("value"))).alias("notation"),
        F.when(k % 19 == 0, F.upper(F.sha1(F.col("o_custkey").cast("string")))).alias("revoker"),
    )
    return listing.signature_lines(rows, F.expr("timestamp '1996-01-01 00:00:00'"))


_CTIME = "lpad(to_hex((1000000000 + c_custkey)::bigint), 8, '0')"
_SIG = f"""'04' || lpad(to_hex(16 + c_custkey % 4), 2, '0') || '0108' || '000F' || '0502' || {_CTIME} || '0509' || lpad(to_hex(c_custkey % 3 * 86400), 8, '0') || '0219' || lpad(to_hex(c_custkey % 2), 2, '0')
    || '000A' || '0910' || case when c_custkey % 5 = 0 then '0000000000000001' else right({_FP}, 16) end"""
_DIGEST = f"upper(md5(unhex('00000002' || '00000021' || {_SIG} || '00000006' || '00000009' || {_KEY} || '0000000D' || lpad(to_hex(octet_length(encode(c_name))), 8, '0') || hex(encode(c_name)))))"


@query("packet_digest", f"select c_custkey, {_DIGEST} as hash from customer")
def packet_digest(spark, sf):
    """Content digest of each record."""
    return _records(spark, sf).select("c_custkey", rec.packet_digest(F.col("packets")).alias("hash"))


@query(
    "packet_metadata",
    f"""select {_DIGEST} as hash, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9À-ÿ]+'))), ' ') as words, right({_FP}, 8) as id, 0::bigint as n_subs,
        make_timestamp((1000000000 + c_custkey) * 1000000) as ctime from customer""",
)
def packet_metadata(spark, sf):
    """What every index is made from, of records of packets."""
    out = index.packet_metadata(_records(spark, sf).select("packets"))
    return out.select("hash", F.array_join("words", " ").alias("words"), "id", F.size("sub_ids").cast("long").alias("n_subs"), "ctime")


@query(
    "long_id_get",
    """with w as (select upper(sha1(p_partkey::varchar)) as fp from part where p_partkey % 100 = 0)
    select fp as wanted, p_partkey from w join part on upper(sha1(p_partkey::varchar)) = fp union select fp, p_partkey from w join part on upper(sha1((p_partkey + 1)::varchar)) = fp""",
)
def long_id_get(spark, sf):
    """Long ids of all parts whose key is divisible by 100: a probe by short id, among own and next parts' ids, then the whole one decides."""
    digest = lambda c: F.upper(F.sha1(c.cast("string")))
    parts = table(spark, sf, "part").select("p_partkey", digest(F.col("p_partkey")).alias("fp"), F.array(digest(F.col("p_partkey") + 1)).alias("sub_fps"))
    wanted = parts.where("p_partkey % 100 = 0").select(F.right("fp", F.lit(16)).alias("wanted"))
    found = index.refine_many(parts, wanted, "fp", "sub_fps")
    whole = parts.where("p_partkey % 100 = 0").select(F.right("fp", F.lit(16)).alias("wanted"), F.col("fp").alias("whole"))
    return found.join(whole, "wanted").select(F.col("whole").alias("wanted"), "p_partkey")


@query("long_id_refine", "select p_partkey from part where upper(sha1(p_partkey::varchar)) = upper(sha1('7')) or upper(sha1((p_partkey + 1)::varchar)) = upper(sha1('7'))")
def long_id_refine(spark, sf):
    """Parts whose own fingerprint, or that of the next part as a subkey, is a wanted one."""
    digest = lambda c: F.upper(F.sha1(c.cast("string")))
    parts = table(spark, sf, "part").select("p_partkey", digest(F.col("p_partkey")).alias("fp"), F.array(digest(F.col("p_partkey") + 1)).alias("sub_fps"))
    wanted = spark.range(1).select(digest(F.lit(7)).alias("w")).first()["w"]
    return index.refine_text(parts, wanted, "fp", "sub_fps").select("p_partkey")


@query(
    "report_attributes",
    """select c_custkey as record, 0::bigint as no, 'pub:' || c_custkey as line from customer
    union all select o_custkey, row_number() over (partition by o_custkey order by o_orderkey), case when o_orderkey % 6 = 0 then 'uat::::' else 'uid:' || o_orderkey end from orders""",
)
def report_attributes(spark, sf):
    """Machine-readable report in which every sixth user id is an attribute."""
    from pyspark.sql import Window

    info = table(spark, sf, "customer").select(F.col("c_custkey").alias("record"), F.array(F.col("c_custkey").cast("string")).alias("fields"))
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    uids = table(spark, sf, "orders").select(F.col("o_custkey").alias("record"), pos.alias("pos"), "o_orderkey")
    attributes = uids.where("o_orderkey % 6 = 0").select("record", "pos")
    return rec.report_lines(info, uids.where("o_orderkey % 6 <> 0").select("record", "pos", F.array(F.col("o_orderkey").cast("string")).alias("fields")), attributes)


_BITS = "right(lpad(bin(('0x' || hash[1:4])::bigint), 16, '0'), 16)"


@query(
    "sketch_updates",
    f"""with b as (select distinct upper(md5(text)) as hash from documents where doc_id % 11 <> 0)
    select ({_BITS})[1:4] as prefix, count(*) as n, true as same from b group by all""",
)
def sketch_updates(spark, sf):
    """Sketches of snapshot A made into those of B by adding and taking out what differs, held against those computed anew."""
    from recordsync.operators.reconcile import difference

    docs = _docs(spark, sf)
    a, b = docs.where("doc_id % 7 <> 0").select("hash"), docs.where("doc_id % 11 <> 0").select("hash")
    diff = difference(a, b)
    updated = bk.updated_sketches(bk.sketches(a, 5, 2), diff.where("side = 'there'").select("hash"), diff.where("side = 'here'").select("hash"), 5, 2)
    anew = bk.sketches(b, 5, 2).select("prefix", F.col("samples").alias("s"))
    return updated.join(anew, "prefix", "full_outer").select("prefix", "n", F.col("samples").eqNullSafe(F.col("s")).alias("same"))


@query(
    "sketch_consistency",
    f"""with e as (select distinct upper(md5(text)) as hash from documents) select ({_BITS})[1:2] as prefix, count(*) as n, ({_BITS})[1:2] <> '01' as consistent from e group by all""",
)
def sketch_consistency(spark, sf):
    """Whether each bucket's sketch is the product of those below it, after the lower ones have lost an element of bucket 01."""
    docs = _docs(spark, sf)
    lost = docs.where("substr(hash, 1, 1) in ('4', '5', '6', '7')").agg(F.min("hash").alias("hash"))
    low = bk.sketches(docs.join(lost, "hash", "left_anti"), 5, 2)
    return bk.consistent_sketches(bk.sketches(docs, 5, 1), low)
