"""Bucket summaries and set differences over two snapshots of ``documents``.

Elements are the MD5 digests of the texts; snapshot A lacks every seventh doc_id, B every eleventh.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions.ids import bit_prefix, child_index, content_element
from recordsync.operators import buckets as bk
from recordsync.operators import reconcile as rc
from recordsync.plans.registry import query
from recordsync.plans.tables import table

_A = "a as (select distinct upper(md5(text)) as hash from documents where doc_id % 7 <> 0)"
_B = "b as (select distinct upper(md5(text)) as hash from documents where doc_id % 11 <> 0)"
_ALL = "e as (select distinct upper(md5(text)) as hash from documents)"
# The first 16 bits of a digest as text.
_BITS = "right(lpad(bin(('0x' || hash[1:4])::bigint), 16, '0'), 16)"
_COUNTS = f"c as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, count(*) as n from e, range(0, 5) as t(d) group by all)"
_DIFF = f"{_A}, {_B}, diff as (select hash, 'here' as side from (select * from a except select * from b) union all select hash, 'there' from (select * from b except select * from a))"
_TREE = """tree as (select c.depth, c.prefix, c.n, c.n <= 50 or c.depth = 4 as is_leaf from c left join c p on p.depth = c.depth - 1 and p.prefix = c.prefix[1:(c.depth - 1) * 2]
    where c.depth = 0 or p.n > 50)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", content_element(F.col("text")).alias("hash"))


def _sides(spark, sf):
    docs = _docs(spark, sf)
    return docs.where("doc_id % 7 <> 0").select("hash"), docs.where("doc_id % 11 <> 0").select("hash")


@query("bucket_counts", f"with {_ALL}, {_COUNTS} select * from c")
def bucket_counts(spark, sf):
    return bk.counts(_docs(spark, sf))


@query("bucket_elements", f"with {_ALL} select hash, d::int as depth, ({_BITS})[1:d * 2] as prefix from e, range(0, 5) as t(d)")
def bucket_elements(spark, sf):
    return bk.elements(_docs(spark, sf))


@query("bucket_leaves", f"with {_ALL}, {_COUNTS}, {_TREE} select * from tree")
def bucket_leaves(spark, sf):
    return bk.leaves(bk.counts(_docs(spark, sf)))


@query("leaf_of_element", f"with {_ALL}, {_COUNTS}, {_TREE} select hash, depth, prefix from e join tree on is_leaf and prefix = ({_BITS})[1:depth * 2]")
def leaf_of_element(spark, sf):
    docs = _docs(spark, sf)
    return bk.leaf_of(docs, bk.leaves(bk.counts(docs)))


@query("tree_shape", f"with {_ALL}, {_COUNTS}, {_TREE} select max(depth) as depth, count(*) as nodes, (count(*) filter (not is_leaf)) as internal, (count(*) filter (is_leaf)) as leaves, (sum(n) filter (is_leaf))::bigint as elements from tree")
def tree_shape(spark, sf):
    return bk.shape(bk.leaves(bk.counts(_docs(spark, sf))))


@query("bucket_fold", f"""with {_ALL}, {_COUNTS}, {_TREE}, l as (select * from tree where is_leaf)
    select d::int as depth, prefix[1:d * 2] as prefix, max(n) as value from l, range(0, 5) as t(d) where d <= depth group by all""")
def bucket_fold(spark, sf):
    """The largest leaf below each bucket."""
    return bk.fold(bk.leaves(bk.counts(_docs(spark, sf))), F.max("n"), F.max("value"))


@query("bucket_digest", "with p as (select lang, md5(hash)[1:3] as part, md5(string_agg(32 || ':' || hash, '' order by hash)) as d from (select distinct lang, upper(md5(text)) as hash from documents) group by all) select lang, upper(md5(string_agg(d, '' order by part))) as digest from p group by lang")
def bucket_digest(spark, sf):
    return bk.set_digest(_docs(spark, sf), "lang", F.col("hash"))


@query("set_digest", "select source, upper(md5(unhex(string_agg(lpad(to_hex(length(h) // 2), 8, '0') || h, '' order by h)))) as digest from (select distinct source, hex(encode(lang || doc_id % 100)) as h from documents) group by source")
def set_digest(spark, sf):
    """The digest of each source's set of languages with two digits of the id, as hosts exchange it."""
    docs = table(spark, sf, "documents")
    return bk.exact_set_digest(docs, "source", F.concat("lang", (F.col("doc_id") % 100).cast("string")))


@query("consistency", f"with {_ALL}, {_COUNTS}, broken as (select depth, prefix, n + (depth = 3 and prefix = '000000')::int as n from c), s as (select depth - 1 as depth, prefix[1:(depth - 1) * 2] as prefix, sum(n)::bigint as below from broken where depth > 0 group by all) select depth, prefix, n, below from broken full join s using (depth, prefix) where depth < 4 and n is distinct from below")
def consistency(spark, sf):
    """Buckets whose count is not the sum of those below, after one count has been spoilt."""
    c = bk.counts(_docs(spark, sf))
    spoilt = F.when((F.col("depth") == 3) & (F.col("prefix") == "000000"), F.col("n") + 1).otherwise(F.col("n"))
    return bk.inconsistent(c.withColumn("n", spoilt))


@query("bit_slices", "select doc_id, right(lpad(bin(('0x' || upper(md5(text))[1:4])::bigint), 16, '0'), 16)[1:7] as bits, (('0x' || upper(md5(text))[1:1])::int % 4) as child from documents")
def bit_slices(spark, sf):
    return _docs(spark, sf).select("doc_id", bit_prefix(F.col("hash"), 7).alias("bits"), child_index(F.col("hash"), 1).alias("child"))


@query("bucket_sketches")
def bucket_sketches(spark, sf):
    """Products over the elements of each bucket; tests hold them against plain loops."""
    return bk.sketches(_docs(spark, sf), 5, 3).withColumn("samples", F.array_join("samples", ","))


@query("sym_diff", f"with {_DIFF} select * from diff")
def sym_diff(spark, sf):
    return rc.difference(*_sides(spark, sf))


@query("reconcile_exact", f"with {_DIFF} select side, count(*) as n, min(hash) as first from diff group by side")
def reconcile_exact(spark, sf):
    return rc.difference(*_sides(spark, sf)).groupBy("side").agg(F.count("*").alias("n"), F.min("hash").alias("first"))


@query("reconcile_pruned", f"with {_DIFF} select * from diff")
def reconcile_pruned(spark, sf):
    a, b = _sides(spark, sf)
    depths = bk.depth_for(table(spark, sf, "documents"), 100)
    return rc.pruned_difference(a, b, bk.digests(a, depths=depths), bk.digests(b, depths=depths))


@query("reconcile_sketch", f"with {_DIFF} select * from diff")
def reconcile_sketch(spark, sf):
    # About three differences a bucket, so that most are solved from sketches.
    return rc.reconcile(*_sides(spark, sf), m=8, depth=bk.depth_for(table(spark, sf, "documents"), 16))


@query("summary_check", f"with {_DIFF} select hash, side from diff where side = 'here'")
def summary_check(spark, sf):
    """What a derived set lacks of the base."""
    return rc.difference(*_sides(spark, sf)).where("side = 'here'")


@query(
    "recon_action",
    f"""with {_A}, {_B}, x as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, list_sort(list(hash)) as l, count(*) as n from a, range(0, 5) as t(d) group by all),
    y as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, list_sort(list(hash)) as l, count(*) as n from b, range(0, 5) as t(d) group by all)
    select depth, prefix, case when least(coalesce(x.n, 0), coalesce(y.n, 0)) < 150 then 'full' else 'sketch' end as action
    from x full join y using (depth, prefix) where x.l is distinct from y.l""",
)
def recon_action(spark, sf):
    a, b = _sides(spark, sf)
    return rc.actions(bk.digests(a), bk.digests(b))


@query(
    "recon_descend",
    f"""with {_A}, {_B}, x as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, list_sort(list(hash)) as l, count(*) as n from a, range(0, 5) as t(d) group by all),
    y as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, list_sort(list(hash)) as l, count(*) as n from b, range(0, 5) as t(d) group by all),
    failed as (select x.depth, x.prefix from x join y using (depth, prefix) where abs(x.n - y.n) > 2)
    select depth, prefix, case when least(coalesce(x.n, 0), coalesce(y.n, 0)) < 30 or (f.depth is not null and depth = 4) then 'full' when f.depth is not null then 'descend' else 'sketch' end as action
    from x full join y using (depth, prefix) left join failed f using (depth, prefix) where x.l is distinct from y.l""",
)
def recon_descend(spark, sf):
    """What to do with each differing bucket when sketches have failed where sizes are more than two apart."""
    a, b = (bk.digests(x) for x in _sides(spark, sf))
    failed = a.alias("a").join(b.alias("b"), ["depth", "prefix"]).where("abs(a.n - b.n) > 2").select("depth", "prefix")
    return rc.actions(a, b, 5, 6, failed)


@query("fetch_plan", f"with {_DIFF} select hash, ((row_number() over (order by hash) - 1) // 20)::bigint as bundle from diff where side = 'there'")
def fetch_plan(spark, sf):
    return rc.fetch_plan(*_sides(spark, sf), size=20)


@query(
    "peer_plan",
    """with p as (select distinct 'a' as peer, upper(md5(text)) as hash from documents where doc_id % 7 <> 0 union select distinct 'b', upper(md5(text)) from documents where doc_id % 11 <> 0
        union select distinct 'c', upper(md5(text)) from documents where doc_id % 5 = 0),
    m as (select hash, list_sort(list(peer)) as holders from p where hash not in (select upper(md5(text)) from documents where doc_id % 3 = 0) group by hash),
    d as (select hash, holders[((row_number() over (partition by holders order by hash) - 1) % len(holders) + 1)::int] as peer from m)
    select hash, peer, ((row_number() over (partition by peer order by hash) - 1) // 20)::bigint as bundle from d""",
)
def peer_plan(spark, sf):
    """What three peers hold and a third snapshot lacks: each hash from one of its holders, in bundles of 20."""
    docs = _docs(spark, sf)
    peers = docs.where("doc_id % 7 <> 0").select(F.lit("a").alias("peer"), "hash").unionByName(docs.where("doc_id % 11 <> 0").select(F.lit("b").alias("peer"), "hash"))
    peers = peers.unionByName(docs.where("doc_id % 5 = 0").select(F.lit("c").alias("peer"), "hash"))
    return rc.peer_plan(docs.where("doc_id % 3 = 0").select("hash"), peers, 20)


@query("fetch_and_merge", "select distinct upper(md5(text)) as hash from documents where doc_id % 7 <> 0 or doc_id % 11 <> 0")
def fetch_and_merge(spark, sf):
    """Snapshot A after what it lacks has been fetched from B by bundles."""
    from recordsync.operators.index import multi_get
    from recordsync.operators.records import apply_updates

    a, b = _sides(spark, sf)
    a = a.distinct()
    fetched = multi_get(b.distinct(), rc.fetch_plan(a, b, size=20))
    return apply_updates(a, a.where("false"), fetched, "hash")


@query(
    "summary_catchup",
    """with log as (select ts, event_id as seq, event_type = 'error' as gone, upper(md5(user_id::varchar)) as hash from events),
    l as (select hash, max({t: ts, s: seq, g: gone}).g as gone from log group by hash),
    e as (select upper(md5(c_custkey::varchar)) as hash from customer where c_custkey % 2 = 0 and hash not in (select hash from l where gone) union select hash from l where not gone)
    select d::int as depth, (right(lpad(bin(('0x' || hash[1:4])::bigint), 16, '0'), 16))[1:d * 2] as prefix, count(*) as n from e, range(0, 5) as t(d) group by all""",
)
def summary_catchup(spark, sf):
    """A summary of half of the customers after the log has been added to it."""
    from recordsync.plans.log import log

    events = log(spark, sf).withColumn("hash", content_element(F.col("hash").cast("string")))
    present = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(content_element(F.col("c_custkey").cast("string")).alias("hash"))
    return rc.catch_up(bk.digests(present), events, present).select("depth", "prefix", "n")


@query("set_union", f"with {_A}, {_B} select hash from a union select hash from b")
def set_union(spark, sf):
    return rc.union(*_sides(spark, sf))


@query("set_intersect", f"with {_A}, {_B} select hash from a intersect select hash from b")
def set_intersect(spark, sf):
    return rc.intersection(*_sides(spark, sf))


@query("set_except", f"with {_A}, {_B} select hash from a except select hash from b")
def set_except(spark, sf):
    return rc.minus(*_sides(spark, sf))


@query("set_relation", f"with {_DIFF} select (count(*) filter (side = 'here')) = 0 as subset, (count(*) filter (side = 'there')) = 0 as superset, count(*) = 0 as equal from diff")
def set_relation(spark, sf):
    return rc.relation(*_sides(spark, sf))


_EDGES = "edges as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem)"


@query(
    "reachability",
    f"""with recursive {_EDGES}, r as (select 's1' as node, 0 as hop union select dst, hop + 1 from r join edges on src = node where hop < 10)
    select node, min(hop) as hop from r group by node""",
)
def reachability(spark, sf):
    """Suppliers and parts that one supplier reaches, and in how many steps."""
    lines = table(spark, sf, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    edges = lines.select(s.alias("src"), p.alias("dst")).unionByName(lines.select(p.alias("src"), s.alias("dst")))
    return rc.reach(edges, spark.range(1).select(F.lit("s1").alias("node")))
