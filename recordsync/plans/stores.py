"""Stored tables that take batches, and sets that are summarised and compared by part."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions.ids import content_element
from recordsync.functions.text import word_set
from recordsync.operators import buckets as bk
from recordsync.operators import setstore, store
from recordsync.plans.registry import query
from recordsync.plans.tables import table
from recordsync.sources.shared import shared_folder, stored

_ORDERS = {"orders": store.Table(("o_orderkey",), 1)}


def _order_store(spark, sf):
    """Orders after two batches and a compaction between them: every seventh goes, every fifth is replaced and copied under a negative key, then every eleventh goes."""
    folder = shared_folder(spark, "orders")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    store.create(spark, folder, _ORDERS, {"orders": orders})
    fifth = orders.where("o_orderkey % 5 = 0").withColumn("status", F.lit("N"))
    adds = fifth.unionByName(fifth.withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    store.apply(spark, folder, _ORDERS, {"orders": (orders.where("o_orderkey % 7 = 0"), adds)})
    store.compact(spark, folder, "orders", _ORDERS["orders"])
    again = orders.where("o_orderkey % 33 = 0").withColumn("status", F.lit("M"))
    store.apply(spark, folder, _ORDERS, {"orders": (orders.where("o_orderkey % 11 = 0"), again)})
    return folder


_AFTER = """after as (
    select o_orderkey, case when o_orderkey % 33 = 0 then 'M' when o_orderkey % 5 = 0 then 'N' else o_orderstatus end as status from orders
    where o_orderkey % 33 = 0 or (o_orderkey % 11 <> 0 and (o_orderkey % 7 <> 0 or o_orderkey % 5 = 0))
    union all select -o_orderkey - 1, 'N' from orders where o_orderkey % 5 = 0)"""


@query("store_batches", f"with {_AFTER} select * from after")
def store_batches(spark, sf):
    """A stored table after two batches, of which one is in the base and one is not."""
    return store.read(spark, _order_store(spark, sf), "orders", _ORDERS["orders"])


@query("store_lookup", f"with {_AFTER} select * from after where (case when o_orderkey < 0 then -o_orderkey - 1 else o_orderkey end) % 100 = 0")
def store_lookup(spark, sf):
    """Look-ups by key, of all orders whose key is divisible by 100, in a stored table."""
    request = table(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.explode(F.array("o_orderkey", -F.col("o_orderkey") - 1)).alias("o_orderkey"))
    return store.look_up(spark, _order_store(spark, sf), "orders", _ORDERS["orders"], request)


@query(
    "store_changes",
    """select 1 as version, 'Add' as op, 2 * count(*) as n from orders where o_orderkey % 5 = 0 union all select 1, 'Delete', count(*) from orders where o_orderkey % 7 = 0 and o_orderkey % 5 <> 0
    union all select 2, 'Add', count(*) from orders where o_orderkey % 33 = 0 union all select 2, 'Delete', count(*) from orders where o_orderkey % 11 = 0 and o_orderkey % 33 <> 0""",
)
def store_changes(spark, sf):
    """What the batches of a stored table wrote, by version and op."""
    return store.changes(spark, _order_store(spark, sf), "orders", _ORDERS["orders"]).groupBy("version", "op").agg(F.count("*").alias("n"))


_INDEX = {"records": store.Table(("hash",), 1, True), "words": store.Table(("word", "hash"), 1)}
_WORD_SET = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9À-ÿ]+'))"


@query(
    "store_index",
    f"""with r as (select upper(md5(text)) as hash, min(doc_id) as doc_id, min(text) as text from documents group by 1 having min(doc_id) % 7 <> 0 or min(doc_id) % 2 = 0),
    w as (select hash, unnest({_WORD_SET}) as word from r)
    select word, count(*) as n, min(doc_id) as first from w join r using (hash) where word in ('the', 'and', 'of', 'is') group by word""",
)
def store_index(spark, sf):
    """Records and their postings in one store: a batch takes some records out and puts some back, in both tables at once."""
    docs = table(spark, sf, "documents").select(content_element(F.col("text")).alias("hash"), "doc_id", "text")
    records = docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    words = lambda rows: rows.select(F.explode(word_set(F.col("text"))).alias("word"), "hash")
    folder = shared_folder(spark, "index")
    store.create(spark, folder, _INDEX, {"records": records.drop("text"), "words": words(records)})
    gone, back = records.where("doc_id % 7 = 0"), records.where("doc_id % 14 = 0")
    store.apply(spark, folder, _INDEX, {"records": (gone, back.drop("text")), "words": (words(gone), words(back))})
    asked = spark.createDataFrame([(w,) for w in ("the", "and", "of", "is")], "word string")
    hits = store.look_up(spark, folder, "words", _INDEX["words"], asked)
    return hits.join(store.read(spark, folder, "records", _INDEX["records"]), "hash").groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_E = "select distinct upper(md5(text)) as hash from documents where"
_SETS = f"""a as ({_E} (doc_id % 7 <> 0 or substr(upper(md5(text)), 1, 1) > '3') and doc_id % 1000 <> 1), b as ({_E} doc_id % 11 <> 0 or substr(upper(md5(text)), 1, 1) > '3'),
    diff as (select hash, 'here' as side from (select * from a except select * from b) union all select hash, 'there' from (select * from b except select * from a))"""


def _stored_sets(spark, sf):
    """Two stored sets that differ where digests begin with 0 to 3, but for the elements that a batch takes out of the first one."""
    docs = table(spark, sf, "documents").select("doc_id", content_element(F.col("text")).alias("hash"))
    low = F.substring("hash", 1, 1) > "3"
    here, there, digits = shared_folder(spark, "here"), shared_folder(spark, "there"), setstore.digits_for(docs)
    setstore.create(spark, here, docs.where((F.col("doc_id") % 7 != 0) | low), digits)
    setstore.create(spark, there, docs.where((F.col("doc_id") % 11 != 0) | low), digits)
    kept = docs.where(((F.col("doc_id") % 7 != 0) | low) & (F.col("doc_id") % 1000 != 1))
    gone = docs.where("doc_id % 1000 = 1").join(kept, "hash", "left_anti")
    setstore.update(spark, here, gone, docs.where("false"), digits)
    return here, there, digits


@query("stored_difference", f"with {_SETS} select * from diff")
def stored_difference(spark, sf):
    """The difference of two stored sets, from the parts whose summaries differ."""
    here, there, digits = _stored_sets(spark, sf)
    return setstore.difference(spark, here, there, digits)


@query(
    "stored_summary",
    f"with {_SETS} select d::int as depth, (right(lpad(bin(('0x' || hash[1:4])::bigint), 16, '0'), 16))[1:d * 2] as prefix, count(*) as n from a, range(0, 3) as t(d) group by all",
)
def stored_summary(spark, sf):
    """The summary of a stored set after a batch, kept up from the batch alone (its first two levels)."""
    here, _, digits = _stored_sets(spark, sf)
    return setstore.summary(spark, here, digits).where("depth <= 2").select("depth", "prefix", "n")


_BITS = "right(lpad(bin(('0x' || hash[1:4])::bigint), 16, '0'), 16)"
_LEVELS = "range(0, 5) as t(d) group by all"


@query(
    "leaves_updated",
    f"""with old as (select distinct upper(md5(text)) as hash from documents),
    new as (select upper(md5(doc_id || 'x')) as hash from documents where upper(md5(doc_id || 'x')) < '4'),
    now as (select hash from old where substr(hash, 32, 1) < '5' union select hash from new),
    c as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, count(*) as n from old, {_LEVELS}),
    c1 as (select d::int as depth, ({_BITS})[1:d * 2] as prefix, count(*) as n from now, {_LEVELS}),
    inner_then as (select depth, prefix from c where n > 50 and depth < 4),
    s as (select c1.*, c1.depth < 4 and (n > 50 or (i.depth is not null and n > 25)) as split from c1 left join inner_then i using (depth, prefix))
    select s.depth, s.prefix, s.n, not s.split as is_leaf from s left join s p on p.depth = s.depth - 1 and p.prefix = s.prefix[1:s.depth * 2 - 2] where s.depth = 0 or p.split""",
)
def leaves_updated(spark, sf):
    """An adaptive tree kept up over a batch that takes two thirds of the elements out and puts many into one quarter: leaves split there and come back together elsewhere."""
    docs = table(spark, sf, "documents")
    old = docs.select(content_element(F.col("text")).alias("hash")).distinct()
    added = docs.select(content_element(F.concat(F.col("doc_id").cast("string"), F.lit("x"))).alias("hash")).where("hash < '4'").distinct()
    gone = old.where("substr(hash, 32, 1) >= '5'").join(added, "hash", "left_anti")
    came = added.join(old, "hash", "left_anti")
    folder, digits = shared_folder(spark, "set"), setstore.digits_for(docs)
    setstore.create(spark, folder, old, digits)
    tree = stored(bk.leaves(bk.counts(old)), "tree")
    changes = stored(gone.withColumn("d", F.lit(-1)).unionByName(came.withColumn("d", F.lit(1))), "changes")
    setstore.update(spark, folder, gone, added, digits)
    parts = setstore.parts_of(setstore.splitting(tree, changes), digits)
    return setstore.updated_leaves(tree, changes, setstore.elements(spark, folder, digits, parts=parts))
