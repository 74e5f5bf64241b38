"""Records over ``orders`` and ``lineitem``: an order is a record, its lines the children, the part a parent."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions import times
from recordsync.functions.codes import label
from recordsync.functions.ids import content_element
from recordsync.operators.order import order_statistic
from recordsync.operators import records as rec
from recordsync.plans.registry import query
from recordsync.plans.tables import table

_ITEM = "l_partkey::varchar || ':' || l_suppkey::varchar || ':' || l_linenumber::varchar || ':' || cast(l_quantity as decimal(18,2))::varchar"
_CHILD = "lpad(l_suppkey::varchar, 8, '0') || ':' || l_linenumber::varchar"


def _item():
    return F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")), F.col("l_quantity").cast("decimal(18,2)").cast("string"))


def _child():
    return F.concat_ws(":", F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), F.col("l_linenumber").cast("string"))


@query("content_digest", f"select l_orderkey, upper(md5(string_agg(length({_ITEM}) || ':' || {_ITEM}, '' order by {_ITEM}))) as hash from lineitem group by l_orderkey")
def content_digest(spark, sf):
    return rec.digest(table(spark, sf, "lineitem"), "l_orderkey", _item())


@query("canonicalise", f"select l_orderkey, l_partkey, array_to_string(list_sort(list(distinct {_CHILD})), ',') as children from lineitem group by all")
def canonicalise(spark, sf):
    out = rec.canonical(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", _child())
    return out.withColumn("children", F.array_join("children", ","))


_TWO = "(select l_orderkey // 2 as identity, l_orderkey as record, l_partkey, l_suppkey, l_linenumber from lineitem)"


def _pairs(spark, sf):
    """Orders of one number, halved, share an identity."""
    return table(spark, sf, "lineitem").withColumn("identity", F.expr("l_orderkey div 2")).withColumn("record", F.col("l_orderkey"))


@query(
    "merge_groups",
    f"""with t as {_TWO}, g as (select identity from t group by 1 having count(distinct record) > 1)
    select identity, l_partkey, array_to_string(list_sort(list(distinct {_CHILD})), ',') as children from t where identity in (select identity from g) group by all""",
)
def merge_groups(spark, sf):
    out = rec.merge(_pairs(spark, sf), "identity", "record", "l_partkey", _child())
    return out.withColumn("children", F.array_join("children", ","))


@query("merge_deletes", f"with t as {_TWO}, g as (select identity from t group by 1 having count(distinct record) > 1) select distinct record from t where identity in (select identity from g)")
def merge_deletes(spark, sf):
    return rec.merge_deletes(_pairs(spark, sf), "identity", "record")


_STORED = "select o_custkey as id, o_orderpriority as identity, upper(md5(o_orderkey::varchar)) as hash from orders where o_orderkey % 4 <> 0"
_INCOMING = "select o_custkey as id, o_orderpriority as identity, upper(md5(o_orderkey::varchar)) as hash from orders where o_orderkey % 4 in (0, 1)"


def _snapshots(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("identity"), content_element(F.col("o_orderkey").cast("string")).alias("hash")
    )
    return orders.where("o_orderkey % 4 in (0, 1)").drop("o_orderkey"), orders.where("o_orderkey % 4 <> 0").drop("o_orderkey")


@query(
    "merge_candidates",
    f"""with s as ({_STORED}), n as ({_INCOMING})
    select n.hash as new, s.hash as old from n join s using (id, identity) where n.hash not in (select hash from s)""",
)
def merge_candidates(spark, sf):
    incoming, stored = _snapshots(spark, sf)
    return rec.merge_candidates(incoming, stored, "id", "identity")


@query(
    "apply_updates",
    """
    select o_orderkey, case when o_orderkey % 5 = 0 then 'N' else o_orderstatus end as status from orders where o_orderkey % 7 <> 0 or o_orderkey % 5 = 0
    union all select -o_orderkey, 'N' from orders where o_orderkey % 5 = 0
    """,
)
def apply_updates(spark, sf):
    """A batch that deletes every seventh order, replaces every fifth and adds some."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    fifth = orders.where("o_orderkey % 5 = 0").withColumn("status", F.lit("N"))
    adds = fifth.unionByName(fifth.withColumn("o_orderkey", -F.col("o_orderkey")))
    return rec.apply_updates(orders, orders.where("o_orderkey % 7 = 0"), adds, "o_orderkey")


@query(
    "update_log",
    "select o_orderkey, 'Delete' as op from orders where o_orderkey % 7 = 0 union all select o_orderkey, 'Add' from orders where o_orderkey % 5 = 0",
)
def update_log(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return rec.update_log(orders.where("o_orderkey % 7 = 0"), orders.where("o_orderkey % 5 = 0"), "o_orderkey")


@query("dump_only_new", "select o_orderkey from orders where o_orderkey % 3 = 1")
def dump_only_new(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return rec.only_new(orders, orders.where("o_orderkey % 3 <> 1"), "o_orderkey")


@query("dup_groups", "select md5(text) as key, count(*) over (partition by md5(text)) as n, doc_id from documents qualify count(*) over (partition by md5(text)) > 1")
def dup_groups(spark, sf):
    """The documents whose text others have as well, with their group's key and size."""
    return rec.duplicate_members(table(spark, sf, "documents"), F.md5("text"), "doc_id")


_PRIMARY = "o_orderpriority in ('1-URGENT', '2-HIGH')"


@query(
    "primary_first",
    f"""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by {_PRIMARY} desc,
        case when {_PRIMARY} then o_orderdate end desc nulls last, o_orderkey)::bigint as no from orders""",
)
def primary_first(spark, sf):
    primary = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    out = rec.primary_first(table(spark, sf, "orders"), "o_custkey", primary, "o_orderdate", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", F.col("no").cast("long").alias("no"))


@query("latest_sig", "select o_custkey, max(o_orderdate) as last, max({d: o_orderdate, k: -o_orderkey, p: o_totalprice}).p as o_totalprice from orders group by 1")
def latest_sig(spark, sf):
    return rec.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")


@query("present_filter", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag <> 'R' and l_quantity > 40)")
def present_filter(spark, sf):
    """Orders that keep a line after the bad ones have gone."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rec.with_valid_children(orders, lines, F.expr("l_returnflag <> 'R' and l_quantity > 40"), "o_orderkey")


@query("revoked_flag", "select l_orderkey, bool_or(l_returnflag in ('R', 'A')) as revoked from lineitem group by 1")
def revoked_flag(spark, sf):
    return rec.revoked(table(spark, sf, "lineitem"), "l_orderkey", ["R", "A"], "l_returnflag")


_LETTER = "case event_type when 'signup' then 'P' when 'click' then 'S' when 'view' then 'U' when 'purchase' then 'K' else 'S' end"


def _letters(spark, sf):
    code = {"signup": "P", "click": "S", "view": "U", "purchase": "K"}
    return table(spark, sf, "events").withColumn("letter", label(F.col("event_type"), code, "S"))


@query(
    "grammar_ok",
    f"""with s as (select user_id, string_agg({_LETTER}, '' order by ts, event_id) as letters from events group by 1)
    select user_id, regexp_full_match('P' || letters, 'PS*([UA]S*)*(KS*)*') as v4, regexp_full_match('P' || letters, 'PS*([UA]S*)*') as v3,
        length(letters) - length(regexp_extract(letters, '^S*([UA]S*)*(KS*)*')) as n_after from s""",
)
def grammar_ok(spark, sf):
    """Whether all events of each user, after a leading key, follow the grammar of either version, and how many stand after the first breach."""
    rows = _letters(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "letter"))).alias("e"))
    letters = F.array_join(F.transform("e", lambda e: e["letter"]), "")
    whole = F.concat(F.lit("P"), letters)
    after = F.length(letters) - F.length(F.regexp_extract(letters, "^S*([UA]S*)*(KS*)*", 0))
    return rows.select("user_id", rec.well_formed(whole, F.lit(4)).alias("v4"), rec.well_formed(whole, F.lit(3)).alias("v3"), after.cast("long").alias("n_after"))


@query(
    "grammar_rows",
    f"""with s as (select user_id, string_agg({_LETTER}, '' order by ts, event_id) as letters from events group by 1)
    select user_id, regexp_full_match('P' || letters, 'PS*([UA]S*)*(KS*)*') as v4, regexp_full_match('P' || letters, 'PS*([UA]S*)*') as v3,
        length(letters) - length(regexp_extract(letters, '^S*([UA]S*)*(KS*)*')) as n_after from s""",
)
def grammar_rows(spark, sf):
    """What grammar_ok tells, without gathering a user's events."""
    return rec.grammar(_letters(spark, sf), "user_id", ["ts", "event_id"], headed=False)


@query(
    "assemble_records",
    """with m as (select *, sum((event_type = 'signup' or first)::int) over (partition by user_id order by ts, event_id) as rec from (
        select *, row_number() over (partition by user_id order by ts, event_id) = 1 as first from events))
    select user_id, rec::bigint as rec, count(*) as n, string_agg(event_id, ',' order by ts, event_id) as members from m group by user_id, rec""",
)
def assemble_records(spark, sf):
    """A stream cut into records at each marker; the first item opens one whatever it is."""
    from recordsync.sources.packets import assemble

    out = assemble(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.struct("ts", "event_id"))
    members = F.array_join(F.transform("items", lambda i: i["event_id"].cast("string")), ",")
    return out.select("user_id", F.col("rec").cast("long").alias("rec"), F.size("items").cast("long").alias("n"), members.alias("members"))


@query("uid_strings", "select l_orderkey, string_agg(l_partkey, ',' order by l_linenumber, l_partkey) filter (l_returnflag = 'N') as uids from lineitem group by 1")
def uid_strings(spark, sf):
    """Items of one kind of each record, in their order."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("i"))
    kept = F.filter("i", lambda i: i["l_returnflag"] == "N")
    return rows.select("l_orderkey", F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda i: i["l_partkey"].cast("string")), ",")).alias("uids"))


@query(
    "expiry",
    """select o_orderkey, case when o_custkey % 4 > 0 then o_orderdate + to_days((o_custkey % 4 * 100)::int) end as expires,
        coalesce(case when o_custkey % 4 > 0 then o_orderdate + to_days((o_custkey % 4 * 100)::int) end < timestamp '1996-01-01', false) as expired from orders""",
)
def expiry(spark, sf):
    seconds = F.col("o_custkey") % 4 * 100 * 86_400
    now = F.expr("timestamp '1996-01-01 00:00:00'")
    created = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", times.expiry(created, seconds).alias("expires"), times.is_expired(created, seconds, now).alias("expired"))


@query(
    "index_listing",
    """select c_custkey, lpad(c_nationkey::varchar, 5, ' ') || left(c_mktsegment, 1) || '/' || right(upper(md5(c_custkey::varchar)), 8) as head,
        case when octet_length(encode(repeat(c_name, 1 + c_custkey % 70))) > 1024 then '[' || octet_length(encode(repeat(c_name, 1 + c_custkey % 70))) || ' bytes]'
        else repeat(c_name, 1 + c_custkey % 70) end as uid from customer""",
)
def index_listing(spark, sf):
    """Listing columns: size and letter, short id, and a name or, where too long, its size."""
    name = F.repeat("c_name", F.lit(1) + (F.col("c_custkey") % 70).cast("int"))
    size = F.octet_length(name)
    head = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 5, " "), F.left("c_mktsegment", F.lit(1)), F.lit("/"), F.right(content_element(F.col("c_custkey").cast("string")), F.lit(8)))
    uid = F.when(size > 1024, F.concat(F.lit("["), size.cast("string"), F.lit(" bytes]"))).otherwise(name)
    return table(spark, sf, "customer").select("c_custkey", head.alias("head"), uid.alias("uid"))


@query(
    "mr_lines",
    """select c_custkey as record, 0::bigint as no, 'pub:' || upper(md5(c_custkey::varchar)) || ':' || c_nationkey || ':' as line from customer
    union all select o_custkey, no, 'uid:' || o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d') from (
        select *, row_number() over (partition by o_custkey order by o_orderkey) as no from orders)""",
)
def mr_lines(spark, sf):
    """Machine-readable report: customers as records, their orders as user ids."""
    from pyspark.sql import Window

    info = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("record"),
        F.array(content_element(F.col("c_custkey").cast("string")), F.col("c_nationkey").cast("string"), F.lit("")).alias("fields"),
    )
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    uids = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("record"), pos.alias("pos"), F.array(F.col("o_orderkey").cast("string"), times.date_text(F.col("o_orderdate"))).alias("fields")
    )
    return rec.report_lines(info, uids)


@query("mr_head", "select 'info:1:' || count(*) as line from customer")
def mr_head(spark, sf):
    return rec.report_head(table(spark, sf, "customer"))


@query(
    "reductions",
    """select l_returnflag, avg(l_quantity) as mean, quantile_disc(l_quantity, 0.5) as median, min(l_quantity) as low, max(l_quantity) as high,
        count_if(l_discount > 0.05)::bigint as n_if, bool_and(l_tax < 0.08) as every_one, count(l_partkey) > count(distinct l_partkey) as has_dups
    from (select * from lineitem) group by 1""",
)
def reductions(spark, sf):
    lines = table(spark, sf, "lineitem")
    middle = order_statistic(lines, "l_returnflag", "l_quantity").withColumnRenamed("l_quantity", "median")
    return lines.groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("mean"),
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_if(F.col("l_discount") > 0.05).alias("n_if"),
        F.every(F.col("l_tax") < 0.08).alias("every_one"), (F.count("l_partkey") > F.count_distinct("l_partkey")).alias("has_dups"),
    ).join(middle, "l_returnflag")


@query("median_prices", "select l_suppkey, quantile_disc(l_extendedprice, 0.5) as median from lineitem group by 1")
def median_prices(spark, sf):
    """The exact median of each supplier's prices, by rounds of histograms."""
    return order_statistic(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice").withColumnRenamed("l_extendedprice", "median")


@query("distinct_values", "select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as values from lineitem group by 1")
def distinct_values(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("values"))


@query("code_table", "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'final' else 'unknown' end as status from orders")
def code_table(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", label(F.col("o_orderstatus"), {"O": "open", "F": "final"}).alias("status"))
