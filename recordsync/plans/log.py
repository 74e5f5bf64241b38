"""The change log over ``events``: errors delete their user, other events add it."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordsync.functions import times
from recordsync.operators import changelog as cl
from recordsync.plans.registry import query
from recordsync.plans.tables import table

_LOG = "log as (select ts, event_id as seq, case when event_type = 'error' then 'Delete' else 'Add' end as op, user_id as hash from events)"
_LAST = "last as (select hash, max({t: ts, s: seq, op: op}).op as op from log group by hash)"
_T = "timestamp '2024-01-20 00:00:00'"


def log(spark, sf):
    op = F.when(F.col("event_type") == "error", "Delete").otherwise("Add")
    return table(spark, sf, "events").select("ts", F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("hash"))


def _t():
    return F.expr(_T)


@query("log_after", f"with {_LOG} select seq, op, hash from log where ts > {_T} order by ts, seq limit 500")
def log_after(spark, sf):
    """A page of 500 events after a time."""
    return cl.after(log(spark, sf), _t(), 500).select("seq", "op", "hash")


@query("log_tail", f"with {_LOG} select seq, op, hash from log where ts >= {_T} order by ts desc, seq desc limit 500")
def log_tail(spark, sf):
    """The newest 500 events, a page."""
    return cl.tail(log(spark, sf), _t(), 500).select("seq", "op", "hash")


@query("log_net", f"with {_LOG}, {_LAST} select hash from last where op = 'Add'")
def log_net(spark, sf):
    return cl.net(log(spark, sf))


@query(
    "cancel_pairs",
    f"""with {_LOG}, m as (select *, coalesce(op = lag(op) over (partition by hash order by ts, seq), true) as begins from log),
    r as (select *, sum(begins::int) over (partition by hash order by ts, seq) as run from m),
    n as (select *, row_number() over (partition by hash, run order by ts, seq) as no, count(*) over (partition by hash, run) as n from r)
    select ts, seq, op, hash from n where no = n and n % 2 = 1""",
)
def cancel_pairs(spark, sf):
    """What is left of each user's events after neighbours with opposite ops have cancelled."""
    return cl.cancel_opposites(log(spark, sf))


@query("newest_events", f"with {_LOG} select seq, op, hash from log order by ts desc, seq desc limit 3000")
def newest_events(spark, sf):
    """The newest 3,000 events, a cap of reports and dumps."""
    return cl.newest(log(spark, sf), 3000).select("seq", "op", "hash")


def _bins(unit: str, source: str = "log") -> str:
    size = times.UNITS[unit] * 1_000_000
    return f"""
    (with span as (select (floor(max(epoch_us(ts)) / {size}) + 1)::bigint * {size} as now, min(epoch_us(ts)) as oldest from {source}),
    bins as (select now, unnest(range((now - oldest) // {size} + 1)) as bin from span),
    n as (select (now - epoch_us(ts)) // {size} as bin, count(*) filter (op = 'Add') as a, count(*) filter (op = 'Delete') as d from {source}, span group by 1)
    select bin, make_timestamp(now - (bin + 1) * {size}) as lower, make_timestamp(now - bin * {size}) as upper,
        coalesce(a, 0) as num_adds, coalesce(d, 0) as num_dels, coalesce(a, 0) - coalesce(d, 0) as num_new, coalesce(d, 0) as num_updated
    from bins left join n using (bin))"""


@query("hist_daily", f"with {_LOG} select * from {_bins('day')}")
def hist_daily(spark, sf):
    return cl.histogram(log(spark, sf), "day")


@query("hist_hourly", f"with {_LOG} select * from {_bins('hour')}")
def hist_hourly(spark, sf):
    return cl.histogram(log(spark, sf), "hour")


@query(
    "stats_report",
    f"""
    with {_LOG}, edge as (select (floor(max(epoch_us(ts)) / 86400000000) + 1)::bigint * 86400000000 as e from log),
    part as (select log.* from log, edge where epoch_us(ts) > e - 31 * 86400000000 order by ts desc, seq desc limit 90000)
    select 'day' as kind, bin, upper, num_new, num_updated from {_bins('day', 'part')}
    union all select 'hour', bin, upper, num_new, num_updated from {_bins('hour', 'part')}
    union all select 'total', 0, null, (select count(*) from customer), 0
    """,
)
def stats_report(spark, sf):
    return cl.statistics(log(spark, sf), table(spark, sf, "customer"))


@query(
    "inc_dump",
    f"""with {_LOG}, slice as (select * from log where ts >= {_T} order by ts desc, seq desc limit 250000),
    last as (select hash, max({{t: ts, s: seq, op: op}}).op as op from slice group by hash)
    select c_custkey as hash, c_name from customer where c_custkey in (select hash from last where op = 'Add')""",
)
def inc_dump(spark, sf):
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("hash"), "c_name")
    return cl.incremental_dump(log(spark, sf), records, _t())


@query("log_semi_join", f"with {_LOG}, {_LAST} select c_custkey as hash from customer where c_custkey in (select hash from last where op = 'Add')")
def log_semi_join(spark, sf):
    return cl.survivors(log(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("hash")))


@query(
    "unique_ts",
    f"""
    with {_LOG}, t as (select seq, epoch_us(date_trunc('minute', ts)) as us, row_number() over (order by date_trunc('minute', ts), seq) as no from log)
    select seq, make_timestamp(max(us - no) over (order by no) + no) as ts from t
    """,
)
def unique_ts(spark, sf):
    rows = log(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    return cl.unique_times(rows).select("seq", "ts")


@query("log_by_hash", f"with {_LOG} select seq, hash, op, row_number() over (partition by hash order by ts, seq)::bigint as no from log")
def log_by_hash(spark, sf):
    return cl.by_hash(log(spark, sf)).select("seq", "hash", "op", F.col("no").cast("long").alias("no"))


@query("last_ts", "select max(ts) as ts from events")
def last_ts(spark, sf):
    return log(spark, sf).agg(F.max("ts").alias("ts"))


@query(
    "log_audit",
    f"""
    with {_LOG}, {_LAST}, held as (select c_custkey as hash from customer where c_custkey % 3 <> 0),
    found as (select hash, 'only in log' as finding from last where op = 'Add' and hash not in (select hash from held)
        union all select hash, 'only in summary' from held where hash not in (select hash from last where op = 'Add'))
    select seq, log.hash, finding from log left join found using (hash)
    """,
)
def log_audit(spark, sf):
    summary = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("hash"))
    return cl.audit(log(spark, sf), summary).select("seq", "hash", "finding")


@query("log_lines", f"with {_LOG} select seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || op[1:3] || ' ' || hash as line from log")
def log_lines(spark, sf):
    return cl.lines(log(spark, sf)).select("seq", "line")


@query("log_parse", f"with {_LOG} select date_trunc('second', ts) as ts, op, hash::varchar as hash from log")
def log_parse(spark, sf):
    """Log lines written and read back."""
    return cl.parse_lines(cl.lines(log(spark, sf)).select(F.col("line").alias("value")))


@query("outbox_enqueue", f"with {_LOG} select min(ts) as ts, hash from log where op = 'Add' and hash not in (select c_custkey from customer where c_custkey % 2 = 0) group by hash")
def outbox_enqueue(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("hash"))
    return cl.enqueue(log(spark, sf).where("op = 'Add'"), known, "ts")


@query(
    "outbox_dequeue",
    f"""with {_LOG}, box as (select min(ts) as ts, hash from log where op = 'Add' group by hash)
    select ts, hash from box where hash % 5 <> 0 order by ts, hash limit 100""",
)
def outbox_dequeue(spark, sf):
    """The next hundred items of a queue."""
    box = cl.enqueue(log(spark, sf).where("op = 'Add'"), log(spark, sf).where("false"), "ts")
    return cl.dequeue(box, box.where("hash % 5 = 0"), 100)


@query("rounded_up", "select event_id, make_timestamp((epoch_us(ts) // 86400000000 + 1) * 86400000000) as day, make_timestamp((epoch_us(ts) // 3600000000 + 1) * 3600000000) as hour from events")
def rounded_up(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", times.next_boundary(ts, "day").alias("day"), times.next_boundary(ts, "hour").alias("hour"))


@query("date_texts", "select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%Y-%m-%d %H') as h, strftime(ts, '%Y-%m-%d %H:%M:%S') as s from events")
def date_texts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", times.date_text(ts).alias("d"), times.hour_text(ts).alias("h"), times.second_text(ts).alias("s"))


@query("events_by_time", "select event_id, user_id, row_number() over (partition by user_id order by case when event_type = 'error' then null else ts end nulls first, event_id)::bigint as no from events")
def events_by_time(spark, sf):
    """Events of a user by time, those without a time first."""
    from recordsync.operators.records import by_time

    rows = table(spark, sf, "events").withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return by_time(rows, "user_id", "ts", "event_id").select("event_id", "user_id", F.col("no").cast("long").alias("no"))
