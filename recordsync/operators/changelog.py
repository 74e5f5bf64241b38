"""The add/delete change log: pages, net effects, histograms, audits.

A log has ts (timestamp), seq (a tie-breaker), op (``Add`` or ``Delete``) and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.functions.times import UNITS, next_boundary, second_text
from recordsync.operators.order import spread
from recordsync.sources.shared import stored


def after(log: DataFrame, ts: Column, n: int = 5000) -> DataFrame:
    """Forward page: the first ``n`` events strictly after ``ts``."""
    return log.where(F.col("ts") > ts).orderBy("ts", "seq").limit(n)


def tail(log: DataFrame, ts: Column, n: int = 5000) -> DataFrame:
    """Backward page: the newest ``n`` events at or after ``ts``, oldest first."""
    return log.where(F.col("ts") >= ts).orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def last_events(log: DataFrame) -> DataFrame:
    """The last event of each hash."""
    return log.groupBy("hash").agg(F.max(F.struct("ts", "seq", "op")).alias("e")).select("hash", "e.ts", "e.seq", "e.op")


def net(log: DataFrame) -> DataFrame:
    """Hashes whose last event is an Add."""
    return last_events(log).where("op = 'Add'").select("hash")


def survivors(log: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a replay of the log leaves; events on absent records are passed over."""
    return records.join(net(log), "hash", "left_semi")


def incremental_dump(log: DataFrame, records: DataFrame, ts: Column, cap: int = 250_000) -> DataFrame:
    """The records added by the newest ``cap`` events at or after ``ts`` and still there at their end."""
    return survivors(newest(log.where(F.col("ts") >= ts), cap), records)


def newest(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events by ts, then seq.

    Events are counted by hour first; only those of the hour that holds the last one to be kept are ranked.
    """
    binned = log.withColumn("_bin", F.date_trunc("hour", "ts"))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("_n"))  # a row for each hour
    counts = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = counts.where(F.col("_newer") < n).select("_bin", "_newer", (F.col("_newer") + F.col("_n") > n).alias("_cut"))
    rows = binned.join(F.broadcast(kept), "_bin")
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc("ts"), F.desc("seq")))
    edge = rows.where("_cut").withColumn("_rank", rank).where(F.col("_rank") <= n - F.col("_newer"))
    return rows.where("not _cut").select(log.columns).unionByName(edge.select(log.columns))


def cancel_opposites(log: DataFrame) -> DataFrame:
    """The events of ``log`` that are left when neighbours of one hash with opposite ops have cancelled in pairs, from the first on.

    Of a run in which each op is the opposite of the one before, pairs go from its start: the last event stays where
    the run is of odd length. Equal ops in a row never cancel.
    """
    along = Window.partitionBy("hash").orderBy("ts", "seq")
    begins = F.coalesce(F.col("op") == F.lag("op").over(along), F.lit(True)).cast("int")
    rows = log.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(along))
    ends = Window.partitionBy("hash", "_run").orderBy("ts", "seq")
    rows = rows.withColumn("_no", F.row_number().over(ends)).withColumn("_next", F.lead("op").over(ends))
    return rows.where("_next is null and _no % 2 = 1").select(log.columns)


def hour_counts(log: DataFrame) -> DataFrame:
    """``(upper, a, d, oldest, last)``: adds and deletes of each hour (lower, upper] of UTC, its first and last event; all in microseconds. A row for each hour with events."""
    us, hour = F.unix_micros("ts"), UNITS["hour"] * 1_000_000
    counts = (F.count_if(F.col("op") == "Add").alias("a"), F.count_if(F.col("op") == "Delete").alias("d"))
    return log.groupBy((F.ceil(us / hour) * hour).alias("upper")).agg(*counts, F.min(us).alias("oldest"), F.max(us).alias("last"))


def histogram(log: DataFrame, unit: str) -> DataFrame:
    """``(bin, lower, upper, num_adds, num_dels, num_new, num_updated)`` by day or hour, bin 0 the newest.

    Bins hold (lower, upper] and end at the last event rounded up; empty ones are kept. An oldest event just on an edge
    has a bin of its own. num_new: adds less deletes; num_updated: deletes. An empty log has no bins.
    """
    return binned(hour_counts(log), unit)


def binned(hours: DataFrame, unit: str) -> DataFrame:
    """The histogram (see there) of what :func:`hour_counts` gives: the events are counted once for both units."""
    size = UNITS[unit] * 1_000_000
    span = hours.agg(F.max("last").alias("last"), F.min("oldest").alias("oldest")).where("last is not null")
    now = span.select(((F.floor(F.col("last") / size) + 1) * size).alias("now"), "oldest")
    bins = now.select("now", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("now") - F.col("oldest")) / size))).alias("bin"))
    # A row: the end of the newest bin. An hour lies in one bin, since bins end with hours.
    placed = hours.join(F.broadcast(now.select("now"))).select(F.floor((F.col("now") - F.col("upper")) / size).alias("bin"), "a", "d")
    counts = placed.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    adds, dels = F.coalesce("a", F.lit(0)), F.coalesce("d", F.lit(0))
    edge = lambda k: F.timestamp_micros(F.col("now") - (F.col("bin") + k) * size)
    return bins.join(counts, "bin", "left").select(
        "bin", edge(1).alias("lower"), edge(0).alias("upper"), adds.alias("num_adds"), dels.alias("num_dels"),
        (adds - dels).alias("num_new"), dels.alias("num_updated"),
    )


def recent(log: DataFrame, days: int = 31, cap: int = 90_000) -> DataFrame:
    """The newest ``cap`` events of the ``days`` before the midnight after the last event."""
    end = log.agg(next_boundary(F.max("ts"), "day").alias("_end"))
    inside = log.join(F.broadcast(end)).where(F.unix_micros("ts") > F.unix_micros("_end") - days * UNITS["day"] * 1_000_000)
    return newest(inside.drop("_end"), cap)


def statistics(log: DataFrame, records: DataFrame, days: int = 31, cap: int = 90_000) -> DataFrame:
    """The report of :func:`recent` events: rows of ``kind`` day and hour (see :func:`histogram`) and one of kind total."""
    hours = stored(hour_counts(recent(log, days, cap)), "hours")
    rows = [binned(hours, unit).select(F.lit(unit).alias("kind"), "bin", "upper", "num_new", "num_updated") for unit in ("day", "hour")]
    null_time = F.lit(None).cast("timestamp").alias("upper")
    total = records.agg(F.count("*").alias("num_new")).select(F.lit("total").alias("kind"), F.lit(0).cast("long").alias("bin"), null_time, "num_new", F.lit(0).cast("long").alias("num_updated"))
    return rows[0].unionByName(rows[1]).unionByName(total)


def unique_times(log: DataFrame) -> DataFrame:
    """``log`` with ts made strictly increasing by (ts, seq): each at least a microsecond after the one before."""
    rows = spread(log.withColumn("_us", F.unix_micros("ts")), "_us", "seq", name="_ts")
    return rows.withColumn("ts", F.timestamp_micros("_ts")).drop("_us", "_ts")


def by_hash(log: DataFrame) -> DataFrame:
    """``log`` with each event's number within its hash, in order of time."""
    return log.withColumn("no", F.row_number().over(Window.partitionBy("hash").orderBy("ts", "seq")))


def audit(log: DataFrame, summary: DataFrame) -> DataFrame:
    """``log`` with ``finding``: whether its hash is only in the net log, only in the summary, or null where they agree."""
    there = net(log).withColumn("_log", F.lit(True)).join(summary.select("hash").distinct().withColumn("_sum", F.lit(True)), "hash", "full_outer")
    found = there.where("_log is null or _sum is null").select("hash", F.when(F.col("_log").isNull(), "only in summary").otherwise("only in log").alias("finding"))
    return log.join(found, "hash", "left")


def lines(log: DataFrame) -> DataFrame:
    """``(ts, seq, line)``: ``YYYY-MM-DD HH:MM:SS OP HASH`` for each event, OP Add or Del."""
    op = F.when(F.col("op") == "Add", "Add").otherwise("Del")
    return log.select("ts", "seq", F.concat_ws(" ", second_text(F.col("ts")), op, F.col("hash").cast("string")).alias("line"))


def parse_lines(text: DataFrame, line: str = "value") -> DataFrame:
    """``(ts, op, hash)`` of such lines; others are left out."""
    parts = F.split(line, " ")
    rows = text.where(F.col(line).rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d (Add|Del) \S+$"))
    return rows.select(
        F.to_timestamp(F.concat_ws(" ", parts[0], parts[1])).alias("ts"), F.when(parts[2] == "Add", "Add").otherwise("Delete").alias("op"), parts[3].alias("hash")
    )


def enqueue(records: DataFrame, known: DataFrame, ts: str) -> DataFrame:
    """Outbox rows ``(ts, hash)`` for records that are new."""
    return records.join(known, "hash", "left_anti").groupBy("hash").agg(F.min(ts).alias("ts")).select("ts", "hash")


def dequeue(outbox: DataFrame, acknowledged: DataFrame, n: int) -> DataFrame:
    """The earliest ``n`` rows of an outbox that have not been acknowledged."""
    return outbox.join(acknowledged, ["ts", "hash"], "left_anti").orderBy("ts", "hash").limit(n)
