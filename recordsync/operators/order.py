"""Numbering and running values over a whole table without gathering it in one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.sources.shared import stored


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_share``: the number of the range of ``order`` (nulls first) that each falls in.

    There are as many ranges as shuffles have partitions; all columns of the order draw their bounds, so equal leading
    values do not meet in one task. The table is stored, so that ranges stay the same however often they are read.
    """
    return stored(rows.repartitionByRange(*order).withColumn("_share", F.spark_partition_id()), "ranges")


def _ahead(parts: DataFrame, value: Column, default: Column) -> DataFrame:
    """``parts``, a row for each range, with ``_before``: the aggregate ``value`` over the ranges before it."""
    before = value.over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_before", F.coalesce(before, default))


def numbered(rows: DataFrame, by: str, *ties: str, name: str = "no") -> DataFrame:
    """``rows`` with their number from 1 in ascending order of ``by`` (nulls first), then ``ties``.

    Rows are numbered within ranges, in parallel; only the ranges' counts meet in one place.
    """
    dealt = ranged(rows, by, *ties)
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_share").orderBy(by, *ties)))
    counts = dealt.groupBy("_share").agg(F.count("*").alias("_n"))
    before = _ahead(counts, F.sum("_n"), F.lit(0)).drop("_n")  # a row for each range
    return inside.join(F.broadcast(before), "_share").withColumn(name, F.col("_before") + F.col("_in")).drop("_share", "_in", "_before")


def order_statistic(rows: DataFrame, group: str, value: str, part: float = 0.5, bins: int = 1024) -> DataFrame:
    """``(group, value)``: the least value of each group that at least the share ``part`` of its values does not exceed; null values do not count.

    Found by rounds of histograms: the rows between the bounds that are left fall into ``bins``, and the bin with the wanted rank has the next
    bounds. A round moves at most ``bins`` rows a group, so no task holds a group, however large; it ends when both bounds of all groups meet, after
    about six rounds for doubles and fewer for what has few values.
    """
    each = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v is not null")
    all_rows = each.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    state = stored(all_rows.select("_g", "_low", "_high", F.greatest(F.lit(1), F.ceil(F.col("_n") * part)).cast("long").alias("_rank")), "ranks")
    done = []
    while True:
        done.append(state.where("_low <=> _high").select("_g", F.col("_low").alias("_v")))
        state = state.where("not (_low <=> _high)")
        if not state.head(1):
            break
        share = (F.col("_v").cast("double") - F.col("_low").cast("double")) / (F.col("_high").cast("double") - F.col("_low").cast("double"))
        # The ends have bins of their own, so every round narrows the bounds, however near they are.
        bin_no = F.when(F.col("_v") == F.col("_low"), 0).when(F.col("_v") == F.col("_high"), bins).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(1), F.floor(share * bins))))
        inside = each.join(state, each["_g"].eqNullSafe(state["_g"])).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        counted = inside.select(state["_g"], "_v", "_rank", bin_no.alias("_bin")).groupBy("_g", "_bin").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"), F.first("_rank").alias("_rank"))
        upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_bin"))  # bins of a group, a bounded number
        chosen = counted.withColumn("_upto", upto).where("_upto >= _rank and _upto - _n < _rank")
        state = stored(chosen.select("_g", "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")), "ranks")
    return functools.reduce(DataFrame.unionByName, done).select(F.col("_g").alias(group), F.col("_v").alias(value))


def spread(rows: DataFrame, value: str, *ties: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the long ``value`` made strictly increasing in its order, then ``ties``: at least one more than the one before.

    That is the greatest of value less number so far, plus the number. Numbers and greatest values run within ranges, in
    parallel; what the ranges before add up to is one row for each.
    """
    dealt = ranged(rows, value, *ties)
    along = Window.partitionBy("_share").orderBy(value, *ties)
    inside = dealt.withColumn("_in", F.row_number().over(along)).withColumn("_lead", F.col(value) - F.col("_in"))
    inside = inside.withColumn("_lead", F.max("_lead").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = inside.groupBy("_share").agg(F.count("*").alias("_n"), F.max("_lead").alias("_top"))
    parts = _ahead(parts, F.sum("_n"), F.lit(0)).withColumn("_top", F.col("_top") - F.col("_before"))
    top = F.max("_top").over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_share", "_before", top.alias("_top"))
    joined = inside.join(F.broadcast(parts), "_share")
    return joined.withColumn(name, F.greatest(F.col("_lead") - F.col("_before"), F.col("_top")) + F.col("_before") + F.col("_in")).drop("_share", "_in", "_lead", "_before", "_top")
