"""Dumps and materialised tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsync.functions.ids import to_big_endian
from recordsync.operators import records as rec
from recordsync.operators.order import numbered
from recordsync.sources.shared import whole_parts


def shard_plan(records: DataFrame, size: int, key: str = "hash") -> DataFrame:
    """``records`` with the number of the shard of at most ``size`` that each goes to, in order of the hex digest ``key``."""
    keyed = records.withColumn("_k", F.conv(F.substring(key, 1, 12), 16, 10).cast("long"))
    rest = [c for c in records.columns if c != key]
    return numbered(keyed, "_k", key, *rest, name="_no").withColumn("shard", F.floor((F.col("_no") - 1) / size)).drop("_k", "_no")


def dump_shards(records: DataFrame, folder: str, size: int, key: str = "hash", kind: str = "parquet") -> None:
    """Write records in shards of at most ``size``, each a folder ``shard=N`` of one file in key order. kind: the format; ``text`` takes records of one text column."""
    planned = shard_plan(records, size, key)
    planned.repartition(F.col("shard")).sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").format(kind).save(folder)


def manifest(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """``(file, bytes, md5)`` of each file of a dump."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"), "path", F.col("modificationTime").alias("written"))


def manifest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row ``(n_files, n_records, n_shards, started, ended)`` of a dump in shards; the times are those of its first and last file."""
    files = manifest(spark, folder).agg(F.count("*").alias("n_files"), F.min("written").alias("started"), F.max("written").alias("ended"))
    rows = spark.read.parquet(folder).agg(F.count("*").alias("n_records"), F.count_distinct("shard").alias("n_shards"))
    return files.join(F.broadcast(rows)).select("n_files", "n_records", "n_shards", "started", "ended")


def packet_bytes(packets: Column) -> Column:
    """A record's packets in old format where the tag allows, else new, with the shortest fitting length of 1, 2 or 4 bytes (5 for new)."""

    def one(p: Column) -> Column:
        n = F.octet_length(p["body"])
        kind = F.when(n < 256, 0).when(n < 65536, 1).otherwise(2)
        old = F.concat(to_big_endian(F.lit(128) + p["tag"] * 4 + kind, 1), F.when(n < 256, to_big_endian(n, 1)).when(n < 65536, to_big_endian(n, 2)).otherwise(to_big_endian(n, 4)))
        new = F.concat(to_big_endian(F.lit(192) + p["tag"], 1), F.lit(b"\xff"), to_big_endian(n, 4))
        return F.hex(F.concat(F.when(p["tag"] < 16, old).otherwise(new), p["body"]))

    return F.unhex(F.array_join(F.transform(packets, one), ""))


def diff_log(difference: DataFrame, folder: str) -> None:
    """Write the hashes of a difference (peer, hash) as sorted text lines, a folder for each peer."""
    lines = difference.select("peer", F.col("hash").alias("value"))
    lines.repartitionByRange("peer", "value").sortWithinPartitions("peer", "value").write.mode("overwrite").partitionBy("peer").text(folder)


def apply_versioned(spark: SparkSession, folder: str, deletes: DataFrame, adds: DataFrame, key: str = "hash") -> int:
    """Apply a batch to the table in ``folder`` and return the new version.

    Versions are folders ``v=N``; one counts once its ``_SUCCESS`` file is there, which is written last, so readers
    see a whole batch or none of it. The batch's changes are written before it, to ``<folder>-log/version=N``, and count with it (see
    :func:`version_log`), so a crash between the two loses nothing: the batch is written again under the same number. One writer at a time.
    """
    old = current_version(spark, folder)
    base = spark.read.parquet(f"{folder}/v={old}") if old else adds.where("false")
    rec.update_log(deletes, adds, key).write.mode("overwrite").parquet(f"{folder}-log/version={old + 1}")
    rec.apply_updates(base, deletes, adds, key).write.mode("overwrite").parquet(f"{folder}/v={old + 1}")
    return old + 1


def version_log(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, op, version)``: the changes of all whole versions of a table."""
    return spark.read.parquet(f"{folder}-log").where(F.col("version") <= current_version(spark, folder))


def current_version(spark: SparkSession, folder: str) -> int:
    """The newest whole version of a table, 0 for none."""
    return max(whole_parts(spark, folder, "v"), default=0)


def _canonicalise(records: DataFrame, identity: str) -> DataFrame:
    return records.where(rec.well_formed(F.col("letters"), F.lit(4)))


def _deduplicate(records: DataFrame, identity: str) -> DataFrame:
    return records.withColumn("children", F.array_sort(F.array_distinct("children")))


def _merge(records: DataFrame, identity: str) -> DataFrame:
    merged = records.select("record", identity, "letters", F.explode_outer("children").alias("child")).groupBy(identity)
    return merged.agg(F.min("record").alias("record"), F.min_by("letters", "record").alias("letters"), F.array_sort(F.collect_set("child")).alias("children")).select("record", identity, "letters", "children")


#: Steps of a clean job by name, in order; deduplicating calls for merging again.
STEPS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"canonicalise": _canonicalise, "deduplicate": _deduplicate, "merge": _merge}


def clean(records: DataFrame, applied: Sequence[str], identity: str = "identity", steps: dict[str, Callable[[DataFrame, str], DataFrame]] = STEPS) -> tuple[DataFrame, list[str]]:
    """``records`` (record, identity, letters, children) after the ``steps`` that ``applied`` lacks, and the steps that now are.

    With the usual steps, records whose letters break the grammar go; children are made distinct; records of one identity
    become one, under the least record id. Other steps are functions of a table and the identity's name.
    """
    left = [s for s in steps if s not in applied]
    if "deduplicate" in left and "merge" in steps and "merge" not in left:
        left.append("merge")
    for step in left:
        records = steps[step](records, identity)
    return records, [s for s in steps if s in applied or s in left]


def clean_versioned(spark: SparkSession, folder: str, identity: str = "identity", steps: dict[str, Callable[[DataFrame, str], DataFrame]] = STEPS) -> int:
    """Clean the newest version of a table (see :func:`apply_versioned`) and return the version that is clean.

    The steps that a version has been through are kept in ``<folder>-steps/version=N`` and written before it; steps that are
    noted are skipped, and where all are, no new version is written.
    """
    old = current_version(spark, folder)
    noted = old in whole_parts(spark, f"{folder}-steps", "version")
    applied = [r["step"] for r in spark.read.parquet(f"{folder}-steps/version={old}").collect()] if noted else []
    out, now = clean(spark.read.parquet(f"{folder}/v={old}"), applied, identity, steps)
    if set(now) == set(applied):
        return old
    spark.createDataFrame([(s,) for s in now], "step string").write.mode("overwrite").parquet(f"{folder}-steps/version={old + 1}")
    out.write.mode("overwrite").parquet(f"{folder}/v={old + 1}")
    return old + 1
