"""What is shown of records, and clean jobs that remember their steps."""

import pytest
from pyspark.sql import functions as F

from recordsync.operators import index, listing, sinks


def test_presented(spark):
    keys = spark.createDataFrame([(1, True), (2, False), (3, True)], "record int, good boolean")
    parts = [(1, 10, "uid", True), (1, 11, "uid", True), (1, 12, "subkey", False), (1, 13, "subkey", True), (1, 0, "self", True), (2, 20, "uid", True), (3, 30, "uid", True), (3, 0, "self", True)]
    sigs = [(1, 10, True), (1, 10, False), (1, 11, False), (1, 12, True), (1, 13, True), (1, 0, False), (2, 20, True), (3, 0, True)]
    left, signed = listing.presented(
        keys, spark.createDataFrame(parts, "record int, component int, kind string, good boolean"), spark.createDataFrame(sigs, "record int, component int, good boolean")
    )
    assert sorted((r.record, r.component) for r in left.collect()) == [(1, 0), (1, 10), (1, 13), (3, 0)]
    assert sorted((r.record, r.component) for r in signed.collect()) == [(1, 10), (1, 13), (3, 0)]


def test_refused_ids(spark):
    rows = spark.createDataFrame([("AB" * 20, ["CD" * 20]), ("EF" * 20, [])], "fp string, sub_fps array<string>")
    assert index.refine_text(rows, "CD" * 8, "fp", "sub_fps").count() == index.refine_text(rows, "EF" * 20, "fp", "sub_fps").count() == 1
    for bad in ("AB" * 16, "AB", ""):
        with pytest.raises(ValueError):
            index.refine_text(rows, bad, "fp", "sub_fps")


def test_clean_remembers_its_steps(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(1, 7, "PUS", [2, 2, 1]), (2, 7, "PUS", [3]), (3, 8, "SP", [1])]
    df = spark.createDataFrame(rows, "record int, identity int, letters string, children array<int>")
    sinks.apply_versioned(spark, folder, df.where("false"), df, "record")
    assert sinks.clean_versioned(spark, folder) == 2 == sinks.clean_versioned(spark, folder)
    assert [(r.record, r.children) for r in spark.read.parquet(f"{folder}/v=2").collect()] == [(1, [1, 2, 3])]
    more = sinks.STEPS | {"upper": lambda t, identity: t.withColumn("letters", F.lower("letters"))}
    assert sinks.clean_versioned(spark, folder, steps=more) == 3 == sinks.clean_versioned(spark, folder, steps=more)
    assert spark.read.parquet(f"{folder}/v=3").first().letters == "pus"
