"""Loading of the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; zone-less timestamps become instants (the session runs in UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df
