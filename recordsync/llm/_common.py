"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII bytes that are neither letters nor digits become spaces, A-Z become a-z.
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and its lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as pandas; integers beside nulls stay integers, since floats hold no more than 53 bits of them."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        whole = column.null_count and pa.types.is_integer(column.type)
        out[name] = pd.array(column.to_pylist(), f"Int{column.type.bit_width}") if whole else column.to_pandas()
    return pd.DataFrame(out)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like ``df.mapInPandas(run, schema)``, but integers keep all their bits where a batch holds nulls."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(map(_frame, rows)):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    return df.mapInArrow(batches, schema)


def row_key(text: str = "text") -> F.Column:
    """64-bit key of a row by its id and whole text; rows that agree in both are one document."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bloom_bits(hashes: DataFrame, most: int = 28) -> int:
    """How many bits, as a power of two, a Bloom filter of so many longs takes to let about one in a thousand others through; ``most`` at most."""
    return min(most, max(16, math.ceil(math.log2(64 * hashes.count() + 1))))


def _marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each hash in a filter of 2^``bits`` bits."""
    h = hashes.view(np.uint64)
    return np.stack([h >> np.uint64(64 - bits), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)]).astype(np.int64)


def bloom_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2^``bits`` bits of the one column of ``hashes``, longs: its size is fixed, whatever their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_marks(pdf["hash"].to_numpy(np.int64), bits))
            yield pd.DataFrame({"block": at >> 6, "word": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    got = hashes.toDF("hash").mapInPandas(run, "block long, word long").groupBy("block").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[got["block"].to_numpy()] = got["word"].to_numpy()
    return out.view(np.uint8)


def bloom_holds(data: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of some hashes, in an array of any shape, a filter holds, or seems to."""
    at = _marks(hashes, bits)
    return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0).astype(bool)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased UTF-8 words: runs of ASCII letters and digits and of non-ASCII bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file, in ``folder`` if given, else in the installed package of such files."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
