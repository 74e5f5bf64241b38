"""Large packet dumps, read by many tasks.

A first pass over the packet headers of each file finds ranges of bytes that begin and end between packets. The bytes are
read in the splits that Spark makes of any file, in any store that it can read, and go to their ranges, which are parsed apart.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordsync.sources.packets import PACKETS, header, walk
from recordsync.sources.shared import stored

RANGES = "file string, start long, end long, seq long, error string"
#: Bytes of a range, and of a piece on its way there.
RANGE, PIECE = 8 << 20, 1 << 20


def _lines(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    """``(file, size, split, value)``: the bytes of files cut at line ends, in order within each split."""
    text = spark.read.options(pathGlobFilter=pattern, lineSep="\n").text(folder)
    m = F.col("_metadata")
    return text.select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_block_start"].alias("split"), F.col("value").cast("binary").alias("value"))


@contextlib.contextmanager
def _whole_files(spark: SparkSession) -> Iterator[None]:
    """What runs within reads each file by one task, in order."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(1 << 50))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """``(file, size, split, bytes)``: the rows of each batch that are of one split, joined."""
    for batch in batches:
        files, splits = batch["file"].to_pylist(), batch["split"].to_pylist()
        cuts = [0, *(i for i in range(1, len(files)) if (files[i], splits[i]) != (files[i - 1], splits[i - 1])), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield files[a], batch["size"][a].as_py(), splits[a], b"".join(v + b"\n" for v in batch["value"].slice(a, b - a).to_pylist())


def packet_ranges(spark: SparkSession, folder: str | list[str], pattern: str = "*.pgp", size: int = RANGE) -> DataFrame:
    """``(file, start, end, seq, error)``: ranges of whole packets, of ``size`` bytes and what is left of the last packet.

    seq: the number of packets before. Where a packet cannot be read, a row says so in ``error`` and the file ends there. A file is passed
    over by one task, which holds one batch of lines; only headers are looked at. An empty file has no range.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, start, first, seq, at, past = None, b"", 0, 0, 0, 0, 0
        for file, total, _, data in _runs(batches):
            rows = []
            if file != now:
                now, rest, start, first, seq, at, past = file, b"", 0, 0, 0, 0, 0
            # ``data`` begins at ``past``, ``rest`` is what came before it of a header that begins at ``at``.
            base, data = past - len(rest), rest + data
            past, rest = base + len(data), b""
            while at is not None and at < min(past, total):
                try:
                    got = header(data, at - base, total - base)
                except ValueError as e:
                    if start < at:
                        rows.append((file, start, at, first, None))
                    rows.append((file, at, at, seq, str(e)))
                    at = None
                    break
                if got is None:
                    rest = data[at - base :]
                    break
                at, seq = at + got[1] + got[2], seq + 1
                if at - start >= size or at == total:
                    rows.append((file, start, at, first, None))
                    start, first = at, seq
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "end", "seq", "error"), r, strict=True)) for r in rows], _ARROW)

    with _whole_files(spark):
        return stored(_lines(spark, folder, pattern).mapInArrow(find, RANGES), "ranges")


_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("seq", pa.int64()), ("error", pa.string())])


_PIECES = pa.schema([("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("rel", pa.int64()), ("data", pa.binary())])


def pieces(spark: SparkSession, folder: str | list[str], pattern: str = "*.pgp", size: int = PIECE) -> DataFrame:
    """``(file, at, data)``: the bytes of files in pieces of about ``size``, each with its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at, n = None, [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, (*now, at, b"".join(held)), strict=True))], _PIECES)

        for file, total, split, data in _runs(batches):
            if now != (file, split, total):
                if held:
                    yield out()
                now, held, at, n = (file, split, total), [], 0, 0
            for k in range(0, len(data), size):
                held.append(data[k : k + size])
                n += len(held[-1])
                if n >= size:
                    yield out()
                    held, at, n = [], at + n, 0
        if held:
            yield out()

    lines = _lines(spark, folder, pattern)
    # Where a split's first line begins is known from the bytes of the splits before it.
    splits = lines.groupBy("file", "split").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = lines.mapInArrow(cut, "file string, split long, size long, rel long, data binary")
    base = F.coalesce("base", F.raise_error(F.lit("a file was split in two ways")).cast("long"))
    placed = parts.join(bases, ["file", "split"], "left").withColumn("at", base + F.col("rel"))
    # A last line without an end has got one.
    return placed.select("file", "at", F.expr("substring(data, 1, int(least(octet_length(data), size - at)))").alias("data"))


def read_ranges(spark: SparkSession, folder: str | list[str], ranges: DataFrame, pattern: str = "*.pgp", block: int = RANGE) -> DataFrame:
    """Packets of the ``ranges`` of files (see :func:`packet_ranges`), like those of :func:`packets.read_packets`.

    Pieces and ranges meet by blocks of ``block`` bytes. A task holds a range at a time: its size and what is left of its last packet.
    """

    def parse(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        file, start, seq = (table[c][0].as_py() for c in ("file", "start", "seq"))
        rows = [(file, start + offset, seq + k, tag, len(body), body, None) for k, (offset, tag, body) in enumerate(walk(b"".join(table["data"].to_pylist())))]
        return pa.Table.from_pylist([dict(zip(_PACKETS.names, r, strict=True)) for r in rows], _PACKETS)

    of = lambda c: F.floor(c / block).cast("long")
    whole = ranges.where("error is null")
    asked = whole.withColumn("a", of(F.col("start"))).withColumn("block", F.explode(F.sequence("a", of(F.col("end") - 1))))
    end = F.col("at") + F.octet_length("data")
    sent = pieces(spark, folder, pattern, max(1, block // 8)).where(F.octet_length("data") > 0).withColumn("b", of(F.col("at"))).withColumn("block", F.explode(F.sequence("b", of(end - 1))))
    met = sent.join(asked, ["file", "block"]).where((F.col("at") < F.col("end")) & (end > F.col("start")) & (F.col("block") == F.greatest("a", "b")))
    own = met.select(
        "file", "start", "seq", F.greatest("at", "start").alias("at"),
        F.expr("substring(data, int(greatest(start - at, 0L)) + 1, int(least(end, at + octet_length(data)) - greatest(at, start)))").alias("data"),
    )
    bad = ranges.where("error is not null").selectExpr("file", "cast(null as long) as offset", "int(seq) as seq", "cast(null as int) as tag", "cast(null as long) as length", "cast(null as binary) as body", "error")
    return own.groupBy("file", "start").applyInArrow(parse, PACKETS).unionByName(bad)


_PACKETS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("seq", pa.int32()), ("tag", pa.int32()), ("length", pa.int64()), ("body", pa.binary()), ("error", pa.string())])


def unread(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """The ranges that begin where the reading of their file has got to, or after: ``done`` has (file, offset), of a file the greatest counts."""
    got = done.groupBy("file").agg(F.max("offset").alias("_got"))
    return ranges.join(got, "file", "left").where("_got is null or start >= _got").drop("_got")
