"""Near-duplicate lines across documents by a deletion-neighbourhood join.

A line is its words (A-Z lower-cased, white space collapsed), the edit unit a word. Lines one edit
apart share a variant: the text left when one word is deleted from one or both. All variants are
hashed and joined; the earliest line of each set of equal variants stays.

A pair one edit apart also agrees in its first or in its last half, so only lines that share a half with
another line emit variants; this loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import bloom_bits, bloom_filter, bloom_holds, free_name, map_frames, materialise, row_key

_BASE = 0x9E3779B97F4A7C15


def canonical(line: str) -> bytes:
    """The line's words, A-Z lower-cased, with one space between them."""
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().split())


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the first and last half, for a partner of as many words or more, and for one of fewer."""
    out = []
    for shorter in (len(words), len(words) - 1):
        half = shorter // 2
        out += [b"<%d " % shorter + b" ".join(words[:half]), b">%d " % shorter + b" ".join(words[len(words) - shorter + half :])]
    return [xxhash.xxh64_intdigest(k) for k in out]


def _lines(edit_words: int, min_words: int):
    """Rows of all lines of ``min_words`` or more; the halves count from ``edit_words``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, rows = [], []
            for i, text in enumerate(pdf["text"]):
                for no, line in enumerate((text or "").split("\n")):
                    words = line.encode("utf-8", "surrogatepass").lower().split()
                    if len(words) >= min_words:
                        at.append(i)
                        rows.append((no, xxhash.xxh64_intdigest(b" ".join(words)), *(half_keys(words) if len(words) >= edit_words else (0, 0, 0, 0))))
            n = np.array(rows, np.uint64).reshape(-1, 6).view(np.int64)
            yield pd.DataFrame({
                "key": pdf["key"].to_numpy()[at], "doc_id": pdf["doc_id"].array[at], "line_no": n[:, 0], "h": n[:, 1],
                "k1": n[:, 2], "k2": n[:, 3], "k3": n[:, 4], "k4": n[:, 5],
            })

    return run


def variant_hashes(line: bytes) -> np.ndarray:
    """Hash of the line without its i-th word for each i, then of the whole line.

    Equal word sequences have equal hashes, however they come about.
    """
    x = np.array([xxhash.xxh64_intdigest(w) for w in line.split(b" ")], np.uint64)
    n, base = len(x), np.uint64(_BASE)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = base
    powers = np.multiply.accumulate(powers)
    with np.errstate(over="ignore"):
        # Suffix sums of x[i] * base^i: the words after a deleted one move down by one power.
        terms = x * powers[:n]
        before = np.concatenate([[np.uint64(0)], np.add.accumulate(terms)])
        inverse = np.uint64(pow(_BASE, -1, 2**64))
        after = (before[n] - before[1:]) * inverse
        return np.concatenate([before[:n] + after, [before[n]]]).view(np.int64)


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hashes = [variant_hashes(t) for t in pdf["line"]]
        size = np.array([len(x) for x in hashes], int)
        pos = np.concatenate([np.arange(1, k + 1) for k in size] or [np.empty(0, int)])
        whole = pos == np.repeat(size, size)
        yield pd.DataFrame({
            "o": np.repeat(pdf["o"].to_numpy(), size), "variant": np.concatenate(hashes or [np.empty(0, np.int64)]),
            "m": np.repeat(size, size) - 2 + whole, "pos": np.where(whole, 0, pos),
        })


def within_one_edit(a: bytes, b: bytes) -> bool:
    """Whether one word inserted, deleted or replaced makes ``a`` into ``b``."""
    x, y = sorted((a.split(b" "), b.split(b" ")), key=len)
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return len(y) - len(x) <= 1 and x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.loc[[within_one_edit(a, b) for a, b in zip(pdf["line"], pdf["line2"], strict=True)], ["h"]]


def repeated_lines(docs: DataFrame, min_words: int = 5, edit_words: int = 10) -> DataFrame:
    """``(key, line_no)`` of each line of ``docs`` that repeats an earlier one and is to go.

    Order is by doc_id (nulls last), then line number. A line of ``min_words`` or more goes if the same
    words stand in an earlier line; one of ``edit_words`` or more also if an earlier line of that length is
    one word's edit away. Shorter lines never go. Rows that agree in doc_id and text are one document.
    Halves that lines share go to the workers as a Bloom filter sized by their number, of 32 MB at most; what it lets
    through beyond them only costs time.
    """
    whole = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    places = materialise(map_frames(whole, _lines(edit_words, min_words), "key long, doc_id long, line_no long, h long, k1 long, k2 long, k3 long, k4 long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "key")
    first = materialise(places.groupBy("h").agg(F.min(order).alias("place"), F.count("*").alias("n")))
    # Lines under edit_words have four zeros here.
    half = places.where("k1 <> 0 or k2 <> 0").select("h", F.explode(F.array("k1", "k2", "k3", "k4")).alias("half"))
    shared = materialise(half.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"))
    bits = bloom_bits(shared)
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(shared, bits))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, rows, keys = [], [], []
            for i, text in enumerate(pdf["text"]):
                for no, line in enumerate((text or "").split("\n")):
                    words = line.encode("utf-8", "surrogatepass").lower().split()
                    if len(words) >= edit_words:
                        at.append(i)
                        rows.append((no, b" ".join(words)))
                        keys.append(half_keys(words))
            kept = np.flatnonzero(bloom_holds(bloom.value, np.array(keys, np.uint64).reshape(-1, 4).view(np.int64), bits).any(axis=1))
            yield pd.DataFrame({
                "key": pdf["key"].to_numpy()[np.array(at, int)[kept]], "line_no": [rows[r][0] for r in kept], "line": [rows[r][1] for r in kept],
                "h": np.array([xxhash.xxh64_intdigest(rows[r][1]) for r in kept], np.uint64).view(np.int64),
            })

    # One copy of each candidate's text, from its first place, numbered in order of these places.
    found = whole.mapInPandas(candidates, "key long, line_no long, line binary, h long")
    spots = first.select("h", F.col("place.key").alias("key"), F.col("place.line_no").alias("line_no"), "place")
    texts = found.join(spots, ["h", "key", "line_no"]).dropDuplicates(["h"])
    texts = materialise(texts.orderBy("place", "h").select(F.monotonically_increasing_id().alias("o"), "h", "line"))
    v = materialise(texts.select("o", "line").mapInPandas(_variants, "o long, variant long, m int, pos int"))
    # Most variants stand alone: only those that lines share go on.
    sides = v.groupBy("variant", "m").agg(
        F.min(F.when(F.col("pos") == 0, F.col("o"))).alias("w"), F.min(F.when(F.col("pos") > 0, F.col("o"))).alias("d"), F.count("*").alias("n")
    )
    v = materialise(v.join(sides.where("n > 1").drop("n"), ["variant", "m"]))
    replaced = v.where("pos > 0").groupBy("variant", "m", "pos").agg(F.min("o").alias("e"), F.max("o").alias("f")).where("e < f").drop("f")
    by_replaced = v.join(replaced, ["variant", "m", "pos"]).select("o", "e")
    by_deleted = v.where("w is not null and d is not null").select("o", F.when(F.col("pos") == 0, F.col("d")).otherwise(F.col("w")).alias("e"))
    edits = by_replaced.unionByName(by_deleted).where("e < o").groupBy("o").agg(F.min("e").alias("e"))
    earlier = texts.select(F.col("o").alias("e"), F.col("line").alias("line2"))
    near = edits.join(texts, "o").join(earlier, "e").select("h", "line", "line2").mapInPandas(_verify, "h long")
    keep = first.join(near.withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near")
    keep = keep.select("h", F.when(F.col("near").isNull(), F.col("place")).alias("only"))
    return places.select("key", "line_no", "h", order.alias("place")).join(keep, "h").where("only is null or place <> only").select("key", "line_no")


def deduplicate(docs: DataFrame, min_words: int = 5, edit_words: int = 10, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of text (see :func:`repeated_lines`), and ``counts``: its lines, and those dropped.

    Other columns stay as they are (n_chars is not recounted here), but for clashes with those two, which are replaced. A null text stays null,
    with no lines. Texts that lose all their words become empty; no row goes.
    """
    key, gone = free_name(docs, "line_key"), free_name(docs, "line_gone")
    lines = repeated_lines(docs, min_words, edit_words).groupBy("key").agg(F.collect_set("line_no").alias(gone)).withColumnRenamed("key", key)
    out = docs.withColumn(key, row_key()).join(lines, key, "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col(gone), i))
    return (
        out.withColumn(counts[0], F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
        .withColumn(counts[1], F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(gone, key)
    )
