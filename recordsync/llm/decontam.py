"""Benchmark decontamination: rare n-gram seeds join documents to test items, then local alignment.

An alignment of m matches and e edits has at most e + 1 runs of matches, so it keeps m - e - 1 or more of the
item's word pairs: its score less one. An item of n words that scores s or more thus misses at most n - s of its
n - 1 pairs, so of any n - s + t of them, here the rarest by document frequency, the document has t or more: the
seeds. Documents and items that share so many seeds, found by a join, and with s - 1 pairs within reach of one another
are aligned by Smith-Waterman. This loses no document, however common its pairs are and whether or not the others occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import bloom_bits, bloom_filter, bloom_holds, free_name, map_frames, materialise, words_of

#: Items of fewer words match nothing. Seeds that a document has to share with an item, where the item has as many.
LEAST_WORDS, SHARED_SEEDS = 3, 3


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    return np.array([*map(xxhash.xxh64_intdigest, words_of(text))], np.uint64)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words, given by their hashes."""
    x = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def held_pairs(texts: list[str | None], data: np.ndarray, bits: int) -> list[np.ndarray]:
    """The different word pairs of each text that a Bloom filter holds, or seems to; texts are taken together, some at a time."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 256):
        words = [words_of(t) for t in texts[at : at + 256]]
        hashes = np.array([h for w in words for h in map(xxhash.xxh64_intdigest, w)], np.uint64)
        ends = np.cumsum([len(w) for w in words])
        pairs = pair_hashes(hashes)
        held = bloom_holds(data, pairs, bits)
        held[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(hashes))] - 1] = False  # pairs over the end of a text
        hit = np.flatnonzero(held)
        cuts = np.searchsorted(hit, ends)
        out += [np.unique(p) for p in np.split(pairs[hit], cuts[:-1])]
    return out


def _least(n: int, threshold: float) -> int:
    """The least score that counts for an item of ``n`` words. It is 2 at least, so that a word pair is kept."""
    return max(2, math.ceil(threshold * n - 1e-9))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (match 1, mismatch and gap -1) and the end of that alignment in ``passage``."""
    steps = np.arange(1, len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        t = np.maximum(row[1:] - 1, row[:-1] + np.where(passage == w, 1, -1))
        t = np.maximum.accumulate(np.maximum(t, 0) + steps) - steps
        row[1:] = t
        j = int(t.argmax())
        if t[j] > best:
            best, end = int(t[j]), j + 1
    return best, end


def leak(item: np.ndarray, words: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """``(score, first word, last word)`` where the words of a document, given by hashes, hold ``item``, else None."""
    n, least = len(item), _least(len(item), threshold)
    pairs, times = np.unique(pair_hashes(item), return_counts=True)
    there = pair_hashes(words)
    k = np.minimum(np.searchsorted(pairs, there), len(pairs) - 1)
    hit = np.flatnonzero(pairs[k] == there)
    # A word pair that stands twice in the item counts twice at each of its places in the document.
    places = np.repeat(hit, times[k[hit]])
    if len(places) < least - 1:
        return None
    # An alignment has at most n - least words put in, so all of it lies within ``reach`` words.
    reach = 2 * n - least
    dense = places[: len(places) - least + 2][places[least - 2 :] - places[: len(places) - least + 2] < reach]
    if not len(dense):
        return None
    best = (0, 0, 0)
    for part in np.split(dense, np.flatnonzero(np.diff(dense) > 2 * reach) + 1):
        low = max(0, int(part[0]) - reach)
        score, end = align(item, words[low : int(part[-1]) + reach])
        if score > best[0]:
            best = (score, low, end)
    score, low, end = best
    if score < least:
        return None
    back = words[max(low, low + end - reach) : low + end][::-1]
    return score / n, low + end - align(item[::-1], back)[1], low + end - 1


def _pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [word_hashes(t) for t in pdf["text"]]
        pdf = pdf.assign(n=[len(w) for w in words], pairs=[pair_hashes(w) if len(w) >= LEAST_WORDS else np.empty(0, np.int64) for w in words])
        yield pdf[["item_key", "item_id", "text", "n", "pairs"]]


def _frequencies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pair, df)``: in how many rows of ``docs`` each of ``pairs`` stands, for those that stand in any, and for some others."""
    bits = bloom_bits(pairs)
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(pairs, bits))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = held_pairs(pdf["text"].tolist(), shared.value, bits)
            pair, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pd.DataFrame({"pair": pair, "n": n})

    return docs.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("df"))


def _seeds(items: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """``(pair, item_key, weight, needed)``: an item's rarest pairs, how often it has each, and how many a document must share."""
    each = materialise(items.where(F.size("pairs") > 0).select("item_key", "n", F.explode("pairs").alias("pair")))
    df = _frequencies(docs, each.select("pair").distinct())
    least = F.greatest(F.lit(2), F.ceil(threshold * F.col("n") - F.lit(1e-9)))
    needed = F.least(F.lit(SHARED_SEEDS), least - 1)
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy(F.coalesce("df", F.lit(0)), "pair"))
    rare = each.join(df, "pair", "left").withColumn("needed", needed).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - least + F.col("needed"))
    return rare.groupBy("item_key", "pair").agg(F.count("*").alias("weight"), F.first("needed").alias("needed"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, text_key, item_id, score, first_word, last_word)``: each document and test item that it holds.

    score: alignment score by the item's words, 1 for a whole copy; pairs below ``threshold``, or with a score of one
    word, are not returned, all others are. Words are counted from 0 and told apart by 64-bit hashes. ``docs`` are read
    twice, whatever the benchmark's size: what travels to the workers is Bloom filters of word pairs, 32 MB at
    most, and what they let through besides is joined away. Null and empty texts and items match nothing; items under
    three words neither. Items are told apart by item_id and text; repeated documents give repeated rows. Other columns are
    not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = materialise(map_frames(items.withColumn("item_key", F.xxhash64("item_id", "text")), _pairs_of, "item_key long, item_id long, text string, n int, pairs array<long>"))
    seeds = materialise(_seeds(items, texts, threshold))
    bits = bloom_bits(seeds.select("pair"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(seeds.select("pair"), bits))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = held_pairs(pdf["text"].tolist(), shared.value, bits)
            yield pdf.assign(pairs=found)[[len(p) > 0 for p in found]]

    some = texts.where("text is not null").withColumn("key", F.xxhash64("doc_id", "text_key"))
    some = materialise(map_frames(some, find, "doc_id long, text_key long, text string, key long, pairs array<long>"))
    # Repeated documents only make the sums larger.
    votes = some.select("key", F.explode("pairs").alias("pair")).join(seeds, "pair").groupBy("key", "item_key").agg(F.sum("weight").alias("got"), F.first("needed").alias("needed"))
    candidates = votes.where("got >= needed").select("key", "item_key").join(items.select("item_key", "item_id", F.col("text").alias("item")), "item_key")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, words, known = None, np.empty(0, np.uint64), {}
        for pdf in batches:
            out = []
            for key, doc_id, text_key, text, item_key, item_id, item in pdf.itertuples(index=False):
                if key != last:
                    last, words = key, word_hashes(text)
                if item_key not in known:
                    known = known if len(known) < 10_000 else {}
                    known[item_key] = word_hashes(item)
                if got := leak(known[item_key], words, threshold):
                    out.append((doc_id, text_key, item_id, *got))
            names = ["doc_id", "text_key", "item_id", "score", "first_word", "last_word"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

    both = some.drop("pairs").join(candidates, "key").select("key", "doc_id", "text_key", "text", "item_key", "item_id", "item")
    return map_frames(both, score, "doc_id long, text_key long, item_id long, score double, first_word long, last_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents into which an item of ``benchmark`` leaks; all columns stay, whatever their names."""
    key = free_name(docs, "leak")
    bad = leaks(docs, benchmark, threshold).select(F.xxhash64("doc_id", "text_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return keyed.join(bad, key, "left_anti").drop(key)
