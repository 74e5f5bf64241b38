"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are summed over all training documents by hash, each share of the
hashes in a task of its own. A count becomes a level on a logarithmic scale; a gram of level q is
entered into the filter q times, once with each number from 1 to q. Its level is read back by probing
1, 2, 3, ... until a probe fails, so what is stored is never read as less than it was. The filters are sized by what
was counted, to be a quarter full at most. A filter of pairs that is too large for a task is cut into slices by hash. Texts are read once
whatever their number: a task takes half a million tokens at a time through all slices, one after another. Probabilities mix pair
and word estimates.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import materialise, row_key

#: Hash of what no word can be: the end of a text, and what stands before its first word.
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")
_BASE, _PROBES, _FLUSH, _LEVELS = 1.5, 2, 1_000_000, 64


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text (A-Z lower-cased, cut at ASCII white space) and of its end."""
    h = xxhash.xxh64_intdigest
    return np.array([*map(h, (text or "").encode("utf-8", "surrogatepass").lower().split()), END], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word together with the word before it."""
    before = np.concatenate([[np.uint64(START)], words[:-1]])
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, then 1 and one more for each factor of 1.5."""
    return np.where(counts < 1, 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(_BASE) + 1e-9)).astype(np.int64)


def _count_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level, 0 for level 0."""
    return np.where(levels == 0, 0.0, _BASE ** (levels - 1))


def _bits(grams: np.ndarray, j: int, shares: int, bits: int) -> list[np.ndarray]:
    """Positions of the ``j``-th entry of each gram: within the part of the filter of the gram's share."""
    part = bits - shares
    top = (grams >> np.uint64(64 - shares)) << np.uint64(part)
    out = []
    for k in range(_PROBES):
        x = _mix(grams + np.uint64((j * _PROBES + k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out.append((top | (x >> np.uint64(64 - part))).astype(np.int64))
    return out


def enter(grams: np.ndarray, levels: np.ndarray, shares: int, bits: int) -> np.ndarray:
    """The filter's bytes for ``grams``, all of one share: its part of the whole filter."""
    part = bits - shares
    filled = np.zeros(1 << part, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for at in _bits(grams[levels >= j], j, shares, bits):
            filled[at & ((1 << part) - 1)] = True
    return np.packbits(filled, bitorder="little")


def probe(grams: np.ndarray, data: np.ndarray, shares: int, bits: int, slices: int = 0) -> np.ndarray:
    """Level of each gram: the number of successive probes that hit. ``data`` is one of 2^``slices`` slices, and ``grams`` are all of it."""
    out, left, j = np.zeros(len(grams), np.int64), np.arange(len(grams)), 0
    inside = (1 << bits - slices) - 1
    while len(left) and j < _LEVELS - 1:
        j += 1
        hit = np.ones(len(left), bool)
        for at in _bits(grams[left], j, shares, bits):
            at &= inside
            hit &= (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        left = left[hit]
        out[left] = j
    return out


@dataclass
class Model:
    """The word filter, sizes of both filters, the number of training tokens and of different ones, exact counts of the most
    frequent, and the weight of pairs by level of the word before. The pairs' filter comes in slices, by the first bits of a pair.
    """

    words: np.ndarray
    shares: int
    bits: dict[int, int]
    slices: int
    n: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    mixing: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Additively smoothed log10 probability of a token by its count."""
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.distinct + 1)))

    def levels(self, texts: list[np.ndarray], slices: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each token of all texts: its text, and levels of the pair, the word before and the word. ``slices``: those of the pairs' filter, in order."""
        of = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        word, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        alone = probe(word, self.words, self.shares, self.bits[1])[inverse]
        ends = np.cumsum([len(w) for w in texts])
        before = np.arange(-1, len(inverse) - 1)
        before[np.concatenate([[0], ends[:-1]])] = ends - 1  # a text starts as often as it ends
        pair, place = np.unique(np.concatenate([pairs(w) for w in texts]), return_inverse=True)
        # Slices go by the first bits of a pair, so each has a run of the sorted pairs.
        cuts = np.searchsorted(pair, np.arange(1, 1 << self.slices, dtype=np.uint64) << np.uint64(64 - self.slices)) if self.slices else []
        both = np.concatenate([probe(mine, data, self.shares, self.bits[2], self.slices) for mine, data in zip(np.split(pair, cuts), slices, strict=True)])
        return of, both[place], alone[before], alone

    def scores(self, texts: list[np.ndarray], slices: Iterable[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text, from probes alone. It is never above 0."""
        of, both, ahead, alone = self.levels(texts, slices)
        share = self.mixing[ahead]
        p = share * _ratio(both, ahead, 0) + (1 - share) * self.alone(alone)
        return np.bincount(of, np.log10(p), len(texts))

    def alone(self, levels: np.ndarray) -> np.ndarray:
        """Smoothed share of a word by its level, 1 at most."""
        return np.minimum(1, (_count_of(levels) + 0.1) / (self.n + 0.1 * (self.distinct + 1)))


def _ratio(both: np.ndarray, ahead: np.ndarray, less: int) -> np.ndarray:
    """Share of a pair among what follows its first word, by their levels, with ``less`` of its occurrences left out; 1 at most."""
    pair, first = _count_of(both), _count_of(ahead)
    return np.maximum(0, pair - less) / np.maximum(np.maximum(first, pair) - less, 1)


def tune(model: Model, cells: np.ndarray, n: np.ndarray, rounds: int = 20) -> None:
    """Set the weight of pairs by level of the word before, with each pair left out once (EM).

    cells: levels of pair, word before and word (rows of three); n: how many training tokens have them.
    """
    both, ahead, alone = cells.T
    pair, word = _ratio(both, ahead, 1), model.alone(alone)
    total = np.bincount(ahead, n, _LEVELS)
    for _ in range(rounds):
        share = model.mixing[ahead]
        mine = n * share * pair / (share * pair + (1 - share) * word)
        model.mixing = np.where(total > 0, np.bincount(ahead, mine, _LEVELS) / np.maximum(total, 1), model.mixing)
    model.mixing = np.minimum(model.mixing, 0.99)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to 256 rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _tokenised(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows in order, some at a time, with the tokens of their texts: as many rows of a batch as have ``size`` tokens, or 256 where ``size`` is 0."""
    for batch in batches:
        first, held, have = 0, [], 0
        for piece in _some([batch]):
            for text in piece.column("text").to_pylist():
                held.append(tokens(text))
                have += len(held[-1])
                if have >= size > 0:
                    yield batch.slice(first, len(held)), held
                    first, held, have = first + len(held), [], 0
            if held and not size:
                yield batch.slice(first, len(held)), held
                first, held, have = first + len(held), [], 0
        if held:
            yield batch.slice(first, len(held)), held


def _counter(shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _some(batches):
            for text in batch.column("text").to_pylist():
                held.append(tokens(text))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield _summed(held, shares)
                    held, size = [], 0
        if held:
            yield _summed(held, shares)

    return run


def _summed(held: list[np.ndarray], shares: int) -> pa.RecordBatch:
    rows = []
    for order in (1, 2):
        grams, n = np.unique(np.concatenate([w if order == 1 else pairs(w) for w in held]), return_counts=True)
        cuts = np.searchsorted(grams, np.arange(1, 1 << shares, dtype=np.uint64) << np.uint64(64 - shares))
        for share, (g, c) in enumerate(zip(np.split(grams, cuts), np.split(n, cuts), strict=True)):
            if len(g):
                rows.append((order, share, g.tobytes(), c.astype(np.uint32).tobytes()))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["order", "share", "grams", "counts"])


def _join(key: tuple[int, int], pdf: pd.DataFrame) -> pd.DataFrame:
    """All counts of one share (levels alone for pairs), and how many entries they make."""
    grams = np.concatenate([np.frombuffer(g, np.uint64) for g in pdf["grams"]])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]).astype(np.int64)
    at = np.argsort(grams, kind="stable")
    grams, first = np.unique(grams[at], return_index=True)
    counts = np.add.reduceat(counts[at], first)
    levels = level(counts)
    return pd.DataFrame({
        "order": [int(key[0])], "share": [int(key[1])], "n": [counts.sum()], "distinct": [len(grams)], "entries": [levels.sum()],
        "grams": [grams.tobytes()], "counts": [counts.tobytes() if key[0] == 1 else levels.astype(np.uint8).tobytes()],
    })


def _enter_all(shares: int, bits: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for order, share, grams, counts in pdf.itertuples(index=False):
                levels = level(np.frombuffer(counts, np.int64)) if order == 1 else np.frombuffer(counts, np.uint8)
                part = enter(np.frombuffer(grams, np.uint64), levels, shares, bits[order])
                yield pd.DataFrame({"order": [order], "share": [share], "part": [part.tobytes()]})

    return run


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for g, c in zip(pdf["grams"], pdf["counts"], strict=True):
            yield pd.DataFrame({"token": np.frombuffer(g, np.int64), "c": np.frombuffer(c, np.int64)})


def _filter(parts: DataFrame, order: int, shares: int, bits: int, slices: int = 0, number: int = 0) -> np.ndarray:
    """One of 2^``slices`` slices of a filter, put together from its parts."""
    out = np.zeros(1 << bits - slices - 3, np.uint8)
    first, end = number << shares - slices, number + 1 << shares - slices
    rows = parts.where((F.col("order") == order) & (F.col("share") >= first) & (F.col("share") < end))
    for r in rows.select("share", "part").toLocalIterator():
        at = (r["share"] - first) * len(r["part"])
        out[at : at + len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return out


@dataclass
class PairFilter:
    """The slices of the pairs' filter in tasks: a single one is broadcast; several are files that an executor fetches once and its workers map, one at a time."""

    whole: Broadcast | None
    files: list[str]

    @classmethod
    def of(cls, context: SparkContext, slices: Iterable[np.ndarray], several: bool) -> PairFilter:
        if not several:
            return cls(context.broadcast(next(iter(slices)).tobytes()), [])  # bytes are read without a copy
        files = []
        for data in slices:
            files.append(f"pairs-{uuid.uuid4().hex}")
            path = f"{SparkFiles.getRootDirectory()}/{files[-1]}"  # it goes with the session
            data.tofile(path)
            context.addFile(path)
        return cls(None, files)

    def slices(self) -> Iterator[np.ndarray]:
        if self.whole is not None:
            yield np.frombuffer(self.whole.value, np.uint8)
        for name in self.files:
            yield np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r"))


@dataclass
class Trained:
    """A model, the exact count of each token (token, c), the parts of the filters, and the pairs' filter as tasks get it."""

    model: Model
    counts: DataFrame
    parts: DataFrame
    pairs: PairFilter | None = None

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """The slices of the pairs' filter, one after another."""
        m = self.model
        for number in range(1 << m.slices):
            yield number, _filter(self.parts, 2, m.shares, m.bits[2], m.slices, number)


def train(docs: DataFrame, head: int = 100_000, fill: float = 0.25, slice_bits: int = 29) -> Trained:
    """A model of the whole texts of ``docs``.

    Filters take the least power of two of bits that leaves them at most ``fill`` full: two probes then let one in sixteen of the
    grams that were never seen pass as seen once. What a task holds of the filter of pairs has at most 2^``slice_bits`` bits (64 MB); a larger
    one is cut into slices, and a word filter of more than four times that size raises a ValueError. At
    most ``head`` exact counts go to the driver besides. Weights of pairs come from all training tokens, tallied by their
    levels. Texts are read twice, to count and to tally, however many slices there are. The corpus is counted in shares, four or more for each partition of ``docs``. Null and empty
    texts consist of their end.
    """
    spark = docs.sparkSession
    shares = max(4, int(np.ceil(np.log2(4 * max(1, docs.select("text").rdd.getNumPartitions())))))
    texts = docs.select(F.col("text").cast("string"))
    counted = texts.mapInArrow(_counter(shares), "order int, share int, grams binary, counts binary")
    merged = materialise(
        counted.groupBy("order", "share").applyInPandas(_join, "order int, share int, n long, distinct long, entries long, grams binary, counts binary")
    )
    sums = {r["order"]: r for r in merged.groupBy("order").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"), F.sum("entries").alias("entries")).collect()}
    need = {k: _PROBES * (sums[k]["entries"] if k in sums else 1) / -np.log(1 - fill) for k in (1, 2)}
    bits = {k: max(shares + 6, int(np.ceil(np.log2(max(2, v))))) for k, v in need.items()}
    if bits[1] > slice_bits + 2:
        raise ValueError(f"the word filter takes 2^{bits[1]} bits; raise slice_bits or fill")
    slices = min(shares, max(0, bits[2] - slice_bits))
    parts = materialise(merged.select("order", "share", "grams", "counts").mapInPandas(_enter_all(shares, bits), "order int, share int, part binary"))
    counts = materialise(merged.where("`order` = 1").select("grams", "counts").mapInPandas(_counts, "token long, c long"))
    top = counts.orderBy(F.desc("c"), "token").limit(head).toArrow()
    heads = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    at = np.argsort(heads)
    n, distinct = (sums[1]["n"], sums[1]["distinct"]) if 1 in sums else (0, 0)
    words = _filter(parts, 1, shares, bits[1])
    model = Model(words, shares, bits, slices, n, distinct, heads[at], top["c"].to_numpy().astype(np.int64)[at], np.full(_LEVELS, 0.1))
    trained, context = Trained(model, counts, parts), spark.sparkContext
    trained.pairs = pair_filter = PairFilter.of(context, (data for _, data in trained.slices()), model.slices > 0)
    shared, size = context.broadcast(model), _size(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_LEVELS**3, np.int64)
        for _, some in _tokenised(batches, size):
            _, both, ahead, alone = shared.value.levels(some, pair_filter.slices())
            cell, n = np.unique((both * _LEVELS + ahead) * _LEVELS + alone, return_counts=True)
            seen[cell] += n
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], ["cell", "n"])

    # A bounded number of rows: one for each three levels.
    tallies = {r["cell"]: r["n"] for r in texts.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    cells = np.array(sorted(tallies), np.int64)
    tune(model, np.stack([cells // _LEVELS**2, cells // _LEVELS % _LEVELS, cells % _LEVELS], axis=1), np.array([tallies[c] for c in cells.tolist()], float))
    return trained


def _size(model: Model) -> int:
    """Tokens that go through the slices together: few texts at a time with one slice, with more so many that turning to these is a small part of the work."""
    return _FLUSH // 2 if model.slices else 0


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs`` (doc_id, text).

    base_score: exact additive smoothing. Counts of frequent tokens are broadcast, a fixed number; each
    text's other tokens are joined to all counts. score: the model's log10 probability, never above 0. Null and empty texts
    have one token, their end. Repeated rows stay repeated; rows with null ids are scored like others.
    """
    model, counts, context = trained.model, trained.counts, docs.sparkSession.sparkContext
    shared, pair_filter, size = context.broadcast(model), trained.pairs, _size(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_head = m.base(m.head_counts)
        for batch, texts in _tokenised(batches, size):
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id")
            score, zero = m.scores(texts, pair_filter.slices()), np.zeros(len(texts), np.int64)
            rows, rare = [], []
            for i, words in enumerate(texts):
                word, times = np.unique(words, return_counts=True)
                place = np.minimum(np.searchsorted(m.head, word), max(0, len(m.head) - 1))
                known = m.head[place] == word if len(m.head) else np.zeros(len(word), bool)
                rows.append((len(words), times[known].sum(), (times[known] * log_head[place[known]]).sum()))
                rare.append((np.full((~known).sum(), i), word[~known].view(np.int64), times[~known]))
            n_tokens, n_known, base = zip(*rows, strict=True)
            yield _told(ids, keys, np.array(n_tokens), np.array(n_known), np.array(base), score, keys, zero, zero + 1)
            i, token, tf = (np.concatenate(x) for x in zip(*rare, strict=True))
            zero = np.zeros(len(i), np.int64)
            yield _told(ids.take(pa.array(i)), keys[i], zero, zero, zero * 0.0, zero * 0.0, token, tf, zero)

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.col("text").cast("string"))
    schema = "doc_id long, key long, n_tokens long, n_known long, base_score double, score double, token long, tf long, rows long"
    found = rows.mapInArrow(run, schema)
    c = F.coalesce("c", F.lit(0))
    below = model.n + 0.1 * (model.distinct + 1)
    joined = found.join(counts, (found["token"] == counts["token"]) & (found["tf"] > 0), "left")
    per = joined.groupBy("doc_id", "key").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.col("tf") * F.log10((c + 0.1) / F.lit(below))).alias("base_score"),
    )
    one = per.select("doc_id", "rows", *((F.col(x) / F.col("rows")).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    each = one.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def _told(ids: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["doc_id", "key", "n_tokens", "n_known", "base_score", "score", "token", "tf", "rows"]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names)
