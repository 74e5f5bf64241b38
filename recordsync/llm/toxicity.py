"""Toxicity categories by a classifier chain.

Categories are predicted one after another. Each has a linear model over surface statistics, the
strongest words under a smoothed log-ratio lexicon, and the probabilities of the categories before it.
Lexicon features and earlier probabilities of the training rows are out of fold: each row's come
from models that have not seen it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import words_of
from recordsync.llm.textstats import N_STATS, stats

#: Slots of a hashed lexicon, and the features of a word: itself and its first 4, 5 and 6 bytes.
SLOTS = 1 << 20
PREFIXES = (4, 5, 6)
_TOP = 5


def word_slots(word: bytes) -> tuple[int, ...]:
    """Lexicon slots of a word and its beginnings."""
    own = zlib.crc32(word) % SLOTS
    return (own, *((zlib.crc32(word[:k], k) % SLOTS) if len(word) > k else own for k in PREFIXES))


def _top_features(scores: np.ndarray) -> np.ndarray:
    """Features of a document from the lexicon scores of its distinct words."""
    out = np.zeros(_TOP + 3)
    if len(scores):
        best = np.sort(np.partition(scores, -_TOP)[-_TOP:] if len(scores) > _TOP else scores)[::-1]
        out[: len(best)] = best
        out[_TOP:] = np.log1p((scores > 1).sum()), np.log1p((scores > 2).sum()), np.log1p(len(scores)) / 10
    return out


@dataclass
class Chain:
    """Fitted categories in order: a lexicon, means, scales and weights (the last is the constant) for each."""

    names: list[str]
    lexicons: list[np.ndarray]
    models: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights of an L2-penalised logistic regression (Newton steps)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([_standard(x, mean, scale), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores, cut at 3, so that rows unlike all training rows are not pushed far out."""
    return np.clip((x - mean) / scale, -3, 3)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def _probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return _sigmoid(_standard(x, mean, scale) @ w[:-1] + w[-1])


def _lexicon(slots: list[np.ndarray], y: np.ndarray, rows: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """Log ratio of document frequencies with the category and without, shrunk to 0 for rare slots."""
    seen = np.zeros((2, SLOTS), np.int32)
    for i in rows:
        seen[int(y[i]), np.unique(slots[i])] += 1
    n = [max(1, int((y[rows] == c).sum())) for c in (0, 1)]
    out = np.empty(SLOTS, np.float32)
    # Some slots at a time: the driver holds few numbers in double precision.
    for at in range(0, SLOTS, 1 << 16):
        rate = [(seen[c, at : at + (1 << 16)] + strength * n[c] / (n[0] + n[1])) / n[c] for c in (0, 1)]
        out[at : at + (1 << 16)] = np.log(rate[1] / rate[0])
    return out


def fit_rows(names: list[str], y: np.ndarray, dense: np.ndarray, slots: list[np.ndarray], folds: int = 5, seed: int = 11) -> Chain:
    """A chain from rows held in memory: labels (rows x categories), statistics and word slots of each row."""
    n = len(y)
    fold = np.random.default_rng(seed).permutation(n) % folds
    chain = Chain(list(names), [], [])
    earlier = np.empty((n, 0))
    every = np.arange(n)
    for k in range(len(names)):
        top = np.zeros((n, _TOP + 3))
        for f in range(folds):
            lexicon = _lexicon(slots, y[:, k], every[fold != f])
            for i in every[fold == f]:
                top[i] = _top_features(lexicon[slots[i]].max(axis=1) if len(slots[i]) else np.empty(0))
        x = np.hstack([dense, top, earlier])
        out_of_fold = np.zeros(n)
        for f in range(folds):
            if (fold == f).any() and (fold != f).any():
                out_of_fold[fold == f] = _probability(_logistic(x[fold != f], y[fold != f, k]), x[fold == f])
        chain.lexicons.append(_lexicon(slots, y[:, k], every))
        chain.models.append(_logistic(x, y[:, k]))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def _slots_of(text: str | None) -> np.ndarray:
    words = set(words_of(text))
    return np.array([word_slots(w) for w in words], np.int32).reshape(-1, 1 + len(PREFIXES))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], max_train: int = 12_000, folds: int = 5) -> Chain | None:
    """Fit a chain on at most ``max_train`` labelled documents, those of the least hash of doc_id.

    categories: name to boolean column over ``labels``, in the order of the chain. Rows of ``labels`` with a
    null id or category are left out, and of rows with one id the greatest counts; of several texts with one id, that of
    the least hash. Whole texts count: the driver gets four numbers for each different word of each. None where no row is left.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.array(*(c.cast("int") for c in categories.values())).alias("y"))
        .where("_id is not null and not exists(y, v -> v is null)")
        .groupBy("_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "h": pdf["h"], "y": pdf["y"], "dense": [stats(t) for t in pdf["text"]],
                "slots": [_slots_of(t).tobytes() for t in pdf["text"]],
            })

    # At most max_train small rows: a bounded broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    each = rows.mapInPandas(features, "doc_id long, h long, y array<int>, dense array<double>, slots binary")
    # Of several texts with one id, that of the least hash.
    got = each.groupBy("doc_id").agg(F.min_by(F.struct("y", "dense", "slots"), "h").alias("r")).select("doc_id", "r.*").toArrow()
    if not len(got):
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    # Views into what Arrow holds, which has one copy of them.
    views = [np.frombuffer(s.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for s in got["slots"]]
    y = np.array(got["y"].to_pylist())[order]
    dense = got["dense"].combine_chunks().flatten().to_numpy().reshape(-1, N_STATS)[order]
    return fit_rows(list(categories), y, dense, [views[i] for i in order], folds)


def score(docs: DataFrame, chain: Chain | None, prefix: str = "p_", names: list[str] | None = None) -> DataFrame:
    """``docs`` and a probability column for each category of ``chain``.

    Whole texts count; a null text is scored as an empty one. Without a chain the probabilities of ``names`` are null. Rows
    are scored on their own, so repeated rows and null ids change nothing; columns of ``docs`` that have
    the name of a probability are replaced.
    """
    if chain is None:
        return docs.withColumns({f"{prefix}{n}": F.lit(None).cast("double") for n in names or []})
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a fixed number of slots
    added = [f"{prefix}{n}" for n in chain.names]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{a}` double" for a in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns of the caller pass through as they are.
        model = shared.value
        cache: dict[bytes, int] = {}
        table = np.empty((0, len(model.names)), np.float32)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = part["text"].to_pylist()
                if len(cache) > 300_000:
                    cache, table = {}, table[:0]
                sets = [list(set(words_of(t))) for t in texts]
                new = list({w for words in sets for w in words if w not in cache})
                if new:
                    slots = np.array([word_slots(w) for w in new])
                    table = np.vstack([table, np.stack([lex[slots].max(axis=1) for lex in model.lexicons], axis=1)])
                    cache.update(zip(new, range(len(cache), len(cache) + len(new))))  # noqa: B905
                p = np.zeros((len(texts), len(model.names)))
                dense = np.array([stats(t) for t in texts]).reshape(-1, N_STATS)
                found = [table[[cache[w] for w in words]] if words else table[:0] for words in sets]
                for k in range(len(model.names)):
                    top = np.array([_top_features(x[:, k]) for x in found]).reshape(-1, _TOP + 3)
                    p[:, k] = _probability(model.models[k], np.hstack([dense, top, p[:, :k]]))
                columns = [part[f.name] for f in kept] + [pa.array(p[:, k]) for k in range(len(added))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *added])

    return docs.mapInArrow(run, schema)


def toxic_scores(docs: DataFrame, documents: DataFrame, labels: DataFrame, max_train: int = 12_000, prefix: str = "p_") -> DataFrame:
    """``docs`` with p_low_quality and p_toxic, from a chain fitted on the labelled rows of ``documents``; null where none is labelled."""
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return score(docs, fit(documents, labels, categories, max_train), prefix, list(categories))
