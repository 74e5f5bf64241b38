"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsync.llm._common import map_frames
from recordsync.llm.textstats import N_STATS, stats


@dataclass
class Ranking:
    """Weights of the score of a document, and the score that parts the two labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; 0.5 lies at the threshold."""
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights - self.threshold, -60, 60)))


def fit_pairs(x: np.ndarray, y: np.ndarray, max_pairs: int = 100_000, l2: float = 1.0, seed: int = 5) -> Ranking:
    """Learn from preference pairs (a row of label 1 over a row of label 0) by logistic loss on differences.

    At most ``max_pairs`` pairs are drawn. The threshold is the quantile of the rows' scores, out of
    a fixed grid of 199 and the share of label 0, that parts the labels best. With one label only, all
    rows fall on its side.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(x.shape[1]), -1.0 if len(good) else 1.0)
    rng = np.random.default_rng(seed)
    z = (x - mean) / scale
    d = z[rng.choice(good, max_pairs)] - z[rng.choice(bad, max_pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + (l2 + 1e-9) * np.eye(len(w)), d.T @ (1 - p) - l2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    grid = np.quantile(s, [*np.linspace(0.005, 0.995, 199), (y == 0).mean()])
    right = [np.mean((s >= t) == (y == 1)) for t in grid]
    best = np.flatnonzero(np.isclose(right, max(right)))
    return Ranking(mean, scale, w, float(grid[best[len(best) // 2]]))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "y": pdf["y"], "x": [stats(t) for t in pdf["text"]]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 20_000, max_pairs: int = 100_000) -> Ranking | None:
    """Fit on at most ``max_train`` rows of ``labels`` (doc_id and a 0/1 ``label``), those of the least hash of doc_id.

    Null ids and labels are left out; of several labels for one id the greatest counts, of several texts that of the least hash. None where no row is left.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
        .groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    # At most max_train small rows: a bounded broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    each = rows.mapInPandas(_features, "doc_id long, h long, y int, x array<double>")
    # Of several texts with one id, that of the least hash.
    got = each.groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), "h").alias("r")).select("doc_id", "r.*").toArrow().to_pandas()
    if got.empty:
        return None
    got = got.sort_values("doc_id")
    return fit_pairs(np.array(got["x"].tolist()).reshape(-1, N_STATS), got["y"].to_numpy(), max_pairs)


def rank(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row of ``docs``; 0.5 and 1 without a ranking.

    Only the whole text counts, however long; a null one is empty. Repeated rows are scored alike; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)  # a few hundred numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            x = np.array([stats(t) for t in pdf["text"]]).reshape(-1, N_STATS)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    return map_frames(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")
