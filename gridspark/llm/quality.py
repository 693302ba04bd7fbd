"""Quality scores learned by Bradley-Terry ranking.

Each text becomes a short vector of surface features. Pairs of a preferred and a rejected document give feature
differences d, and the weights w maximise the sum of log sigmoid(w . d): a document is preferred in proportion to
exp(w . x). The cut between keeping and rejecting is a quantile of the scores of the training documents.

All pairs of all labelled documents count. The chance of a pair depends on its two margins w . x alone, so each Newton
step adds up counts, features and their products by bins of the margin, and pairs bins instead of documents: the work of
a step grows with the documents, and the driver sees no more than the bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import exact_percentiles
from .columns import computed, shared_table

# Bins of the margin: documents of one bin are paired at their mean margin, and the outer bins are open.
STEPS, BINS = 16, 1024
CUT = 0.3  # the score that stands for the quantile
_FEATURES = 14


def features(text: str | None) -> np.ndarray:
    """Surface features of a whole text; NULL reads as empty, and empty gives zeros."""
    out = np.zeros(_FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(text)
    upper = int(seen[65:91].sum())
    lower = int(seen[97:123].sum())
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    stops = int(seen[44] + seen[46])
    lines = text.split("\n")
    if n:
        distinct = len(set(words))
        runs = sum(map(str.__eq__, words, words[1:]))
        out[:] = (
            upper / (upper + lower + 1), seen[33] / n, seen[124] / n, (seen[35:39].sum() + seen[42]) / n,
            marks / size, stops / n, runs / n, np.log(distinct) / np.log(n + 1), distinct / n,
            size / n / 10, seen[48:58].sum() / size, 1 - len(set(lines)) / len(lines), np.log(n + 1) / 10,
            min(1.0, 8 * (seen[33] + seen[124] + seen[35:39].sum() + seen[42]) / n))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score from 0 to 1 of feature rows; CUT stands exactly at the quantile of the training scores."""
        margin = ((x - self.mean) / self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -500, 500)))


def _binned(table: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over all rows of ``table`` (y, features) by side (rejected, preferred) and bin of the margin.

    They are the count, the margin, the scaled features and their products; [2, BINS, 2 + n + n * n].
    """
    n = len(weights)
    wide = 2 + n + n * n

    def add(batches):
        for batch in batches:
            z = (batch.column("features").flatten().to_numpy().reshape(-1, n) - mean) / scale
            margin = z @ weights
            place = np.clip(np.floor(margin * STEPS).astype(np.int64) + BINS // 2, 0, BINS - 1)
            place += BINS * (batch.column("y").to_numpy() > 0)
            yield place, np.column_stack([np.ones(len(z)), margin, z, (z[:, :, None] * z[:, None, :]).reshape(-1, n * n)])

    def merge(pairs):
        total, seen = np.zeros((2 * BINS, wide)), np.zeros(2 * BINS, bool)
        for place, values in pairs:
            np.add.at(total, place, values)
            seen[place] = True
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found].tolist(), pa.list_(pa.float64()))], ["bin", "sums"])

    def sums(batches):
        return ((b.column("bin").to_numpy(), b.column("sums").flatten().to_numpy().reshape(-1, wide)) for b in batches if b.num_rows)

    schema = "bin bigint, sums array<double>"
    parts = table.mapInArrow(lambda b: merge(add(b)), schema)
    rows = parts.repartition("bin").mapInArrow(lambda b: merge(sums(b)), schema).toArrow()
    out = np.zeros((2 * BINS, wide))
    np.add.at(out, rows["bin"].to_numpy(), np.array(rows["sums"].to_pylist(), float).reshape(-1, wide))
    return out.reshape(2, BINS, wide)


def fit_pairs(table: DataFrame, ridge: float = 1e-3, rounds: int = 50) -> QualityModel:
    """Bradley-Terry weights by Newton steps on the logistic loss of the feature differences of all pairs in ``table``.

    ``table`` is (y, features) with y above 0 for preferred documents. The cut is the quantile of all training scores at
    the share of rejected documents. Without a document on both sides the weights and the cut are zero, so that every
    document gets the neutral score CUT. Means and weights are rounded, for the order of a sum depends on the tasks.
    """
    weights, n = np.zeros(_FEATURES), _FEATURES
    raw = _binned(table, weights, np.ones(n), weights).sum(1)
    bad, good = int(raw[0, 0]), int(raw[1, 0])
    first, second = raw[:, 2:2 + n].sum(0) / max(bad + good, 1), np.diag(raw[:, 2 + n:].sum(0).reshape(n, n)) / max(bad + good, 1)
    spread = second - first * first
    mean, scale = first.round(9), np.where(spread < 1e-12, 1.0, np.sqrt(np.maximum(spread, 1e-12))).round(9)
    if not good or not bad:
        return QualityModel(mean, scale, weights, 0.0)
    for _ in range(rounds):
        (cb, mb, zb, qb), (cg, mg, zg, qg) = (
            (s[:, 0], s[:, 1] / s[:, 0], s[:, 2:2 + n], s[:, 2 + n:]) for s in (
                side[side[:, 0] > 0] for side in _binned(table, mean, scale, weights)))
        chance = 1 / (1 + np.exp(-np.clip(mg[:, None] - mb[None, :], -30, 30)))
        lost, bent = 1 - chance, chance * (1 - chance)
        cross = zg.T @ bent @ zb
        slope = ((lost @ cb) @ zg - (cg @ lost) @ zb) / good / bad - ridge * weights
        bend = (((bent @ cb) @ qg + (cg @ bent) @ qb).reshape(n, n) - cross - cross.T) / good / bad + ridge * np.eye(n)
        move = np.linalg.solve(bend, slope)
        weights = (weights + move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))).round(9)
        if np.abs(move).max() < 1e-4:  # below it, rows that change their bin move the weights as much
            break
    margins = computed(table, ["features"], [T.StructField("margin", T.DoubleType())],
                       lambda: lambda x: [((np.array(x, float).reshape(-1, n) - mean) / scale) @ weights], ["y"])
    cut = exact_percentiles(margins, [], "margin", {"cut": (bad - 0.5) / (bad + good - 1)}).first()["cut"]
    return QualityModel(mean, scale, weights, float(cut))


def feature_table(df: DataFrame, key: str, text: str, extra: list[str] = ()) -> DataFrame:
    return computed(df, [text], [T.StructField("features", T.ArrayType(T.DoubleType()))],
                    lambda: lambda texts: [[features(t).tolist() for t in texts]], [key, *extra])


def fit_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality") -> QualityModel:
    """Learn from all labelled documents.

    NULL ids, labels and unmatched rows are left out; of several labels of one document the least counts. A document
    without text is learned as an empty one. The features of all ``documents`` are written to the shared folder and
    joined there, so no text is shuffled.
    """
    named = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where(
        "k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))
    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null")
    return fit_pairs(shared_table(feature_table(rows, "k", "t").join(named, "k").select("y", "features")))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None,
                  name: str = "score") -> DataFrame:
    """Append the score of each whole text, from 0 to 1; NULL and empty texts get that of zero features.

    Rows are neither dropped nor merged, and a column called like the output is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few vectors of features

    def make():
        fitted = shared.value
        return lambda texts: [fitted.score(np.array([features(t) for t in texts]).reshape(-1, _FEATURES))]

    return computed(df, [text], [T.StructField(name, T.DoubleType())], make, keep)
