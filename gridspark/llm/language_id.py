"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, for each language and bucket, the character n-grams of all labelled texts: a numpy count per task,
summed by Spark. The log probabilities form one matrix of ``buckets`` rows and a column per language, whose size is
fixed before any data are read; it is broadcast, and texts are scored in numpy by looking up only the n-grams they hold.

The posterior of a text saturates after a few letters, also in a language that was never seen. Whether a text is in its
language at all is judged by the mean log probability of its n-grams, against cuts that are learned from the labelled
texts of each language and of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import computed, steps

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
LEAST_GAP = 1.0  # nats between the mean of a language and its cut; labels may stand for nearly the same language
_GAP = 32  # code of the blank that stands for every run-breaking character
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def hashed_grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts: (one row per order, start of each text, has the text a letter).

    Letters are lower-cased and everything else is a blank. N-grams do not cross texts; positions without an n-gram
    hold the number ``buckets``.
    """
    lowered = [text.lower() for text in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 3
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    codes = np.frombuffer(("".join(f" {x}  " for x in lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[codes]
    codes = np.where(letters, codes, _GAP).astype(np.uint64)
    rows = np.full((len(ORDERS), len(codes)), buckets, np.int64)
    for row, order in zip(rows, ORDERS):
        size = len(codes) - order + 1
        if size <= 0:
            continue
        mixed = np.full(size, order, np.uint64)
        some = np.zeros(size, bool)
        for k in range(order):
            mixed = (mixed ^ codes[k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            some |= letters[k:k + size]
        # An n-gram of blanks only says nothing; the two blanks at the end of a text keep others out of the next one.
        row[:size] = np.where(some, (mixed >> np.uint64(40)).astype(np.int64) % buckets, buckets)
        ends = starts + lengths - 1
        for back in range(2):
            row[ends - back] = buckets
    return rows, starts, np.logical_or.reduceat(letters, starts) if len(starts) else np.zeros(0, bool)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and log probabilities of shape (buckets + 1, languages); the last row is zero."""

    languages: list[str]
    priors: np.ndarray
    table: np.ndarray
    smoothing: float = 0.5

    def once_less(self) -> np.ndarray:
        """The table with every count of an n-gram that was seen lower by one."""
        unseen = self.table[:-1].min(0, keepdims=True)  # holds log(smoothing), as long as some bucket is empty
        ratio = np.exp((self.table[:-1] - unseen).astype(np.float64)) * self.smoothing  # count + smoothing
        less = np.where(ratio >= self.smoothing + 0.5, np.maximum(ratio - 1, self.smoothing), ratio)
        return np.concatenate([unseen + np.log(less / self.smoothing), self.table[-1:]]).astype(np.float32)


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS,
                  smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row with a text and a label; rows with a NULL in either are left out.

    A text without letters counts for the prior of its language only. Without any labelled row the model knows no
    language. What reaches the driver is at most ``buckets`` counts for each language.
    """
    labelled = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).where(
        "t is not null and l is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for label in set(labels.tolist()):
                own = [texts[i] for i in np.flatnonzero(labels == label)]
                total = sums.setdefault(label, np.zeros(buckets + 1, np.int64))
                total[buckets] += len(own)
                for a, b in steps(own):
                    rows, _, _ = hashed_grams(own[a:b], buckets)
                    total[:buckets] += np.bincount(rows.ravel(), minlength=buckets + 1)[:buckets]
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(total[at])],
                                             names=["lang", "bucket", "n"])

    counts = (labelled.mapInArrow(count, "lang string, bucket bigint, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    names, inverse = np.unique(np.array(counts["lang"].to_pylist(), object).astype(str), return_inverse=True)
    grid = np.zeros((buckets + 1, len(names)))
    grid[counts["bucket"].to_numpy(), inverse] = counts["n"].to_numpy()
    documents, grid = grid[buckets].copy(), grid[:buckets]
    table = np.zeros((buckets + 1, len(names)), np.float32)
    if len(names):
        table[:buckets] = np.log(grid + smoothing) - np.log(grid.sum(0) + smoothing * buckets)
    return LanguageModel(names.tolist(), np.log(documents / documents.sum()) if len(names) else documents, table, smoothing)


def fit_cuts(model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, spreads) by language: the least mean log probability of a text's n-grams, and the deviation of one n-gram.

    The cut lies halfway between what the labelled texts of a language have on average and what those of the other
    languages have in it, and LEAST_GAP under the first at least. A model of one language has the cut of chance, all
    buckets alike. In a language's own texts every n-gram counts once less than it was learned, as it would in a new text.
    """
    own, table = model.once_less()[:-1].astype(np.float64), model.table[:-1].astype(np.float64)
    share = np.exp(table) - np.exp(table.min(0, keepdims=True))  # without the smoothing
    share /= np.maximum(share.sum(0), 1e-300)
    inside, across = (share * own).sum(0), share.T @ table
    spreads = np.sqrt((share * (own - inside) ** 2).sum(0))
    if len(inside) < 2:
        return np.minimum(np.full(len(inside), -np.log(len(table))), inside - LEAST_GAP), spreads
    others = (across.sum(0) - np.diag(across)) / (len(inside) - 1)
    return np.minimum((inside + others) / 2, inside - LEAST_GAP), spreads


def predict(model: LanguageModel, texts: list[str | None], table: np.ndarray | None = None) -> tuple[list, list]:
    """Language and its posterior probability for each text; UNKNOWN and 0.0 without a letter or a model."""
    return judge(model, texts, table)[:2]


def judge(model: LanguageModel, texts: list[str | None], table: np.ndarray | None = None,
          cuts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, list, list]:
    """As ``predict``, and whether the mean log probability of the text's n-grams reaches the cut of its language.

    The cut of a short text is lower by the deviation of a mean of so few n-grams.
    """
    table = model.table if table is None else table
    found, scores, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if not model.languages:
        return found, scores, fits
    for a, b in steps(texts):
        rows, starts, lettered = hashed_grams([t or "" for t in texts[a:b]], len(table) - 1)
        sums = np.repeat(model.priors[None, :], b - a, 0)
        for row in rows:
            sums += np.add.reduceat(table[row], starts, axis=0, dtype=np.float64)
        best = sums.argmax(1)  # the first language, in alphabetical order, wins a tie
        chance = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        for i in np.flatnonzero(lettered):
            found[a + i], scores[a + i] = model.languages[best[i]], float(chance[i])
        if cuts is not None:
            n = np.maximum(np.add.reduceat((rows < len(table) - 1).sum(0), starts), 1)
            means = (sums[np.arange(b - a), best] - model.priors[best]) / n
            fits[a:b] = (lettered & (means >= cuts[0][best] - cuts[1][best] / np.sqrt(n))).tolist()
    return found, scores, fits


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None,
             name: str = "lang_pred", score: str = "score", cuts: tuple[np.ndarray, np.ndarray] | None = None, fits: str = "fits") -> DataFrame:
    """Append the language of each whole text and its posterior probability; with cuts, also whether it fits its language.

    NULL and empty texts and texts without a letter give ``und`` and 0.0. Equal texts get equal results, rows are
    neither dropped nor merged, and an empty table stays empty. Columns called like the outputs are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # (buckets + 1) x languages x 4 bytes
    fields = [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(fits, T.BooleanType())]
    return computed(df, [text], fields if cuts is not None else fields[:2],
                    lambda: lambda texts: judge(shared.value, texts, cuts=cuts), keep)
