"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives a vector of transformed statistics. Per class, Spark sums the vectors and their products over all
labelled training rows, which gives mean and covariance; the covariance is shrunk towards the pooled one and towards
its diagonal. The score of a document starts from the difference of the two log-densities, from Mahalanobis distances
with the inverse Cholesky factors computed once; a logistic curve over that difference, fitted on the counts of its
histogram over the training rows, makes it a probability.

Only rows with ``crc32(doc_id) mod 5 <> 0`` train, and only text is a feature. Null and empty texts have the
statistics of an empty text and are scored like the rest. Of repeated labels of a document the larger one counts;
labels that are null are left out. A training set without both classes gives its constant share as every score.
Statistics cover whole texts of any length. A score of exactly the threshold predicts 1. Rows that repeat train and are scored each
time. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import packed, ship, struct_udf, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1
#: Bins of the log-density difference for the calibration, over [-RANGE, RANGE].
BINS, RANGE = 200, 50.0
FEATURES = (
    "log_words", "log_lines", "word_length", "word_length_spread", "symbols", "punctuation", "capitals", "digits", "non_ascii",
    "separators", "shouts", "distinct_words", "distinct_lines", "closed_lines", "line_words", "single_letters",
)

_CLOSED = re.compile(r"[.!?…:;\"'”’)]\s*(?:\n|\Z)")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``."""
    raw = text.encode()
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    per = lambda x, of: float(np.sqrt(x / max(of, 1)))  # noqa: E731  shares are drawn apart near 0
    letters = c[65:91].sum() + c[97:123].sum()
    symbols = sum(int(c[ord(x)]) for x in "#*$%&<>~^={}@_")
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        per(symbols, n), per(c[44] + c[46] + c[58] + c[59] + c[63], n), per(c[65:91].sum(), letters), per(c[48:58].sum(), len(raw)), per(c[192:].sum(), len(raw)),
        per(c[124] + c[9], n), per(c[33], n), len(set(words)) / max(n, 1), len(set(lines)) / max(len(lines), 1), len(_CLOSED.findall(text)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))), per(int((lengths == 1).sum()), n),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row, as a table."""
    run = struct_udf(docs.sparkSession, lambda t: (statistics(t),), "x array<double>")
    return written(packed(docs).select(F.col("__row.doc_id").alias("doc_id"), run("__text").alias("s")).select("doc_id", "s.x"))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def moments(train: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class (``y``) the count, mean and covariance, from sums over all rows."""
    d = len(FEATURES)
    x = lambda i: F.col("x")[i]
    sums = [F.sum(x(i)).alias(f"s{i}") for i in range(d)] + [F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = {}
    for r in train.groupBy("y").agg(F.count("*").alias("n"), *sums).collect():  # two rows
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r.n
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r.n
        out[r.y] = (r.n, mean, second - np.outer(mean, mean))
    return out


class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the two shrunk class densities."""

    def __init__(self, m: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in m.values())
        pooled = sum(n * s for n, _, s in m.values()) / total
        self.parts = []
        for y in (1, 0):
            _, mean, s = m[y]
            s = (1 - SHRINK_POOLED) * s + SHRINK_POOLED * pooled
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + 1e-4 * np.eye(len(mean))
            factor = np.linalg.cholesky(s)
            self.parts.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, for each row of ``x``."""
        one, zero = (-0.5 * (((x - mean) @ w.T) ** 2).sum(axis=1) - logdet for mean, w, logdet in self.parts)
        return one - zero


def _with_difference(df: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def llr(x: pd.Series) -> pd.Series:
        return pd.Series(model.difference(np.array(x.tolist(), np.float64).reshape(-1, len(FEATURES))))

    ship(df.sparkSession)
    return df.withColumn("llr", llr("x"))


def calibration(counts: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits ``(bin, label, count)`` best, by Newton's steps."""
    z = np.array([(b + 0.5) * 2 / BINS - 1 for b, _, _ in counts])
    y, n = (np.array(v, float) for v in ([y for _, y, _ in counts], [k for _, _, k in counts]))
    a = np.column_stack([z, np.ones_like(z)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (y - p)) - 1e-3 * w
        hess = (a * (n * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    x = featured(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    train = x.join(known, "doc_id").select("y", "x")
    m = moments(train)
    held = (fold() == HELD_OUT).alias("held_out")
    if set(m) != {0, 1} or min(n for n, _, _ in m.values()) < 2:
        share = float(next(iter(m))) if m else 0.5
        score = F.lit(share)
        return x.select("doc_id", held, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    model = Discriminant(m)
    scaled = lambda c: F.least(F.greatest(F.col(c) / RANGE, F.lit(-1.0)), F.lit(1.0))
    bins = _with_difference(train, model).groupBy(F.least(F.floor((scaled("llr") + 1) * BINS / 2), F.lit(BINS - 1)).cast("int").alias("b"), "y").agg(F.count("*").alias("n"))
    slope, offset = calibration([tuple(r) for r in bins.collect()])  # at most BINS rows a class
    score = 1 / (1 + F.exp(-(scaled("llr") * slope + offset)))
    out = _with_difference(x, model).withColumn("score", score)
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
