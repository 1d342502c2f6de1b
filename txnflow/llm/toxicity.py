"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences. Each sentence has a probability, a logistic function of its features; a document is
toxic if any sentence is, so its score is one less the product of the complements. Only this product meets the
labels in training; afterwards the sentence scores locate the offending sentences.

Features are words (lower-cased runs of letters) and their first four and five letters, so that inflected forms share
weight. A sentence without a feature of the vocabulary counts as clean, so that length alone makes no text toxic. The vocabulary is what tells the classes apart by document counts. Training takes at most ``SAMPLE`` labelled
documents a class, those with the smallest hashes of their ids; that bound is all that is limited.

Only rows with ``crc32(doc_id) mod 4 <> 2`` train, and only text is a feature. Null and empty texts have no sentence
and score 0. Of repeated labels of a document the larger one counts; null labels are left out; of rows that repeat a doc_id the
smallest text trains and all are scored. Without both classes (no labels, say) every score is the share of toxic training rows, and
no sentences are named; the columns stay the same. A score of exactly the threshold predicts 1. An empty table gives no rows; other
columns are ignored, whatever their names; texts of any length are scored whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.shared import packed, ship, struct_udf

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled documents of each class in training, at most.
SAMPLE = 4_000
#: Features in the vocabulary, at most; documents a feature must be in; its least log-odds.
VOCABULARY, MIN_DOCS, MIN_LOG_ODDS = 4_000, 4, 2.5
STEMS = (4, 5)
#: Words whose weights a worker keeps at once.
CACHE = 300_000
SCHEMA = "score double, n_sentences int, n_offending int, offending array<struct<start: int, end: int, score: double>>"

_WORD = re.compile(r"[^\W\d_]+")
# A stretch between closing marks or line ends with a letter in it.
_SENTENCE = re.compile(r"[^.!?\n]*[^\W\d_][^.!?\n]*")


def word_features(word: str) -> list[str]:
    """The word (marked =) and its stems of ``STEMS`` letters (marked by their length)."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) >= n)]


def sentence_features(sentence: str) -> set[str]:
    return {f for w in set(_WORD.findall(sentence.lower())) for f in word_features(w)}


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``y, text`` of at most ``size`` labelled documents of each class outside the held-out fold."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(fold != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("y = 1").orderBy(*order).limit(size).union(known.where("y = 0").orderBy(*order).limit(size))
    # At most 2 * size ids, so this side may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # One text an id, the smallest, so that the bound holds for rows too.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def vocabulary(sample: DataFrame) -> list[str]:
    """The features with the largest log-odds of toxic against other documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [sorted(sentence_features(t)) for t in p.text]
            yield pd.DataFrame({"f": pd.Series([f for fs in found for f in fs], dtype=object), "y": np.repeat(p.y.to_numpy(), [len(fs) for fs in found])})

    ship(sample.sparkSession)
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("y", "text").mapInPandas(run, "f string, y int").groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("q") + 0.5) / (totals.get(0, 0) + 1))
    top = counts.where(F.col("p") >= MIN_DOCS).withColumn("o", odds).where(F.col("o") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("o") * F.sqrt("p")), "f").limit(VOCABULARY)
    return [r.f for r in top.select("f").collect()]


def bags(sample: DataFrame, names: list[str]) -> pd.DataFrame:
    """Per sampled document its label and the feature numbers of each sentence that has some."""
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for y, text in zip(p.y, p.text, strict=True):
                own = [[number[f] for f in sentence_features(s) if f in number] for s in _SENTENCE.findall(text)]
                rows.append((y, [x for x in own if x]))
            yield pd.DataFrame(rows, columns=["y", "own"])

    return sample.select("y", "text").mapInPandas(run, "y int, own array<array<int>>").toPandas()


def fit(data: pd.DataFrame, n_features: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the labels under noisy-or, by Adam on the whole sample."""
    doc, feature, sentence = [], [], []
    for d, own in enumerate(data.own):
        for x in own:
            feature.extend(x)
            sentence.extend([len(doc)] * len(x))
            doc.append(d)
    doc, feature, sentence = (np.array(v, np.int64) for v in (doc, feature, sentence))
    y = data.y.to_numpy(float)
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = -6.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(sentence, theta[feature], len(doc)) + theta[-1])
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        none = np.exp(log_none)
        # d(-log likelihood) / d(log_none): 1 for clean documents with sign -, none / (1 - none) for toxic ones.
        g = weight * np.where(y == 1, none / np.maximum(1 - none, 1e-6), -1.0) / len(y)
        per_sentence = -g[doc] * p  # d log(1 - p) / dz = -p
        grad = np.append(np.bincount(feature, per_sentence[sentence], n_features), per_sentence.sum())
        grad = grad + 1e-5 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[-1] = min(theta[-1], -4.0)
    return theta[:-1], float(theta[-1])


class _Weights(dict):
    """Word -> its features' weights, filled on demand. Only words with a feature matter."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = tuple((f, self.weights[f]) for f in word_features(word) if f in self.weights)
        return out


@functools.cache
def _weights(items: tuple) -> _Weights:
    return _Weights(dict(items))


def score(text: str, weights: _Weights, bias: float, threshold: float = THRESHOLD) -> tuple:
    """The row of ``SCHEMA`` for one text."""
    known = {w: weights[w] for w in set(_WORD.findall(text.lower())) if weights[w]}
    if not known:
        return 0.0, len(_SENTENCE.findall(text)), 0, []
    log_none, n, found = 0.0, 0, []
    for n, m in enumerate(_SENTENCE.finditer(text), 1):
        own = {f: w for word in _WORD.findall(m.group().lower()) if word in known for f, w in known[word]}
        if not own:
            continue
        p = 1 / (1 + math.exp(-min(30.0, max(-30.0, bias + sum(own.values())))))
        log_none += math.log1p(-min(p, 1 - 1e-9))
        if p >= threshold:
            found.append((m.start(), m.end(), p))
    return -math.expm1(log_none), n, len(found), found


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the offending sentences of every row of ``docs``."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels).persist()
    held = (F.crc32(F.coalesce(F.col("__row.doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT).alias("held_out")
    names = vocabulary(sample)
    data = bags(sample, names)
    sample.unpersist()
    if data.y.nunique() < 2 or not names:
        share = float(data.y.mean()) if len(data) else 0.0
        constant = F.struct(F.lit(share).alias("score"), *(F.lit(None).cast(k).alias(n) for n, k in (("n_sentences", "int"), ("n_offending", "int"), ("offending", "array<struct<start: int, end: int, score: double>>"))))
        out = packed(docs).withColumn("__s", constant)
        return out.select(F.col("__row.doc_id").alias("doc_id"), held, "__s.*").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    weights, bias = fit(data, len(names))
    model = spark.sparkContext.broadcast(tuple(zip(names, weights.tolist(), strict=True)))  # at most VOCABULARY items
    run = struct_udf(spark, lambda t: score(t, _weights(model.value), bias), SCHEMA)
    out = packed(docs).withColumn("__s", run("__text"))
    return out.select(F.col("__row.doc_id").alias("doc_id"), held, "__s.*").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
