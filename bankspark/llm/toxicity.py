"""Toxicity by non-negative positive-unlabelled learning.

Classifiers learn from confirmed toxic texts and from unlabelled ones. The risk of the unlabelled texts as
negatives is corrected by the share of toxic texts among them, and kept from falling below zero:
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``. Where the second part is negative, the step goes the
other way, as in the published method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from bankspark.llm.store import new_folder, stored, unused
from bankspark.llm.words import slices

# The classifier learns from at most so many texts.
POSITIVES, UNLABELLED = 3000, 6000
FEATURES, LEAST_TEXTS, LEAST_Z, STEPS, RATE = 2048, 4, 3, 600, 0.02
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_CACHED_WORDS = 300_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring only. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_features(word: str) -> list[int]:
    """The word, its beginnings of 3 to 6 letters and its ends of 3 to 5, as hashes."""
    n = len(word)
    parts = ["w" + word] + [f"p{word[:k]}" for k in range(3, min(6, n) + 1)] + [f"s{word[-k:]}" for k in range(3, min(5, n) + 1)]
    return [xxh3_64_intdigest(p) for p in parts]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Classifier:
    features: np.ndarray
    weights: np.ndarray
    bias: float

def chosen_features(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features whose share of texts differs most between the two sides, in standard errors."""
    sides = []
    for texts in (positive, unlabelled):
        flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        sides.append(np.unique(flat, return_counts=True))
    every = np.union1d(sides[0][0], sides[1][0])
    counts = np.zeros((2, len(every)))
    for k, (values, number) in enumerate(sides):
        counts[k, np.searchsorted(every, values)] = number
    n = np.array([max(1, len(positive)), max(1, len(unlabelled))], float)
    share = counts.sum(0) / n.sum()
    z = (counts[0] / n[0] - counts[1] / n[1]) / np.sqrt(share * (1 - share) * (1 / n).sum() + 1e-12)
    z[counts.sum(0) < LEAST_TEXTS] = 0
    order = np.lexsort((every, -np.abs(z)))[:FEATURES]
    return np.sort(every[order[np.abs(z[order]) > LEAST_Z]])


def matrix(texts: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(features)), np.float32)
    if len(features):
        for row, values in zip(out, texts):
            at = np.minimum(np.searchsorted(features, values), len(features) - 1)
            row[at[features[at] == values]] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """A linear classifier under the non-negative risk with the sigmoid loss, by Adam on all texts.

    The sigmoid loss is bounded, so the toxic texts among the unlabelled ones weigh no more than the others.
    """
    features = chosen_features(positive, unlabelled)
    p, u = matrix(positive, features), matrix(unlabelled, features)
    weights, bias = np.zeros(len(features), np.float32), 0.0
    if not len(p) or not len(u) or not len(features):
        return Classifier(features, weights, float(np.log(prior / (1 - prior))))
    first, second = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, STEPS + 1):
        in_p, in_u = _sigmoid(p @ weights + bias), _sigmoid(u @ weights + bias)
        # Derivatives by the output: as a positive the loss falls by as much as it rises as a negative.
        by_p, by_u = in_p * (1 - in_p) / len(p), in_u * (1 - in_u) / len(u)
        if in_u.mean() - prior * in_p.mean() >= 0:
            on_p, on_u = -2 * prior * by_p, by_u
        else:
            on_p, on_u = prior * by_p, -by_u
        slope = np.concatenate((p.T @ on_p + u.T @ on_u + 1e-4 * weights, [on_p.sum() + on_u.sum()]))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = (weights - move[:-1]).astype(np.float32), bias - float(move[-1])
    return Classifier(features, weights, bias)


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = []
        for text in batch.column("text").to_pylist():
            hashes = [h for w in words_of(text) for h in word_features(w)]
            found.append(np.unique(np.array(hashes, np.uint64)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(found, pa.binary())], ["toxic", "features"])


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); held-out rows are not read.

    Of the labels only the confirmed toxic rows count; every other text that is not held out, labelled or not,
    is unlabelled. The share of toxic texts is that among all labelled rows that are not held out, kept
    within 0.01 and 0.9. A doc_id labelled both ways counts as toxic; null labels and ids are left out.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    # The bounds keep a risk that can be learned from where there are no or only toxic labels.
    prior = min(0.9, max(0.01, (row.toxic or 0) / max(1, row.n)))

    def bounded(df: DataFrame, most: int) -> DataFrame:
        return df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(most)

    toxic = known.filter("toxic = 1")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    other = named.select("doc_id").filter(~held_out(F.col("doc_id"))).join(toxic, "doc_id", "left_anti")
    # At most POSITIVES + UNLABELLED ids: a broadcast of bounded size.
    picked = stored(
        bounded(toxic, POSITIVES).withColumn("toxic", F.lit(1))
        .unionByName(bounded(other, UNLABELLED).withColumn("toxic", F.lit(0))),
        folder, "picked",
    )
    texts = named.join(F.broadcast(picked), "doc_id")
    # Copies of a text would count as independent evidence for its chance words.
    texts = texts.groupBy("toxic", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))
    features = texts.mapInArrow(_text_features, "toxic int, features binary")

    def fit(pdf):
        sides = [[np.frombuffer(x, np.uint64) for x in pdf.features[pdf.toxic == k]] for k in (1, 0)]
        one = learn(*sides, prior)
        return pd.DataFrame({
            "features": [one.features.astype(np.uint64).tobytes()],
            "weights": [one.weights.astype(np.float64).tobytes()], "bias": [one.bias],
        })

    # One task learns, from the bounded sample.
    row = features.groupBy().applyInPandas(fit, "features binary, weights binary, bias double").first()
    if row is None:
        return Classifier(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))))
    return Classifier(np.frombuffer(row.features, np.uint64), np.frombuffer(row.weights), row.bias)


class Scorer:
    """Probability by a classifier. Texts are scored whole; words seen before are looked up."""

    def __init__(self, model: Classifier):
        self.bias = model.bias
        self.by_feature = {int(f): float(w) for f, w in zip(model.features, model.weights) if w}
        self.words: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        # Nearly all words have none; the empty tuple takes no room.
        found = tuple(f for f in word_features(word) if f in self.by_feature)
        if len(self.words) >= _CACHED_WORDS:
            self.words.clear()
        self.words[word] = found
        return found

    def __call__(self, text: str | None) -> float:
        present: set[int] = set()
        for word in words_of(text):
            found = self.words.get(word)
            if found is None:
                found = self.of_word(word)
            if found:
                present.update(found)
        return float(_sigmoid(self.bias + sum(self.by_feature[f] for f in sorted(present))))


def with_score(docs: DataFrame, model: Classifier, score: str = "score") -> DataFrame:
    """``docs`` with the score of every text; only ``text`` goes into it."""
    schema = docs.withColumn(score, F.lit(0.0)).schema

    def scored(batches):
        scorer = Scorer(model)
        for batch in slices(batches):
            values = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` from 0 to 1 and ``predicted``.

    An empty or null text scores as one without any known word. Repeated rows score alike. Without any toxic
    label every text gets the least prior. Other columns are left out.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below the threshold; all columns stay."""
    score = unused(docs, "_score")
    return with_score(docs, train(docs, labels), score).filter(F.col(score) < THRESHOLD).drop(score)
