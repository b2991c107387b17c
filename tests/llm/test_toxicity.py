"""The learner's parts, its held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bankspark.llm import toxicity as T
from tests.conftest import DATA


def test_held_out_rows_are_those_of_the_rule(spark):
    ids = spark.range(200).withColumn("held", T.held_out(F.col("id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids)


def test_non_negative_risk_ignores_unlabelled_positives():
    rng = random.Random(1)
    text = lambda bad: " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + (["vile", "foul"] if bad else []))
    features = lambda t: np.unique(np.array([h for w in T.words_of(t) for h in T.word_features(w)], np.uint64))
    model = T.learn([features(text(True)) for _ in range(150)], [features(text(k % 8 == 0)) for k in range(800)], 0.125)
    score = T.Scorer(model)
    assert min(score(text(True)) for _ in range(50)) > T.THRESHOLD > max(score(text(False)) for _ in range(50))


def test_no_positive_texts():
    model = T.learn([], [np.array([1], np.uint64)], 0.01)
    assert abs(T.Scorer(model)("anything") - 0.01) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet")
    rows = T.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.08 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_odd_rows(spark, documents, odd):
    labels = spark.createDataFrame(
        [(4, 0, 1), (4, 0, 0), (5, 1, None), (None, 1, 1), (6, 1, 0), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = T.toxicity(documents(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    of = {r.doc_id: r.score for r in got}
    assert of[1] == of[2] == of[3]
    assert T.toxicity(documents([]), labels).count() == 0
    assert T.toxicity(documents(odd), labels.limit(0)).filter("predicted = 0").count() == len(odd)
    kept = T.without_toxic(documents(odd), labels.limit(0))
    assert kept.columns == documents(odd).columns and kept.count() == len(odd)
