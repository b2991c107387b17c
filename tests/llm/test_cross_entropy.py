"""Losses against counting by hand."""

import io
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bankspark.llm import cross_entropy as C


def brute_force(texts, target, size):
    words = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for t in texts for w in words(t))
    number = {w: k + 1 for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:size])}
    numbered = lambda t: [0] + [number.get(w, 0) for w in words(t)]

    def model(of):
        pairs = Counter(p for t in of for x in [numbered(t)] for p in zip(x, x[1:]))
        after, into = Counter(), Counter()
        for (a, b), n in pairs.items():
            after[a] += n
            into[b] += n
        total = sum(into.values()) + C.EVEN * (size + 1)
        return lambda a, b: -math.log((pairs[a, b] + C.FROM_WORD * (into[b] + C.EVEN) / total) / (after[a] + C.FROM_WORD))

    models = model(target), model(texts)
    out = []
    for t in texts:
        x = numbered(t)
        mean = [sum(m(a, b) for a, b in zip(x, x[1:])) / (len(x) - 1) if len(x) > 1 else None for m in models]
        out.append((len(x) - 1, *mean))
    return out


def test_against_counting(documents, odd):
    rows = odd + [(50, "the cat sat on the mat"), (51, "THE dog sat"), (52, "the cat ran " * 40)]
    docs = documents(rows)
    got = C.cross_entropy_difference(docs, F.col("doc_id").isin(50, 51), vocabulary=12).collect()
    want = brute_force([t for _, t in rows], [t for i, t in rows if i in (50, 51)], 12)
    key = lambda r: (str(r[0]), r[1], round(r[2] or 0, 4))
    for g, w in zip(sorted(got, key=key), sorted(((i, *x) for (i, _), x in zip(rows, want)), key=key)):
        assert (g.doc_id, g.n_tokens) == w[:2]
        if w[1] == 0:
            assert g.target_loss is None and g.score is None
        else:
            assert g.target_loss == pytest.approx(w[2], rel=1e-5) and g.background_loss == pytest.approx(w[3], rel=1e-5)
            assert g.score == pytest.approx(w[2] - w[3], abs=1e-4)


@pytest.mark.parametrize("size, part", [(C.SLICE, C.PART), (4000, 900)])
def test_rare_words_count(documents, monkeypatch, size, part):
    """Texts that differ in rare words only, beside far more frequent ones; also in many slices and parts."""
    monkeypatch.setattr(C, "SLICE", size)
    monkeypatch.setattr(C, "PART", part)
    common = " ".join(f"w{k}" for k in range(2100))
    rows = [(1, common), (2, common), (3, common), (4, "w1 good rare w2"), (5, "w1 other scarce w2"), (6, "")]
    docs = documents(rows)
    got = {r.doc_id: r for r in C.cross_entropy_difference(docs, F.col("doc_id").isin(1, 4)).collect()}
    assert got[4].score < got[5].score
    want = brute_force([t for _, t in rows], [rows[0][1], rows[3][1]], 2104)
    for (doc_id, _), (n, of_target, of_background) in zip(rows, want):
        assert got[doc_id].n_tokens == n
        if n:
            assert got[doc_id].target_loss == pytest.approx(of_target, rel=1e-6)
            assert got[doc_id].background_loss == pytest.approx(of_background, rel=1e-6)


def test_empty_tables(documents, odd):
    assert C.cross_entropy_difference(documents([]), F.lit(True)).count() == 0
    got = C.cross_entropy_difference(documents(odd), F.lit(None)).collect()
    assert len(got) == len(odd)


def test_marked(documents):
    docs = documents([(1, "a"), (2, "b"), (2, "c"), (None, "d")])
    ids = docs.sparkSession.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id bigint")
    got = C.marked(docs, ids, "good").select("text", "good").collect()
    assert sorted(map(tuple, got)) == [("a", False), ("b", True), ("c", True), ("d", False)]


def test_slices_come_back_as_they_were():
    documents = [b"a b a", b"", b"c \xc3\xa4 A", b"x"]
    of = C._Slice.of(documents, None, np.array([True, False, True, False]))
    file = io.BytesIO()
    of.write(file, pa.array([5, None, -7, 2**60]))
    again, ids = C._Slice.read(file.getvalue())
    assert ids.to_pylist() == [5, None, -7, 2**60]
    assert all((getattr(of, c) == getattr(again, c)).all() for c in ("words", "of_token", "sizes", "chosen"))
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (C._read_keys(C._sorted_keys(keys)) == keys).all()
    edges = C._edges(keys, 7)
    assert edges[0] == 0 and edges[-1] == 1000 and (np.diff(edges) > 50).all()
