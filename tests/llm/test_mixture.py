"""Targets, exact quotas, disjoint blocks, and what the mix takes."""

import numpy as np
import pytest

from bankspark.llm import mixture as M
from tests.conftest import DATA


def test_targets():
    assert M.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert M.targets([]) == [] and M.targets([0, 0]) == [0.0, 0.0]
    sizes = [10, 0, 500, 3, 70, 70]
    got = M.targets(sizes)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s for t, s in zip(got, sizes))


def test_tree_gives_exact_quotas():
    quotas = np.array([1000, 37, 0, 5, 250])
    totals = M.even(1292, 7)
    assert totals.sum() == 1292 and totals.max() - totals.min() <= 1
    got = M.split(quotas, totals, [3])
    assert (got.sum(1) == quotas).all() and (got.sum(0) == totals).all() and (got >= 0).all()
    assert (got == M.split(quotas, totals, [3])).all() and (got != M.split(quotas, totals, [4])).any()


@pytest.mark.parametrize("group", [10_000, 7])
def test_targets_and_quotas_of_many_sources(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(M, "SOURCES_IN_GROUP", group)
    rng = np.random.default_rng(2)
    words = {None: 900, **{f"s{k:03}": int(w) for k, w in enumerate((rng.pareto(0.6, 200) * 40).astype(int))}}
    sizes = spark.createDataFrame([("-" if s is None else "=" + s, w, 1) for s, w in words.items()], "key string, words bigint, n bigint")
    plan = {r.key: r for r in M._planned(sizes, 5, 9, str(tmp_path)).collect()}
    names = sorted(words, key=lambda s: (s is None, s or ""))
    want = M.targets([words[s] for s in names])
    rows = [plan["-" if s is None else "=" + s] for s in names]
    assert [r.target for r in rows] == want
    shares = np.diff(np.array([np.frombuffer(r.bounds, np.int64) for r in rows]), axis=1, prepend=0)
    assert (shares >= 0).all() and shares.sum(1).tolist() == [r.quota for r in rows]
    assert shares.sum(0).tolist() == M.even(sum(r.quota for r in rows), 5).tolist()
    # A source at its limit takes its last block, which may be shorter, twice.
    assert all(abs(r.quota * r.block - t) <= 2 * r.block for r, t in zip(rows, want))


def test_permutation():
    for size in (1, 2, 3, 1000):
        got = M.permuted(np.arange(size), np.full(size, size), np.full(size, 11, np.uint64))
        assert sorted(got.tolist()) == list(range(size))


def check(spark, docs, rows):
    words = lambda t: len((t or "").encode().split())
    got = M.mixture(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    taken = {}
    for r in got:
        mine = sum(d.n_words for d in r.draws)
        assert mine <= 2 * r["size"] and all(d.start >= 0 and d.start + d.n_words <= r["size"] for d in r.draws)
        for copy in (0, 1):
            spans = sorted((d.start, d.start + d.n_words) for d in r.draws if d.copy == copy)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        total = taken.setdefault(r.source, [0, r.target, r.source_size])
        total[0] += mine
    for mine, target, size in taken.values():
        assert abs(mine - target) <= max(1, 0.01 * size)
    places = [(r.source, d.position) for r in got for d in r.draws]
    again = M.mixture(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return got, len(set(places))


def test_odd_rows(spark, documents, odd):
    rows = [(*r, s) for r, s in zip(odd, [None, "", "a", "b", "hot", "hot", "hot", None, "", "c", "a"])]
    check(spark, documents(rows), rows)
    assert M.mixture(documents([])).count() == 0 and M.mixed_documents(documents([])).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got, _ = check(spark, docs, rows)
    mixed = M.mixed_documents(docs)
    assert mixed.schema == docs.schema
    words = sum(len(r.text.encode().split()) for r in mixed.collect())
    assert words == sum(d.n_words for r in got for d in r.draws)
    shards = M.shards(docs).groupBy("shard").sum("n_words").collect()
    totals = [r[1] for r in shards]
    assert len(totals) == M.SHARDS and max(totals) < 1.2 * min(totals)


def test_equal_rows_are_drawn_each_for_itself(spark, documents):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text, s) for s in "aabbbbccc" for _ in range(5)] + [(7, text, "a")] * 6
    docs = documents(rows)
    planned = M.mixture(docs).collect()
    taken = sum(d.n_words for r in planned for d in r.draws)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken
    assert len(planned) == len(rows) and abs(taken - 1.5 * 100 * len(rows)) <= 10


def test_shards_decide_where_rows_are(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet").limit(150)
    drawn = {}
    for r in M.mixture(docs, 4).collect():
        for copy in {d.copy for d in r.draws}:
            drawn.setdefault(r.doc_id, []).append(min((d.start, d.shard) for d in r.draws if d.copy == copy)[1])
    out = M.mixed_documents(docs, 4)
    ids = [[r.doc_id for r in part] for part in out.select("doc_id").rdd.glom().collect()]
    # Rows of a partition go through the shards in turn.
    for part in ids:
        seen = [drawn[i] for i in part]
        low = 0
        for shards in seen:
            low = min(s for s in shards if s >= low)
    assert sorted(i for part in ids for i in part) == sorted(i for i, s in drawn.items() for _ in s)
    other = M.mixed_documents(docs, 4, seed=10)
    assert [r.doc_id for r in other.collect()] != [r.doc_id for r in out.collect()]
    totals = [[(r.shard, r.n) for r in M.shards(docs, 4, s).groupBy("shard").agg({"n_words": "sum"}).toDF("shard", "n").collect()] for s in (9, 10)]
    assert sorted(totals[0]) != sorted(totals[1])


def test_sources_joined_by_a_shuffle(spark, documents, monkeypatch):
    rows = [(k, "some words of a text", f"s{k % 40}" if k % 3 else "hot") for k in range(300)]
    docs = documents(rows)
    want = sorted(map(str, M.mixture(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 20)
    assert sorted(map(str, M.mixture(docs).collect())) == want
