"""Top-k against all inner products; early stops must not change it."""

import numpy as np
import pytest

from bankspark.llm import topk as T


def brute_force(ids, values, queries, k):
    out = []
    for q in queries:
        scores = values.astype(object) @ values[ids.index(q)].astype(object)
        order = sorted((-int(s), i) for s, i in zip(scores, ids) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score int, block int")


def run(spark, rows, k=T.K):
    vectors = T.whole_vectors(frame(spark, rows))
    return sorted(map(tuple, T.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k).collect()))


def test_skewed_lists_stop_early_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1000)
    rng = np.random.default_rng(6)
    values = np.zeros((2600, 6), np.float32)
    values[:, 0] = rng.pareto(0.8, 2600)
    values[:, 1:] = rng.normal(size=(2600, 5)) / 64
    values[100:140] = values[100]
    rows = [(k, [float(x) for x in v], 0, 0, 0) for k, v in enumerate(values)]
    whole = np.floor(64 * values.astype(float)).astype(np.int64)
    assert run(spark, rows) == brute_force(list(range(2600)), whole, range(0, 2600, 20), 20)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(7)
    lists = T.Lists(np.arange(50), rng.integers(-9, 9, (50, 4)).astype(np.int32))
    q = rng.integers(-9, 9, (5, 4)).astype(np.float64)
    exact = q @ lists.values.T
    for depth in range(50):
        low, high = lists.bounds(depth, np.maximum(q, 0), np.minimum(q, 0))
        assert (low <= exact).all() and (exact <= high).all()


def test_bounds_stop_most_queries(monkeypatch):
    """On vectors of even directions, in a large and a small block: few candidates are scored in full."""
    rng = np.random.default_rng(8)
    scored, chosen = [], T._chosen
    monkeypatch.setattr(T, "_chosen", lambda scores, ids, k: scored.append(len(scores)) or chosen(scores, ids, k))
    for n in (2000, 500):
        ids = np.arange(n)
        values = np.floor(64 * rng.normal(size=(n, 64)) / 8).astype(np.int32)
        scored.clear()
        got = {q: (c.tolist(), s.tolist()) for q, c, s in T.search(T.Lists(ids, values), ids[:40], values[:40])}
        assert sum(k <= n // 16 for k in scored) >= 20
        want = brute_force(ids.tolist(), values, range(40), 20)
        assert [(q, r + 1, v, s) for q in range(40) for r, (v, s) in enumerate(zip(*got[q]))] == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0, 0, 0), (0, [1.0, 2.0], 0, 0, 0), (1, [1.0], 0, 0, 0), (2, None, 0, 0, 0), (3, [None, 1.0], 0, 0, 0),
            (4, [float("nan")], 0, 0, 0), (5, [float("inf"), 0.0], 0, 0, 0), (None, [1.0, 1.0], 0, 0, 0), (7, [], 0, 0, 0),
            (40, [-0.01, 0.5], 0, 0, 0)]
    got = run(spark, rows)
    assert [(q, v, s) for q, _, v, s in got] == [(0, 1, 4096), (0, 40, 4032), (0, 7, 0), (40, 0, 4032), (40, 7, 0), (40, 1, -64)]
    assert run(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, -3.5], 0, 0, 0), (20, [2.0**40, 2.0**20], 0, 0, 0), (3, [-0.01, 1.5], 0, 0, 0), (4, [1.0, 0.0], 0, 0, 0),
            (5, [-1e6, 2.0], 0, 0, 0), (60, [0.0, 0.25], 0, 0, 0)]
    whole = np.array([[np.floor(64 * np.float64(np.float32(x))) for x in r[1]] for r in rows]).astype(np.int64)
    ids = [r[0] for r in rows]
    far = [r for r in rows if r[0] != 20]
    keep = [i for i, r in enumerate(rows) if r[0] != 20]
    assert run(spark, far) == brute_force([ids[i] for i in keep], whole[keep], (0, 60), 20)
    # Products of 2 ** 46 and 2 ** 36 need more than 64 bits: the scores among the best don't fit.
    with pytest.raises(Exception, match="does not fit 64 bits"):
        run(spark, rows)


def test_products_beyond_64_bits():
    """Scores that fit, of products that don't."""
    ids = np.arange(4)
    values = np.array([[2.0**40, 2.0**40, 1], [2.0**40, -(2.0**40), 7], [2.0**30, -(2.0**30), 5], [0, 0, 3]])
    got = {q: (c.tolist(), s.tolist()) for q, c, s in T.search(T.Lists(ids, values), ids[:1], values[:1])}
    assert got == {0: ([1, 2, 3], [7, 5, 3])}


def test_packs_of_queries_are_not_broadcast(spark):
    """Whatever the session broadcasts: guessed before packs are copied to every block, they seem small."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": str(64 << 20), "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
            "spark.sql.sources.fileCompressionFactor": "1"}
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        vectors = T.whole_vectors(frame(spark, [(i, [float(i % 7), 1.0], 0, 0, 0) for i in range(200)]))
        found = T.top_k(vectors, vectors.filter("vec_id % 20 = 0"))
        assert len(found.collect()) == 200
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Broadcast" not in plan and "Join" not in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_tiles_cover_every_pack_and_block():
    for blocks, packs, cores in [(1, 1, 6), (13, 6, 6), (151, 61, 6), (3662, 1504, 6), (3662, 1504, 4000), (1, 500, 8)]:
        for width in (1, 64, 768, 10**6):
            across, down = T._tiles(blocks, packs, cores, width)
            assert 1 <= across <= blocks and 1 <= down <= packs
            assert blocks <= across * T.MOST_BLOCKS and packs <= down * T.MOST_PACKS
            assert down == packs or -(-packs // down) * T.QUERIES_AT_ONCE * width <= T.MOST_COMPONENTS


def test_rows_of_many_tiles_are_exact(spark, monkeypatch):
    """Many equal vectors and scores, vectors of one id in several tiles, queries in several packs."""
    for name, value in (("BLOCK", 60), ("QUERIES_AT_ONCE", 7), ("MOST_BLOCKS", 3), ("MOST_PACKS", 2)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(9)
    values = rng.integers(-3, 4, (900, 5)) / 64
    values[200:500] = values[200]
    ids = rng.permutation(900)
    rows = [(int(i), [float(x) for x in v], 0, 0, 0) for i, v in zip(ids, values)]
    assert run(spark, rows) == brute_force(ids.tolist(), np.rint(64 * values).astype(np.int64), range(0, 900, 20), 20)


@pytest.mark.parametrize("scale, kind", [(1, np.float32), (1 << 9, np.float64), (1 << 35, np.int64), (1 << 45, object)])
def test_best_of_blocks_one_after_another(scale, kind):
    """In each type that products need: single, double, long, and Python's whole numbers for some of the blocks."""
    rng = np.random.default_rng(10)
    values = np.rint(rng.normal(size=(700, 16)) * 40)
    values[100:300] = values[100]
    values[400:] *= scale
    assert T._kind(values[:30], values[400:650]) is kind
    ids = rng.permutation(700)
    best, step = T.Best(ids[:30], values[:30], 20), 1
    for at in (0, 5, 12, 130, 400, 650):
        to = {0: 5, 5: 12, 12: 130, 130: 400, 400: 650, 650: 700}[at]
        step = best.read(T.Lists(ids[at:to], values[at:to]), step)
    got = sorted(zip(*(c.to_pylist() for c in best.rows().columns)))
    want = brute_force(ids.tolist(), values.astype(np.int64), ids[:30].tolist(), 20)
    assert got == sorted((q, i, s) for q, _, i, s in want)


def test_later_blocks_stop_by_the_best_so_far(monkeypatch):
    """Random directions: of later blocks few candidates get full scores, and no lists are read to their end."""
    rng = np.random.default_rng(11)
    values = np.floor(8 * rng.normal(size=(24_000, 64))).astype(np.float32)
    ids, better, scored = np.arange(24_000), T.Best._better, []
    monkeypatch.setattr(T.Best, "_better", lambda self, *a: scored.append(len(a[1])) or better(self, *a))
    best, step = T.Best(ids[:200], values[:200], 20), 1
    for at in range(0, 24_000, 2_000):
        scored.clear()
        step = best.read(T.Lists(ids[at : at + 2_000], values[at : at + 2_000]), step)
    assert 0 < sum(scored) < 0.05 * 200 * 2_000 and step <= 5
    got = sorted(zip(*(c.to_pylist() for c in best.rows().columns)))
    assert got == sorted((q, i, s) for q, _, i, s in brute_force(ids.tolist(), values.astype(np.int64), range(200), 20))
