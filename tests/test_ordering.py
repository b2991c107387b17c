import random

from pyspark.sql import functions as F

from bankspark.operators.ordering import append_with_ids, global_positions, has_large_group, paged, positions_within


def skewed(frame, n=3000):
    """One key holds a third of all rows."""
    random.seed(7)
    rows = [((0 if i % 3 == 0 else random.randrange(1, 200)), i, random.random()) for i in range(n)]
    random.shuffle(rows)
    return frame("k BIGINT, id BIGINT, x DOUBLE", rows).repartition(7)


def test_global_positions(frame):
    df = skewed(frame)
    got = {r.id: r.position for r in global_positions(df, ["x", "id"]).collect()}
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.x, r.id)), start=1)}
    assert got == want


def test_positions_within_both_ways(frame):
    df = skewed(frame)
    rows = df.collect()
    want = {}
    for key in {r.k for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r.k == key), key=lambda r: (r.x, r.id)), start=1):
            want[r.id] = i
    for limit in (10_000, 100):
        got = positions_within(df, ["k"], ["x", "id"], limit=limit).collect()
        assert {r.id: r.position for r in got} == want


def test_null_group_is_a_group(frame):
    df = frame("k STRING, id BIGINT", [(None, 3), (None, 1), ("a", 2)])
    for limit in (10, 1):
        got = {r.id: r.position for r in positions_within(df, ["k"], ["id"], limit=limit).collect()}
        assert got == {1: 1, 3: 2, 2: 1}


def test_pages(frame):
    df = skewed(frame)
    assert has_large_group(df, ["k"], 100) and not has_large_group(df, ["k"], 1000)
    small, keys = paged(df, ["k"], ["id"], 1000)
    assert keys == ["k", "page_no"] and small.filter("page_no <> 0").isEmpty()
    pages, keys = paged(df, ["k"], ["id"], 100)
    sizes = {(r.k, r.page_no): r["count"] for r in pages.groupBy(*keys).count().collect()}
    assert sum(sizes.values()) == 3000
    assert sizes[(0, 0)] == 100 and sizes[(0, 9)] == 100 and (0, 10) not in sizes
    hot = pages.filter("k = 0 AND page_no = 3").agg(F.min("id"), F.max("id")).first()
    assert tuple(hot) == (900, 1197)


def test_append_starts_above_base_and_target(frame):
    rows = frame("name STRING", [("b",), ("a",), ("c",)])
    got = {r.name: r.id for r in append_with_ids(None, rows, "id", ["name"], base=300000).collect()}
    assert got == {"a": 300000, "b": 300001, "c": 300002}
    target = frame("id BIGINT", [(300010,)])
    got = {r.name: r.id for r in append_with_ids(target, rows, "id", ["name"], base=300000).collect()}
    assert got == {"a": 300011, "b": 300012, "c": 300013}
    empty = target.filter("id < 0")
    assert append_with_ids(empty, rows, "id", ["name"]).agg(F.min("id")).first()[0] == 1
