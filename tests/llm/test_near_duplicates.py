"""Groups of near copies against brute force."""

import random

import pytest

from bankspark.llm import near_duplicates as N
from bankspark.llm.components import components
from bankspark.llm.near_duplicates import near_duplicates, without_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_force(rows):
    """Smallest doc_id reachable for each row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_rows(documents, odd):
    rows = odd + [(20, "ONE two\tthree"), (21, "one two three four"), (22, "A B C D E F G H")]
    assert found(near_duplicates(documents(rows))) == brute_force(rows)


def test_empty_table(documents):
    assert found(near_duplicates(documents([]))) == []
    assert without_copies(documents([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(documents, seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9000)}"
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    assert found(near_duplicates(documents(rows))) == brute_force(rows)


def test_dense_group_and_copies(documents):
    """One group far larger than a region, exact copies, and a text that only one member is like."""
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[:190] + [f"x{k}", f"y{k}"])) for k in range(300)]
    rows += [(1000 + k, "same text of six words here") for k in range(200)]
    rows += [(2000, " ".join(words[:190] + ["x7", "y7", *[f"z{j}" for j in range(55)]]))]
    assert found(near_duplicates(documents(rows))) == brute_force(rows)


def test_hub_of_many_copies(documents, monkeypatch):
    """Each copy is like the base only, so the base is the one link between thousands; also over several blocks."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = [(9000, " ".join(base)), (9001, " ".join(base[:100]))]
    for k in range(2200):
        words = list(base)
        for part in range(5):
            words[40 * part + rng.randrange(5, 35)] = f"e{k}.{part}"
        rows.append((k, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets[2:])
    rng.shuffle(rows)
    for block in (2048, 300):
        monkeypatch.setattr(N, "BLOCK", block, raising=False)
        got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows)).collect()}
        assert got.pop(9001) == 9001
        assert len(got) == 2201 and set(got.values()) == {0}


def test_one_of_each_group_stays(documents, odd):
    rows = odd + [(30, "one two three")]
    kept = without_copies(documents(rows))
    assert kept.columns == documents(rows).columns
    # 6 names two texts; both stay. A row without an id can't be named and stays.
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 6, 9]
    assert kept.filter("doc_id is null").count() == 1


def test_components_of_a_path_and_a_star(spark, tmp_path):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(1, k) for k in range(2, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + [(5, 5)], "a bigint, b bigint"), str(tmp_path)).collect()}
    assert len({got[k] for k in range(100, 161)}) == 1 and len({got[k] for k in range(1, 60)}) == 1
    assert got[1] != got[100]


def test_many_rows_without_id_and_a_dense_group(documents):
    """Near copies of which half have no id, and texts that share one id: each text is found once."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k if k % 2 else None, " ".join([*words, f"x{k}"])) for k in range(1500)]
    rows += [(5000, " ".join([f"v{j}" for j in range(40)] + [f"y{k}"])) for k in range(300)] + [(None, "alone among the texts here")]
    got = near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.component_id, r.kept) for r in got if r.n_shingles == 57} == {(1, True), (1, False)}
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles == 37} == {(5000, 5000, True)}
    assert [(r.component_id, r.kept) for r in got if r.n_shingles == 1] == [(None, False)]


def test_tasks_hand_out_fewer_links_than_nodes():
    import numpy as np
    import pyarrow as pa

    from bankspark.llm.words import distinct

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [distinct(np.concatenate((base[: 400 - 8], rng.integers(0, 1 << 63, 8).astype(np.uint64)))) for _ in range(300)]
    signatures = N.signatures(sets, range(N.TREES * N.DEPTH, N.TREES * N.DEPTH + N.WIDE)).astype(np.uint8)
    nodes = np.arange(300)
    batch = pa.record_batch({
        "tree": np.zeros(300, np.int32), "region": np.ones(300, np.int64), "low": np.zeros(300, np.int64), "high": np.zeros(300, np.int64),
        "side": np.zeros(300, np.int32), "node": nodes, "size": np.full(300, 400), "label": nodes,
        "sketch": pa.array([r.tobytes() for r in signatures], pa.binary()),
        "heads": pa.array([np.zeros(N.TREES, np.uint32).tobytes()] * 300, pa.binary()),
        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    for cuts in ([300], [100, 7, 193]):
        parts = [batch.slice(a, n) for a, n in zip(np.cumsum([0, *cuts[:-1]]).tolist(), cuts)]
        links = sum((out.to_pylist() for out in N._crossed(iter(parts))), [])
        assert len(links) == 299
        # In a later order the pairs have met before.
        later = [p.set_column(0, "tree", pa.array(np.ones(p.num_rows, np.int32))) for p in parts]
        assert sum(out.num_rows for out in N._crossed(iter(later))) == 0
