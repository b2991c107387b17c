"""Benchmark passages against a search of every window."""

import random
from collections import Counter

import numpy as np

from bankspark.llm import decontamination as D


def brute_force(rows, items):
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for doc_id, text in rows:
        words = D.words_of(text)
        for item_id, item in items:
            want = D.words_of(item)
            best = max((D.weighted_similarity(shingles(words[max(0, s) : s + len(want)]), shingles(want))
                        for s in range(-len(want), len(words))), default=0)
            if best >= D.SIMILARITY:
                out[doc_id, item_id] = round(best, 9)
    return out


def found(df):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in df.collect()}


def test_passages(spark, documents, odd):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate((5, 9, 16, 40, 59, 130, 300))]
    rows = list(odd)
    for k, (_, text) in enumerate(items):
        passage = text.split()
        rows.append((100 + k, " ".join(words(200) + [w.upper() + "!!" for w in passage] + words(200))))
        rows.append((200 + k, text))
        rows.append((300 + k, " ".join(words(50) + passage[: len(passage) // 2] + words(50))))
        if len(passage) >= 40:
            passage[len(passage) // 2] = "changed"
            rows.append((400 + k, " ".join(words(90) + passage)))
    benchmark = spark.createDataFrame(
        [(i, t, 1) for i, t in items] + [items[0] + (1,), (50, None, 1), (51, "", 1), (52, "too short", 1)],
        "item_id bigint, text string, doc_id int")
    got, want = found(D.contaminated(documents(rows), benchmark)), brute_force(rows, items)
    assert {k for k in want if k[0] < 400} <= set(got) <= set(want)
    # A changed word may move a fingerprint out of the radius; most stay inside.
    assert len(got) >= len(want) - 2 and all(got[k] == want[k] for k in got)
    clean = D.without_contaminated(documents(rows), benchmark)
    assert clean.columns == documents(rows).columns
    bad = {d for d, _ in got}
    assert clean.count() == sum(1 for r in rows if r[0] not in bad)


def test_several_passes_give_the_same(spark, documents, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(6)]
    docs = documents([(k, f"x y z {t} end") for k, t in items])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(D, "WORDS_AT_ONCE", 30)
    assert set(found(D.contaminated(docs, benchmark))) == {(k, k) for k in range(6)}
    assert D.without_contaminated(docs, benchmark).count() == 0


def test_empty_tables(spark, documents, odd):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert D.contaminated(documents([]), benchmark).count() == 0
    assert D.contaminated(documents(odd), benchmark.limit(0)).count() == 0
    assert D.without_contaminated(documents(odd), benchmark.limit(0)).count() == len(odd)


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    item = D.Item(1, rng.integers(0, 1 << 64, 20, np.uint64), Counter(), np.empty(0, np.uint64))
    index = D.Index(20, [item])
    base = int(index.prints[0])
    for flips in range(D.RADIUS + 1):
        for _ in range(50):
            value = base
            for bit in rng.choice(64, flips, replace=False):
                value ^= 1 << int(bit)
            assert len(index.within_radius(np.array([value], np.uint64))[0]) == 1


def test_fingerprints_against_counting():
    hashes = np.random.default_rng(2).integers(0, 1 << 64, 50, np.uint64)
    got = D.fingerprints(D.prefix_sums(hashes), 7)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for k in range(44):
        above = bits[k : k + 7].sum(0) > 3
        want = sum(1 << (8 * (j % 8) + j // 8) for j in np.flatnonzero(above).tolist())
        assert int(got[k]) == want


def test_recall_of_edited_passages():
    """Of passages with one changed word that are still similar, for each length of the item."""
    import pyarrow as pa

    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    for length in (11, 12, 14, 16, 18, 20, 25, 32, 40, 60, 120, 200):
        items = [(k, " ".join(words(length))) for k in range(40)]
        look, rows, want = D.Search(items), [], set()
        for k, text in items:
            for place in (0, 1, 2, length // 2, length - 3, length - 2, length - 1):
                own = text.split()
                own[place] = "changed"
                if D.weighted_similarity(shingles(own), shingles(text.split())) >= D.SIMILARITY:
                    want.add((len(rows), k))
                rows.append(" ".join(words(60) + own + words(60)))
        got = {(d, item) for d, item, *_ in look(pa.array(rows))}
        assert want and len(got & want) >= 0.97 * len(want), (length, len(got & want), len(want))


def test_windows():
    assert D.windows(5) == {5: [0]} and D.windows(10) == {10: [0]}
    assert D.windows(12) == {12: [0], 10: [1]}
    for length in range(5, 400):
        for size, places in D.windows(length).items():
            assert places[0] >= 0 and places[-1] + size <= length and 5 <= size <= D.LARGEST_WINDOW
        assert min(min(p) for p in D.windows(length).values()) == 0
