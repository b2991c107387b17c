"""Quadtree traversal and the whole audit against plain sums over all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bankspark.llm import divergence as D, quadtree as Q


def test_prices():
    n, total = np.array([0, 5, 10**13, 0]), np.array([1, 7, 10**13 + 5, 9 * 10**15])
    assert Q.price(n, total).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), total.tolist())]
    with pytest.raises(OverflowError):
        Q.price(np.array([0]), np.array([10**16]))


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("density", [0.0, 0.02, 0.6])
def test_traversal(monkeypatch, same, density):
    monkeypatch.setattr(Q, "ITEMS_AT_ONCE", 5000)
    rng = np.random.default_rng(5)
    sizes, tiles, wide = (13, 13 if same else 40), np.array([3, 4, 9]), np.array([64, 64, 17])
    dense = []
    for size in sizes:
        values = rng.integers(1, 10**6, (3, size, 64)) * (rng.random((3, size, 64)) < density)
        values[2, :, 17:] = 0
        dense.append(values)
    dense[1] = dense[0] if same else dense[1]
    empty = [rng.integers(1, 1000, s) for s in sizes]
    empty[1] = empty[0] if same else empty[1]
    trees = []
    for values in dense:
        tile, row, column = np.nonzero(values)
        order = rng.permutation(len(tile))
        trees.append(Q.Quadtree(tiles[tile][order], row[order], column[order], values[tile, row, column][order]))
    one, back, blank = Q.pair_gaps(*trees, sizes, tuple(empty), tiles, wide, same)
    for x in range(sizes[0]):
        for y in range(x + 1 if same else 0, sizes[1]):
            want, again, none = 0, 0, 0
            for t, w in enumerate(wide):
                a, b = dense[0][t, x, :w], dense[1][t, y, :w]
                some = (a > 0) | (b > 0)
                p, q = np.where(a > 0, a, empty[0][x])[some], np.where(b > 0, b, empty[1][y])[some]
                want, again, none = want + Q.gap(p, q).sum(), again + Q.gap(q, p).sum(), none + (~some).sum()
            assert (one[x, y], back[x, y], blank[x, y]) == (want, again, none)


def plain(rows, least=3, best=200):
    rows = [[x or "" for x in r] for r in rows]
    found = lambda t: [
        re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        counts[lang, source].update(found(text))
        docs[lang].update(set(found(text)))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [g for g in counts if g[0] == lang]
        total = Counter()
        for g in mine:
            total.update({t: counts[g][t] for t in kept})

        def prices(c):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        whole, each = prices(total), {g: prices(counts[g]) for g in mine}
        for g in mine:
            pairs = [(-sum((each[g][t] - each[h][t]) ** 2 // each[h][t] for t in kept), h[1].encode()) for h in mine if h != g]
            words = [(-((each[g][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if counts[g][t] and each[g][t] > whole[t]]
            for part, of, most in (("pair", pairs, len(pairs)), ("term", words, best)):
                out += [(*g, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(of)[:most])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["É", "中文", "Straße", "WAA", "waa"]
    draw = lambda m: " ".join(words[min(int(rng.exponential(70)), len(words) - 1)] + "1-"[rng.integers(2)] for _ in range(m))
    rows = [(draw(int(rng.integers(0, 60))), "en", f"s{k % 70}") for k in range(260)]
    rows += [(draw(9) * 300, "en", "hot"), (None, "en", None), (" 12 ", None, "a"), ("x x x", None, ""), ("lone", "fr", "a"), ("word", "fr", "b")]
    return rows + [("same same", "de", "one")] * 5


@pytest.mark.parametrize("width, best", [(D.SLICE, 200), (64, 3)])
def test_audit(spark, monkeypatch, width, best):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 1_000_000 if best == 200 else 1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus()], "text string, lang string, source string, n int, part string")
    got = D.source_divergence(docs, best=best, width=width).collect()
    assert sorted(map(tuple, got)) == plain(corpus(), best=best)


def test_counts_in_parts(monkeypatch):
    monkeypatch.setattr(D, "COUNTED_AT_ONCE", 20)
    texts = [f"hot hot w{chr(97 + k % 26)} x{chr(97 + k // 26)} hot hot" for k in range(60)]
    batches = [pa.record_batch({"text": texts[k : k + 5], "lang": ["en"] * 5, "source": ["a", "a", "b", "b", "b"]}) for k in range(0, 60, 5)]
    n, docs, hot = Counter(), Counter(), 0
    for batch in D._counted(batches):
        for r in batch.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
            hot += r["term"] == "hot"
    want, in_docs = Counter(), Counter()
    for k, text in enumerate(texts):
        source = "aabbb"[k % 5]
        want.update((source, w) for w in text.split())
        in_docs.update((source, w) for w in set(text.split()))
    assert (n, docs) == (want, in_docs) and hot < 24


def test_nothing(spark, documents):
    assert D.source_divergence(documents([])).count() == 0
    assert D.source_divergence(documents([(1, None), (2, "a")])).count() == 0
    with pytest.raises(ValueError):
        D.source_divergence(documents([]), width=65)
