"""Perfect hash, and dropped lines against a plain count, with and without routed probes."""

from collections import Counter

import numpy as np
import pytest

from bankspark.llm import line_dedup as L
from bankspark.llm.perfect_hash import CountIndex, PerfectHash


@pytest.mark.parametrize("n", [0, 1, 2, 65, 20_000])
def test_numbers_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 1 << 63, (2, n), np.uint64)
    perfect = PerfectHash.of(high, low)
    assert sorted(perfect.numbers(high, low).tolist()) == list(range(n))
    assert len(perfect.bits) * 64 <= 4 * n + 2000
    index = CountIndex.read(CountIndex.of(high, low, np.arange(n) + (1 << 40) * (np.arange(n) == 1)).row())
    assert index.of_keys(high, low).tolist() == [k if k != 1 else (1 << 32) - 1 for k in range(n)]
    others = rng.integers(0, 1 << 63, (2, 50_000), np.uint64)
    assert not index.of_keys(*others).any()


def test_keys_alike_in_one_half():
    high, low = np.array([5, 5, 6], np.uint64), np.array([7, 8, 7], np.uint64)
    assert sorted(PerfectHash.of(high, low).numbers(high, low).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        PerfectHash.of(high[[0, 0]], low[[0, 0]])


def plain(rows, least):
    def lower(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(key for _, text, *_ in rows for key in {lower(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not lower(x) or counts[lower(x)] < least]
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def repeated():
    rng = np.random.default_rng(1)
    lines = [f"line {k} of some" for k in range(60)] + ["", "  ", " ", "ÄÖ", "äö"]
    draw = lambda: lines[min(int(rng.exponential(12)), len(lines) - 1)]
    dress = lambda x, k: ["\t" + x + " \r", x.upper(), x.replace("l", "L"), x][k % 4]
    return [(k, "\n".join(dress(draw(), int(rng.integers(9))) for _ in range(int(rng.integers(0, 12))))) for k in range(150)]


@pytest.mark.parametrize("frequent, shard, probes", [(L.FREQUENT, L.SHARD_KEYS, L.PROBES), (25, 4, 50), (1, 1 << 18, 10)])
def test_lines(spark, documents, odd, monkeypatch, frequent, shard, probes):
    for name, value in (("FREQUENT", frequent), ("SHARD_KEYS", shard), ("PROBES", probes)):
        monkeypatch.setattr(L, name, value)
    rows = [*odd, *repeated(), (None, "line 1 of some\n" * 5000 + "alone"), (7, None)]
    for least in (2, 10):
        got = L.without_repeated_lines(documents(rows), least)
        assert got.columns[:8] == documents([]).columns and got.columns[8:] == ["n_lines", "n_dropped"]
        assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()) == plain(rows, least)


def test_tiers(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "FREQUENT", 25)
    monkeypatch.setattr(L, "SHARD_KEYS", 4)
    index = L.line_index(documents(repeated()), str(tmp_path), 2)
    by = {r.frequent: r["sum(n)"] for r in index.shards.groupBy("frequent").sum("n").collect()}
    assert 0 < by[True] < 25 and by[False] > 12 and index.others > 1
    assert index.shards.filter("not frequent").count() <= index.others


def test_nothing_and_clashing_names(spark, documents):
    assert L.without_repeated_lines(documents([])).count() == 0
    docs = spark.createDataFrame([("a\na", 1, 2)], "text string, n_lines int, N_DROPPED int")
    assert L.without_repeated_lines(docs, 1).collect() == [("", 1, 2, 2, 2)]
