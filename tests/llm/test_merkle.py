"""Hash states against hashlib; trees, proofs and folds against a plain build."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bankspark.llm import merkle as M, sha_states as S


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_states():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(7)]
    each = S.numbers(digests)
    assert S.as_bytes(each) == digests
    state = S.started(7)
    for n in range(4):
        assert S.as_bytes(S.ended(state, np.full(7, n))) == [hashlib.sha256(d.hex().encode() * n).digest() for d in digests]
        state = S.resumed(state, S.written(each))


def plain(rows, changed):
    """Rows of (doc_id, text, source, lang, n_chars), and the changed text of some, by their place."""
    def leaf(row, text):
        doc_id, _, source, lang, n = row
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def fold(levels, place, value):
        siblings = []
        for level in levels[:-1]:
            run = [value if k == place else level[k] for k in range(place - place % 3, min(len(level), place - place % 3 + 3))]
            siblings += [x for k, x in enumerate(run) if k != place % 3]
            value, place = H(*run), place // 3
        return value, siblings

    order = lambda v: (v is not None, v)
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, of = [], {}
    for source in sources:
        mine = sorted([(order(r[0]), leaf(r, r[1]), k) for k, r in enumerate(rows) if r[2] == source])
        of |= {k: (len(trees), place) for place, (_, _, k) in enumerate(mine)}
        trees.append(climb([x[1] for x in mine]))
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, row in enumerate(rows):
        tree, place = of[k]
        value, inner = fold(trees[tree], place, leaf(row, changed.get(k, row[1])))
        value, outer = fold(top, tree, value)
        root = top[-1][0]
        out.append((str(row[0]), leaf(row, row[1]), trees[tree][-1][0], root, H(*inner, *outer), value, value == root))
    return sorted(out)


def got(spark, rows, changed=True, levels=M.LEVELS):
    docs = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint, digest string, part int")
    now = F.when(F.col("text").contains("!"), M.leaf(F.replace("text", F.lit("!"), F.lit("")))) if changed else None
    return sorted((str(r[0]), *r[1:]) for r in M.manifest(docs, now, levels).collect())


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    hot = [(k, f"text {k}" + "!" * (k % 4 == 0), "hot", "en", 6 if k % 5 else None) for k in range(70)]
    few = [(k, ["", None, "!", "é!"][k % 4], f"s{k % 11:02}", None, k) for k in range(100, 124)]
    odd = [(None, "no id!", None, "en", 1), (None, "no id", None, "en", 1), (1, "long! " * 20_000, None, "de", 0), (5, "lone!", "ß", "", -3)]
    rows = hot + few + odd
    changed = {k: r[1].replace("!", "") for k, r in enumerate(rows) if "!" in (r[1] or "")}
    result = got(spark, rows, levels=levels)
    assert result == plain(rows, changed)
    assert {r[6] for r in result} == {True, False}


def test_blocks_stay_whole(monkeypatch):
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 16)
    part = np.repeat([0, 0, 1, 2, 2, 2], [5, 9, 30, 1, 2, 20])
    block = np.repeat([0, 1, 0, 0, 1, 2], [5, 9, 30, 1, 2, 20])
    batches = [pa.record_batch({"part": part[k : k + 4], "block": block[k : k + 4]}) for k in range(0, len(part), 4)]
    parts = [list(zip(p.to_pylist(), b.to_pylist())) for p, b in M._whole_blocks(batches, ("part", "block"))]
    assert [x for p in parts for x in p] == list(zip(part.tolist(), block.tolist()))
    assert len(parts) > 2 and all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))


def test_small(spark):
    one = [(1, "a!", "s", "en", 2)]
    assert got(spark, one) == plain(one, {0: "a"})
    assert got(spark, []) == []
    same = [(1, "a", "s", "en", 1)] * 5
    assert got(spark, same, changed=False) == plain(same, {})
    assert all(r[6] for r in got(spark, same, changed=False))
