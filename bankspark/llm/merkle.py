"""Merkle manifest of a dataset whose parents keep SHA-256 states.

A leaf is the hash of a row's fields. The leaves of a source, by doc_id, form a tree of FANOUT children; the
sources' roots, by source, form another. A parent hashes its children's hex digests one after the other and keeps
a copy of the hash state before each of them. To fold a changed leaf up to the root, each level resumes the state
kept before the leaf's slot, feeds the replacement and the siblings right of it; siblings on the left are not read.

Trees are built by blocks of FANOUT ** LEVELS nodes that follow each other, a block at a time in a task, so
a source of any size spreads over tasks, and a billion leaves take three rounds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bankspark.llm import sha_states as S
from bankspark.llm.store import new_folder, stored
from bankspark.operators.ordering import global_positions

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows that a task works on at once.
ROWS_AT_ONCE = 16_384
# Up to so many sources (about 40 bytes and the name each) are broadcast; beyond that, only those with more than one
# in so many of all rows, which are fewer.
BROADCAST_ROWS = 1_000_000

# A step of a path: the place among FANOUT children and their number, the state before that place, the siblings.
_STEP = np.dtype([("slot", "u1"), ("size", "u1"), ("state", ">u4", 8), ("others", ">u4", (FANOUT - 1, 8))])
_NODES = "part bigint, place bigint, total bigint, digest binary"
_PATHS = "part bigint, block bigint, path binary, subroot binary, root binary"
_PROOFS = "doc_id bigint, leaf binary, subroot binary, root binary, proof binary, folded binary"


def leaf(text: Column | None = None) -> Column:
    """Digest (binary) of a row of FIELDS, of ``text`` in place of its text if given."""
    def part(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, FIELDS)), 256))


@dataclass
class _Level:
    """One level of some blocks: the step up from each node, and each node's parent. Nodes that are a root have no step."""

    steps: np.ndarray
    moves: np.ndarray
    parent: np.ndarray


def _climbed(height: int, block: np.ndarray, place: np.ndarray, total: np.ndarray, digest: np.ndarray) -> tuple[list[_Level], tuple]:
    """The levels of whole blocks, whose nodes are in order, and the one node that each block ends in."""
    levels = []
    for _ in range(height):
        moves = total > 1
        if not moves.any():
            break
        run = place // FANOUT
        first = np.concatenate((np.ones(min(1, len(run)), bool), (block[1:] != block[:-1]) | (run[1:] != run[:-1])))
        starts = np.flatnonzero(first)
        parent, size = np.cumsum(first) - 1, np.diff(starts, append=len(run))
        slot = np.arange(len(run)) - starts[parent]
        text = S.written(digest)
        state, kept = S.started(len(starts)), np.zeros((len(starts), FANOUT, 8), np.uint32)
        for k in range(FANOUT):
            kept[:, k] = state
            more = np.flatnonzero(size > k)
            state[more] = S.resumed(state[more], text[starts[more] + k])
        steps = np.zeros(len(run), _STEP)
        steps["slot"], steps["size"], steps["state"] = slot, size[parent], kept[parent, slot]
        for k in range(FANOUT - 1):
            # The k-th sibling is the child at place k, or at k + 1 from the own slot on.
            other = k + (slot <= k)
            there = np.flatnonzero(other < size[parent])
            steps["others"][there, k] = digest[starts[parent[there]] + other[there]]
        levels.append(_Level(steps, moves, parent))
        up = S.ended(state, size)
        up[~moves[starts]] = digest[starts][~moves[starts]]
        block, place, total, digest = block[starts], run[starts], -(-total[starts] // FANOUT), up
    return levels, (block, place, total, digest)


def _folded(value: np.ndarray, steps: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The parents' digests (n, 8) with ``value`` in place of the child that each step is for."""
    at = np.flatnonzero(moves)
    steps, out = steps[at], value.copy()
    slot, size = steps["slot"].astype(np.int64), steps["size"].astype(np.int64)
    state = S.resumed(steps["state"].astype(np.uint32), S.written(value[at]))
    others = steps["others"].astype(np.uint32)
    for k in range(FANOUT - 1):
        right = np.flatnonzero((k >= slot) & (k < size - 1))
        state[right] = S.resumed(state[right], S.written(others[right, k]))
    out[at] = S.ended(state, size)
    return out


def _siblings(steps: np.ndarray) -> bytes:
    """Hex digests of the siblings along a path, level by level, from left to right."""
    return b"".join(others[: size - 1].tobytes() for others, size in zip(steps["others"], steps["size"])).hex().encode()


def _whole_blocks(batches, columns: tuple[str, ...]):
    """Columns of whole blocks of ``(part, block)``, in parts of about ROWS_AT_ONCE rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held)
            part, block = (table.column(c).to_numpy() for c in ("part", "block"))
            last = int(np.flatnonzero((part != part[-1]) | (block != block[-1]))[-1]) + 1 if part[0] != part[-1] or block[0] != block[-1] else 0
            if last:
                yield [table.slice(0, last).column(c) for c in columns]
                held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
    if rows:
        yield [pa.Table.from_batches(held).column(c) for c in columns]


def _up(levels: int):
    def up(batches):
        for part, block, place, total, digest in _whole_blocks(batches, ("part", "block", "place", "total", "digest")):
            part, block, place, total = (x.to_numpy() for x in (part, block, place, total))
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])))
            first = np.flatnonzero(new)
            _, (_, _, left, top) = _climbed(levels, np.cumsum(new), place, total, S.numbers(digest.to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[first]), pa.array(block[first]), pa.array(left), pa.array(S.as_bytes(top), pa.binary())],
                [c.split()[0] for c in _NODES.split(", ")])

    return up


def _down(levels: int, leaves: bool):
    """Each block's rows follow the row with the path above the block. Gives the paths of nodes, or leaves folded up to the root."""
    names = ("part", "block", "place", "total", "digest", "doc_id", "changed", "path", "subroot", "root")

    def down(batches):
        for columns in _whole_blocks(batches, names):
            part, block, place, total = (x.fill_null(-1).to_numpy() for x in columns[:4])
            head = np.concatenate(([True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])))
            starts = np.flatnonzero(head)
            above = [c.take(pa.array(starts)).to_pylist() for c in columns[7:]]
            rows = np.flatnonzero(~head)
            of = (np.cumsum(head) - 1)[rows]
            inner = [c.take(pa.array(rows)) for c in columns]
            digest = S.numbers(inner[4].to_pylist())
            climbed, _ = _climbed(levels, of, place[rows], total[rows], digest)
            at = np.arange(len(rows))
            steps, height = np.zeros((len(rows), len(climbed)), _STEP), np.zeros(len(rows), np.int64)
            for k, level in enumerate(climbed):
                steps[:, k] = level.steps[at]
                height += level.moves[at]
                at = level.parent[at]
            paths, subroot, root = above
            if not leaves:
                yield pa.RecordBatch.from_arrays(
                    [inner[0].combine_chunks(), inner[2].combine_chunks(),
                     pa.array([steps[i, :h].tobytes() + paths[k] for i, h, k in zip(range(len(rows)), height, of)], pa.binary()),
                     pa.array([subroot[k] for k in of], pa.binary()), pa.array([root[k] for k in of], pa.binary())],
                    [c.split()[0] for c in _PATHS.split(", ")])
                continue
            value = S.numbers([c or d for c, d in zip(inner[6].to_pylist(), inner[4].to_pylist())])
            for k in range(steps.shape[1]):
                value = _folded(value, steps[:, k], height > k)
            upper = [np.frombuffer(p, _STEP) for p in paths]
            longest = max(map(len, upper))
            padded = np.zeros((len(upper), longest), _STEP)
            for k, path in enumerate(upper):
                padded[k, : len(path)] = path
            far = np.fromiter(map(len, upper), np.int64, len(upper))[of]
            for k in range(longest):
                value = _folded(value, padded[of, k], far > k)
            ends = [_siblings(path) for path in upper]
            proofs = [
                hashlib.sha256(_siblings(steps[i, :h]) + ends[k]).digest() for i, h, k in zip(range(len(rows)), height, of)]
            yield pa.RecordBatch.from_arrays(
                [inner[5].combine_chunks(), inner[4].combine_chunks(),
                 pa.array([subroot[k] for k in of], pa.binary()), pa.array([root[k] for k in of], pa.binary()),
                 pa.array(proofs, pa.binary()), pa.array(S.as_bytes(value), pa.binary())],
                [c.split()[0] for c in _PROOFS.split(", ")])

    return down


def _blocks(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("part", "block").sortWithinPartitions("part", "block", *order)


def _rounds(total: int, levels: int) -> int:
    """How often so many nodes are reduced by blocks, until one is left."""
    n = 0
    while total > 1:
        total, n = -(-total // FANOUT**levels), n + 1
    return n


def _tree(nodes: DataFrame, most: int, levels: int, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round starts from, and the roots ``(part, place, total, digest)`` of all parts.

    ``most`` is the size of the largest part.
    """
    started = []
    for k in range(_rounds(most, levels)):
        nodes = nodes.select("part", "place", "total", "digest")
        started.append(nodes)
        rows = nodes.withColumn("block", F.expr(f"place div {FANOUT**levels}"))
        nodes = stored(_blocks(rows, "place").mapInArrow(_up(levels), _NODES), folder, f"round-{k + 1}")
    return started, nodes


def _under(nodes: DataFrame, paths: DataFrame, levels: int, leaves: bool = False) -> DataFrame:
    """One pass down: the block's path goes before the nodes of the block."""
    if not leaves:
        nodes = nodes.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("changed", F.lit(None).cast("binary"))
    rows = nodes.withColumn("block", F.expr(f"place div {FANOUT**levels}")).withColumn("turn", F.lit(1))
    rows = rows.unionByName(paths.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    return _blocks(rows, "turn", "place").mapInArrow(_down(levels, leaves), _PROOFS if leaves else _PATHS)


def _paths(started: list[DataFrame], paths: DataFrame, levels: int, folder: str) -> DataFrame:
    """Paths of the blocks of the first round's nodes, from the paths above the roots."""
    for k in range(len(started) - 1, 0, -1):
        paths = stored(_under(started[k], paths, levels), folder, f"paths-{k}")
    return paths


def _numbered(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number of their source and their place in it; the sources, numbered."""
    # Written first: the split into ranges looks at the rows once more.
    keyed = stored(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))), folder, "rows")
    # Equal rows have equal leaves, so it does not matter which of them comes first.
    tie = F.xxhash64("leaf", F.monotonically_increasing_id())
    leaves = global_positions(keyed.withColumn("tie", tie), ["source", "doc_id", "leaf", "tie"]).drop("tie", "source")
    sources = leaves.groupBy("key").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("total"))
    # In the order of their leaves, which is null first and then by the bytes of the name.
    numbered = stored(global_positions(sources, ["first"], "number").select(
        "key", "first", "total", (F.col("number") - 1).alias("part")), folder, "sources")
    if numbered.count() <= BROADCAST_ROWS:
        joined = leaves.join(F.broadcast(numbered), "key")
    else:
        often = F.col("total") > leaves.count() / BROADCAST_ROWS
        many = F.broadcast(numbered.filter(often))
        joined = leaves.join(many, "key").unionByName(
            leaves.join(F.broadcast(numbered.filter(often).select("key")), "key", "left_anti").join(numbered.filter(~often), "key"))
    placed = joined.select("part", (F.col("position") - F.col("first")).alias("place"), "total", F.col("leaf").alias("digest"), "changed", "doc_id")
    return placed, numbered


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``docs`` needs FIELDS; other columns are left out. ``changed`` is the leaf of the row as it is now (see ``leaf``),
    null where nothing changed; ``folded_root`` is the root with that leaf and the siblings of the manifest, and
    ``verified`` says whether it is ``root``. A field that is null counts as ``-``, an empty one as ``0:``. Leaves of
    a source ascend by doc_id, null first, those of one doc_id by their digest; repeated rows are leaves of their own.
    Null is a source of its own, before the others. A source of one row is its own leaf, a dataset of one source
    that source's root, without siblings the proof is the hash of nothing. Texts of any length are hashed whole.
    An empty table gives no rows.
    """
    folder = new_folder(docs.sparkSession, "merkle")
    none = F.lit(None).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("leaf"),
        (none if changed is None else changed).alias("changed"))
    placed, sources = _numbered(rows, folder)
    sizes = sources.agg(F.max("total"), F.count(F.lit(1))).first()
    leaves = stored(placed, folder, "placed")
    started, subroots = _tree(leaves, sizes[0] or 0, levels, folder)
    subroots = subroots.select(
        F.lit(0).cast("bigint").alias("part"), F.col("part").alias("place"), F.lit(sizes[1]).cast("bigint").alias("total"), "digest")
    top, roots = _tree(subroots, sizes[1], levels, f"{folder}/top")
    empty = F.lit(b"")
    above = roots.select("part", F.col("place").alias("block"), empty.alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
    above = _paths(top, above, levels, f"{folder}/top")
    if top:
        above = _under(subroots, above, levels)
    # Of the paths of the sources' roots, the place is the source.
    name = F.col("block") if top else F.col("part")
    named = above.select(name.alias("part"), "path", "root").join(
        subroots.select(F.col("place").alias("part"), F.col("digest").alias("subroot")), "part")
    above = stored(named.select("part", F.lit(0).cast("bigint").alias("block"), "path", "subroot", "root"), folder, "sources-paths")
    proofs = _under(leaves, _paths(started, above, levels, folder), levels, True)
    text = lambda c: F.lower(F.hex(c))
    return proofs.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
