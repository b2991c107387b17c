"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each of ``TREES`` sorted orders arranges the signatures by ``DEPTH`` hash values of its own. Documents that
share the first ``LEAST_DEPTH`` values form a region of that order. In small regions all meet; in
larger ones each document first meets its neighbours in sorted order, which share the longest prefixes with
it, so the depth follows the density of the region. What stays unconnected in a region is then compared whole, a
large region in pairs of blocks over many tasks. Candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from bankspark.llm.components import components
from bankspark.llm.store import new_folder, stored, unused
from bankspark.llm.words import ascii_words, distinct, release, shingle_hashes, slices, texts, word_hashes

TREES, DEPTH, LEAST_DEPTH = 16, 8, 2
HEAD = 2 * LEAST_DEPTH
# Documents of a region that are compared whole at once, and the width of the sliding view over larger regions.
REGION = 64
# Regions are compared whole afterwards, as far as they are not connected: in blocks of about so many nodes (a node
# counts once more for every ROOM shingles), a task per pair of blocks; the links of the first orders are counted in
# before the next are compared, so a text that links many is met early.
BLOCK, TILE, ROOM = 2048, 256, 4096
CROSSED_TREES = (range(0, 1), range(1, 4), range(4, TREES))
# Of so many sketch bytes, how many must agree: 5.2 standard deviations below what a pair of similarity 0.75
# has on average, so this loses about one such pair in ten million; it only saves comparing full sets.
NARROW, WIDE = 64, 512
SKETCH_AGREE = {NARROW: 30, WIDE: 333}
# Orders that give the links of the first round.
FIRST_TREES = 4
# Up to so many nodes (16 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_NO_ID = -(1 << 63)

_numbers = np.random.default_rng(10)
_FACTORS = (_numbers.integers(0, 1 << 32, TREES * DEPTH + WIDE, np.uint64) | np.uint64(1)).astype(np.uint32)
_MASKS = _numbers.integers(0, 1 << 32, TREES * DEPTH + WIDE, np.uint64).astype(np.uint32)

SETS = "doc_id bigint, pick bigint, n_shingles bigint, node bigint, node2 bigint, signature binary"


def signatures(sets: list[np.ndarray], functions: range = range(TREES * DEPTH)) -> np.ndarray:
    """For each set, 16 bits of the smallest value under each of the hash functions."""
    if not sets:
        return np.zeros((0, len(functions)), np.uint16)
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), len(functions)), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full) == 0:
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    for place, k in enumerate(functions):
        least = np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], starts)
        out[full, place] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_sets(column) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    words = [ascii_words(t) for t in texts(column)]
    hashes, at, out = word_hashes(words), 0, []
    for row in words:
        out.append(distinct(shingle_hashes(hashes[at : at + len(row)])))
        at += len(row)
    return out


def _node(values: np.ndarray) -> tuple[int, int]:
    key = xxh3_128_intdigest(values.tobytes())
    return _signed(key >> 64), _signed(key & (1 << 64) - 1)


def _summaries(batches):
    for batch in slices(batches, limit=2 << 20):
        sets = shingle_sets(batch.column("text"))
        nodes = [_node(s) if len(s) else (None, None) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("pick"), pa.array(map(len, sets), pa.int64()), pa.array([n[0] for n in nodes], pa.int64()),
                pa.array([n[1] for n in nodes], pa.int64()),
                pa.array([row.astype(">u2").tobytes() for row in signatures(sets)], pa.binary()),
            ],
            ["doc_id", "pick", "n_shingles", "node", "node2", "signature"],
        )


def _full_sets(batches):
    """Shingle sets and wide sketches of the texts whose set is the one that is asked for."""
    more = range(TREES * DEPTH, TREES * DEPTH + WIDE)
    for batch in slices(batches, limit=2 << 20):
        sets = shingle_sets(batch.column("text"))
        wanted = batch.column("node").to_pylist()
        keep = [i for i, s in enumerate(sets) if len(s) and _node(s)[0] == wanted[i]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([wanted[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary()),
                pa.array([row.astype(np.uint8).tobytes() for row in signatures([sets[i] for i in keep], more)], pa.binary()),
            ],
            ["node", "shingles", "wide"],
        )


def _agreeing(sketch: np.ndarray) -> np.ndarray:
    return (sketch[:, None, :] == sketch[None, :, :]).sum(2)


def _plausible(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of a region may be similar: by the sketches, and by 75 % of the larger size."""
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    return (_agreeing(sketch) >= SKETCH_AGREE[sketch.shape[1]]) & (100 * small >= 75 * large)


def _ranges(group: np.ndarray):
    """Parts of the rows to compare, from where each region starts: whole, or a view that moves by half its width."""
    for i, j in zip(group[:-1], group[1:]):
        if j - i <= REGION:
            if j - i > 1:
                yield i, j
        else:
            for k in range(i, j - REGION // 2, REGION // 2):
                yield k, min(j, k + REGION)


def _first_round(tree, node, size, sketch, label):
    """Nodes with a plausible partner as ``(a, a)``; in some orders, each node's smallest plausible partner."""
    may = _plausible(sketch, size)
    np.fill_diagonal(may, False)
    some = may.any(1)
    if not some.any():
        return None
    a = node[some]
    found = [np.stack([a, a], 1)]
    if tree < FIRST_TREES:
        partner = np.where(may[some], node[None, :], np.iinfo(np.int64).max).min(1)
        found.append(np.stack([np.minimum(a, partner), np.maximum(a, partner)], 1))
    return np.concatenate(found)


def _second_round(tree, node, size, sketch, label):
    """Each node's partner with the most alike sketch among those that no confirmed links connect to it so far."""
    if (label == label[0]).all():
        return None
    may = _plausible(sketch, size) & (label[:, None] != label[None, :])
    x = np.flatnonzero(may.any(1))
    if not len(x):
        return None
    y = np.where(may[x], _agreeing(sketch)[x], -1).argmax(1)
    return np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1)


def _scan(pairs, width):
    def scan(batches):
        carry = None
        for batch in batches:
            raw = lambda name, n: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, n)
            prefix = raw("prefix", 2 * DEPTH)
            columns = [batch.column(n).to_numpy() for n in ("tree", "node", "size", "label")]
            rows = [columns[0], prefix, columns[1], columns[2], raw("sketch", width), columns[3]]
            carry, out = step(rows if carry is None else [np.concatenate(x) for x in zip(carry, rows)], False)
            yield from out
        if carry is not None:
            yield from step(carry, True)[1]
        del carry
        release()

    def step(rows, last):
        tree, prefix, node, size, sketch, label = rows
        if len(tree) == 0:
            return None, []
        head = prefix[:, : 2 * LEAST_DEPTH]
        new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (head[1:] != head[:-1]).any(1)))
        group = np.flatnonzero(new)
        # The last region may go on in the next batch: it is looked at again from its start or its last rows.
        keep = max(int(group[-1]), len(tree) - 4 * REGION)
        group = np.concatenate((group, [len(tree)])) if last or keep != group[-1] else group
        found = [pairs(int(tree[i]), node[i:j], size[i:j], sketch[i:j], label[i:j]) for i, j in _ranges(group)]
        found = [f for f in found if f is not None]
        out = []
        if found:
            each = np.unique(np.concatenate(found), axis=0)
            out = [pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1])], ["a", "b"])]
        return [x[keep:] for x in rows], out

    return scan


def _candidates(nodes: DataFrame, pairs, width: int) -> DataFrame:
    """Distinct pairs that one pass over the sorted orders gives, of ``(node, size, signature, sketch, label)``."""
    trees = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "size", "label", "signature", "sketch"
    )
    # Big-endian numbers, so bytes sort as numbers.
    rows = trees.select(
        "tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("prefix"),
        "node", "size", "label", "sketch", F.xxhash64("node", "tree").alias("tie"),
    )
    order = ["tree", "prefix", "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(_scan(pairs, width), "a bigint, b bigint").distinct()


def _heads(nodes: DataFrame, trees: range) -> DataFrame:
    """The start of each node's prefix in each of some orders, with the node's label and how much room it takes."""
    each = nodes.select(F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree"), "node", "label", "heads", "size")
    room = (F.lit(1) + F.expr(f"size div {ROOM}")).cast("bigint")
    return each.select("tree", F.expr(f"substring(heads, tree * {HEAD} + 1, {HEAD})").alias("head"), "node", "label", room.alias("room"))


def _alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Agreeing bytes of each row of one sketch with each row of another."""
    one, other = np.ascontiguousarray(one.T), np.ascontiguousarray(other.T)
    total = np.zeros((one.shape[1], other.shape[1]), np.uint16)
    for k in range(0, len(one), 255):
        part = np.zeros(total.shape, np.uint8)
        for x, y in zip(one[k : k + 255], other[k : k + 255]):
            part += (x[:, None] == y[None, :]).view(np.uint8)
        total += part
    return total


def _similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
    return 100 * both >= 75 * (len(x) + len(y) - both)


class _Forest:
    """Labels that links have joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, label: int) -> int:
        while (above := self.up.get(label, label)) != label:
            self.up[label] = self.up.get(above, above)
            label = above
        return label

    def join(self, one: int, other: int) -> None:
        self.up[max(one, other)] = min(one, other)


def _crossed(batches):
    """Links of each two blocks (or one with itself), which lie next to each other.

    Every plausible pair of nodes that nothing connects yet is compared on the full sets, in the first of the orders
    where the two share a region; of the links, those that join something go out, fewer than there are nodes.
    """
    def compare(rows, sets):
        tree, _, low, high, side, node, size, label, sketch, heads = rows
        tree, same, forest, links = int(tree[0]), low[0] == high[0], _Forest(), []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        for i in range(0, len(left), TILE):
            for j in range(i if same else 0, len(right), TILE):
                a, b = left[i : i + TILE], right[j : j + TILE]
                small, large = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
                may = (label[a][:, None] != label[b][None, :]) & (100 * small >= 75 * large)
                if same and i == j:
                    may = np.triu(may, 1)
                if not may.any():
                    continue
                alike = _alike(sketch[a], sketch[b])
                x, y = np.nonzero(may & (alike >= SKETCH_AGREE[WIDE]))
                first = (heads[a[x]] == heads[b[y]]).argmax(1) == tree
                x, y = x[first], y[first]
                order = np.argsort(-alike[x, y].astype(np.int64), kind="stable")
                joined = len(links)
                for k, m in zip(a[x[order]].tolist(), b[y[order]].tolist()):
                    one, other = forest.find(int(label[k])), forest.find(int(label[m]))
                    if one != other and _similar(sets[k], sets[m]):
                        forest.join(one, other)
                        links.append((int(node[k]), int(node[m])))
                if len(links) > joined:
                    names, at = np.unique(label, return_inverse=True)
                    label = np.array([forest.find(n) for n in names.tolist()], np.int64)[at]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    carry, kept = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = [batch.column(n).to_numpy() for n in ("tree", "region", "low", "high", "side", "node", "size", "label")]
        rows.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDE))
        rows.append(np.frombuffer(b"".join(batch.column("heads").to_pylist()), np.uint32).reshape(-1, TREES))
        sets = kept + batch.column("shingles").to_pylist()
        rows = rows if carry is None else [np.concatenate(x) for x in zip(carry, rows)]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[1:4]], axis=0)) + 1
        for i, j in zip([0, *new[:-1]], new):
            yield compare([x[i:j] for x in rows], sets[i:j])
        last = int(new[-1]) if len(new) else 0
        carry, kept = [x[last:] for x in rows], sets[last:]
    if carry is not None:
        yield compare(carry, kept)
    del carry, kept
    release()


def _unconnected(nodes: DataFrame, sets: DataFrame, trees: range, folder: str) -> DataFrame | None:
    """Links between what no confirmed links connect so far, in all regions of some orders.

    A label of at least BLOCK nodes in a region has blocks of its own, which need not be compared with each other;
    the other nodes share blocks, whose number follows the room they take. Every two blocks of a region meet.
    """
    heads = _heads(nodes, trees)
    counted = heads.groupBy("tree", "head").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    mixed = counted.filter("least <> most").select("tree", "head", F.monotonically_increasing_id().alias("region"))
    mixed = stored(mixed, folder, "mixed")
    if mixed.isEmpty():
        return None
    rows = stored(heads.join(mixed, ["tree", "head"]).drop("head"), folder, "rows")
    sizes = rows.groupBy("region", "label").agg(F.sum("room").alias("n"))
    several = sizes.groupBy("region").agg(F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).alias("loose"))
    several = stored(several.select("region", F.ceil(F.col("loose") / BLOCK).alias("shared")), folder, "several")
    before = Window.partitionBy("region").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.filter(F.col("n") >= BLOCK).withColumn("own", F.ceil(F.col("n") / BLOCK)).select(
        "region", "label", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    own = stored(own.join(several, "region").withColumn("start", F.col("start") + F.col("shared")).drop("shared"), folder, "own")
    last = several.join(own.groupBy("region").agg(F.sum("own").alias("more")), "region", "left").select(
        "region", "shared", (F.col("shared") + F.coalesce("more", F.lit(0)) - 1).alias("last"))
    draw = F.xxhash64("node", F.lit(10))
    placed = rows.join(last, "region").join(own, ["region", "label"], "left").withColumn(
        "block", F.when(F.col("own").isNull(), F.pmod(draw, "shared")).otherwise(F.col("start") + F.pmod(draw, "own")))
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))
    others = F.col("own").isNull() | (F.col("other") < F.col("start")) | (F.col("other") >= F.col("start") + F.col("own"))
    met = placed.withColumn("other", meets).filter(others).select(
        "tree", "region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "node")
    key = ["region", "low", "high"]
    whole = nodes.select("node", "size", "label", "sketch", "heads").join(sets.select("node", "shingles"), "node")
    full = met.join(whole, "node").select("tree", *key, "side", "node", "size", "label", "sketch", "heads", "shingles")
    ordered = full.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(_crossed, "a bigint, b bigint")


def _confirm(batches):
    for batch in batches:
        keep = [_similar(x, y) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    release()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.filter("a <> b").join(of_b, "b").join(of_a, "a").mapInArrow(_confirm, "a bigint, b bigint")


def _joined(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``nodes`` with the labels that the confirmed links give, on top of the labels they have."""
    label = nodes.select("node", "label")
    between = (
        links.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
        .select(F.col("la").alias("a"), F.col("lb").alias("b"))
    )
    roots = components(between, folder).select(F.col("node").alias("label"), "root")
    joined = nodes.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    return stored(joined.select(nodes.columns), folder, "joined")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with the group of near copies they belong to.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out. Per row: ``doc_id``, ``n_shingles``,
    ``component_id`` (smallest doc_id reachable over links, itself included) and ``kept`` (doc_id =
    component_id). A null, empty or blank text has no shingle and is linked with nothing. Rows without a
    doc_id link others, name no component and are never kept; repeated rows are copies and give a row each.

    Equal sets are one node from the start. Rounds of few candidates per node link most copies. Then every plausible
    pair of a region that nothing connects yet is compared, once, by tasks that hold the full sets and hand out links
    only. Two texts of similarity 0.75 share no region in any order with a probability of 2 in a million. Nodes are
    64-bit hashes of the set. Very long texts are read whole; their sets take more room, so fewer of them meet in a task.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "near-duplicates")
    # A node's text is found by the smallest id and the text's own hash, so rows that share an id, or have none,
    # don't all meet.
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("pick"), "text")
    rows = stored(named.mapInArrow(_summaries, SETS), folder, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "pick")).alias("first")
    cut = lambda start, n: F.expr(f"substring(signature, {start}, {n})")
    nodes = stored(
        rows.filter("node is not null").groupBy("node", "node2")
        .agg(first, F.first("signature").alias("signature"), F.first("n_shingles").alias("size")).drop("node2")
        .withColumns({
            "label": F.col("node"), "first_id": F.col("first.doc_id"), "pick": F.col("first.pick"),
            "sketch": F.concat(*[cut(2 * k * (TREES * DEPTH // NARROW) + 2, 1) for k in range(NARROW)]),
            "heads": F.concat(*[cut(2 * DEPTH * k + 1, HEAD) for k in range(TREES)]),
        }).drop("first"),
        folder, "nodes",
    )
    pairs = stored(_candidates(nodes, _first_round, NARROW), folder, "first")
    close = pairs.filter("a = b").select(F.col("a").alias("node"))
    # Who is unlike its neighbours in a crowded region may be like others of it.
    every = _heads(nodes, range(TREES)).select("tree", "head", "node")
    crowded = stored(every.groupBy("tree", "head").count().filter(F.col("count") > REGION), folder, "crowded")
    close = close.union(every.join(crowded, ["tree", "head"]).select("node")).distinct()
    close = stored(nodes.join(close, "node"), folder, "close")
    named = named.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "pick", "text")
    wanted = close.select("node", F.coalesce("first_id", F.lit(_NO_ID)).alias("id"), "pick")
    if close.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = stored(
        named.join(wanted, ["id", "pick"]).select("node", "text").mapInArrow(_full_sets, "node bigint, shingles binary, wide binary")
        .groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("wide").alias("wide")),
        folder, "sets",
    )
    grouped = close.drop("sketch").join(sets.select("node", F.col("wide").alias("sketch")), "node")
    links = confirmed(pairs, sets)
    grouped = _joined(grouped, links, f"{folder}/first-links")
    pairs = stored(_candidates(grouped, _second_round, WIDE), folder, "second")
    grouped = _joined(grouped, stored(confirmed(pairs, sets), folder, "second-confirmed"), f"{folder}/second-links")
    for trees in CROSSED_TREES:
        part = f"{folder}/crossed-{trees[0]}"
        links = _unconnected(grouped, sets, trees, part)
        if links is not None:
            grouped = _joined(grouped, stored(links, part, "links"), part)
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = grouped.select("node", "label").join(smallest, "label").select("node", "component_id")
    everything = nodes.select("node", "first_id").join(of_node, "node", "left").select(
        "node", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "node").join(everything, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(
            F.col("doc_id") == F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")),
            F.lit(False),
        ).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies; all columns stay.

    Rows without a doc_id stay, since no result can name them; of rows equal in doc_id and text one stays.
    """
    kept = unused(docs, "_kept_id")
    ids = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(ids, F.col("doc_id") == F.col(kept), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))
