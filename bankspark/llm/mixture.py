"""Mixing sources to target weights by exact block quotas.

The documents of a source lie on a line in an order drawn by hash, and the line is cut into blocks of words.
A source's target is a number of blocks: the whole line as often as it fits, then the start of the line. A
splitting tree halves the output shards again and again and deals each source's blocks to the two halves by
a multivariate hypergeometric draw, so every shard gets its exact number of blocks and the quotas of each
source add up. A keyed permutation of a source's drawn blocks gives each shard disjoint blocks from all over
the source; inside a shard, blocks lie in the order of another hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bankspark.llm.store import new_folder, stored
from bankspark.llm.words import mixed, slices
from bankspark.operators.ordering import global_positions

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SHARDS, SEED = 16, 9
# Words in a block: a thousandth of the source, at most BLOCK, so that small sources come near their target too. Where
# the tree would have to draw from over MOST_BLOCKS blocks (more than 64 billion words), blocks are larger,
# so that a target is met within a 250 millionth of all words.
BLOCK, PARTS, MOST_BLOCKS = 256, 1024, 500_000_000
# Sources that one task deals to the shards; the tree above is over groups of so many.
SOURCES_IN_GROUP = 10_000
# Up to so many sources (about 250 bytes each) are broadcast; beyond that, only those with more than one in so many
# of all documents, which are fewer.
BROADCAST_SOURCES = 100_000
DOCS_IN_BUCKET, MOST_BUCKETS, DOCS_IN_PIECE = 2048, 65_536, 10_000

WORD = r"[^\x20\x09-\x0D]+"
DRAWS = "array<struct<copy: int, start: bigint, n_words: bigint, shard: int, position: bigint>>"


def targets(sizes: list[int]) -> list[float]:
    """Target words of each source, in order: SHARE of all words by weight, none above MOST times its size."""
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    rest = SHARE * sum(sizes)
    while open_ := [k for k, t in enumerate(out) if t is None]:
        unit = rest / sum(weights[k] for k in open_)
        above = [k for k in open_ if weights[k] * unit > MOST * sizes[k]]
        for k in above or open_:
            out[k] = float(MOST * sizes[k]) if above else weights[k] * unit
        if not above:
            break
        rest = max(0.0, rest - sum(out[k] for k in above))
    return out


def split(quotas: np.ndarray, totals: np.ndarray, seed: list[int], node: int = 1) -> np.ndarray:
    """Deals ``quotas`` of blocks to shards of the given ``totals`` (as many in all), by halves of the shards.

    A row per source and a column per shard; rows add up to ``quotas``, columns to ``totals``.
    """
    if len(totals) == 1:
        return quotas[:, None]
    half = len(totals) // 2
    share = int(totals[:half].sum())
    rng = np.random.default_rng([*seed, node])
    first = rng.multivariate_hypergeometric(quotas, share, method="marginals") if share else np.zeros_like(quotas)
    return np.hstack([split(first, totals[:half], seed, 2 * node), split(quotas - first, totals[half:], seed, 2 * node + 1)])


def even(total: int, shards: int) -> np.ndarray:
    """Blocks of each shard: as equal as whole numbers can be."""
    return np.diff(np.arange(shards + 1, dtype=np.int64) * total // shards)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of ``index`` in a permutation of 0 to size - 1 that ``key`` picks: four rounds of halves, walked until inside."""
    half = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) for s in size], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right * np.uint64(4) + np.uint64(turn) + key[todo]) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sized(docs: DataFrame, seed: int) -> list:
    """Columns that place a document: id, source, words, and its draws by hash."""
    drawn = F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(seed))
    return [
        F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"), drawn.alias("_drawn"),
        F.xxhash64("text").alias("_tie"),
    ]


def _targets(sizes: DataFrame) -> DataFrame:
    """``sizes(key, words, n)`` with the place of each source and its target; the same rule as ``targets``.

    A round looks at all sources at once: those above the limit under the present unit get the limit, and the rest
    is shared anew, until none is above.
    """
    ordered = global_positions(sizes.withColumn("_last", F.col("key") == "-"), ["_last", "key"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = ordered.drop("_last").withColumn("weight", weight)
    total = weighed.agg(F.sum("words")).first()[0] or 0
    limit, unit, closed = MOST * F.col("words"), None, F.lit(False)
    while True:
        left = weighed.agg(
            F.sum(F.when(~closed, F.col("weight"))).alias("weights"), F.sum(F.when(closed, limit)).alias("taken")).first()
        if not left.weights:
            break
        before, unit = unit, max(0.0, SHARE * total - (left.taken or 0)) / left.weights
        if before is not None and unit <= before:
            break
        closed = closed | (F.col("weight") * F.lit(unit) > limit)
    shared = limit if unit is None else F.when(closed, limit).otherwise(F.col("weight") * F.lit(unit))
    return weighed.withColumn("target", shared.cast("double"))


_SOURCES = "place bigint, bounds binary"


def _dealt(shards: int, seed: int):
    """The upper bounds of each shard's blocks in the line of each source's drawn blocks, for one group of sources."""
    def dealt(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        totals = np.frombuffer(rows.column("totals")[0].as_py(), np.int64)
        mine = split(rows.column("quota").to_numpy(), totals, [seed, int(rows.column("group")[0].as_py()) + 1])
        bounds = np.cumsum(mine, axis=1)
        return pa.table({"place": rows.column("place"), "bounds": pa.array([b.tobytes() for b in bounds], pa.binary())})

    return dealt


def _planned(sizes: DataFrame, shards: int, seed: int, folder: str) -> DataFrame:
    """A row per source: key, size, target, words in a block, blocks, drawn blocks and their bounds by shard.

    The driver's part of the tree has a row per group of sources; each group's part is one task's.
    """
    spark = sizes.sparkSession
    goal = stored(_targets(sizes), folder, "targets")
    counted = goal.agg(F.sum("words"), F.count(F.lit(1))).first()
    least = (counted[0] or 0) * MOST // MOST_BLOCKS + 1
    groups = max(1, -(-counted[1] // SOURCES_IN_GROUP))
    limit = MOST * F.col("words")
    # A source at its limit takes every block, also its last, which may be shorter.
    quota = F.when(F.col("target") >= limit, MOST * F.col("blocks")).otherwise(
        F.least(MOST * F.col("blocks"), F.rint(F.col("target") / F.col("block")).cast("bigint")))
    quotas = stored(
        goal.withColumn("block", F.greatest(F.lit(least), F.least(F.lit(BLOCK), F.expr(f"words div {PARTS}"))).cast("bigint"))
        .withColumn("blocks", F.expr("(words + block - 1) div block")).withColumn("quota", quota)
        .withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups))),
        folder, "quotas")
    drawn = {r.group: r.quota for r in quotas.groupBy("group").agg(F.sum("quota").alias("quota")).collect()}
    of_groups = np.array([drawn.get(g, 0) for g in range(groups)], np.int64)
    shares = split(of_groups, even(int(of_groups.sum()), shards), [seed, 0])
    totals = spark.createDataFrame([(g, bytearray(s.tobytes())) for g, s in enumerate(shares)], "group bigint, totals binary")
    dealt = quotas.join(F.broadcast(totals), "group").select("group", "place", "quota", "totals").groupBy("group").applyInArrow(
        _dealt(shards, seed), _SOURCES)
    return stored(quotas.drop("group", "weight").join(dealt, "place"), folder, "plan")


def _line(docs: DataFrame, carried: dict, shards: int, seed: int) -> DataFrame:
    """Documents with their source's plan and their place on the source's line; ``carried`` are further columns."""
    folder = new_folder(docs.sparkSession, "mixture")
    fine = F.pmod("_drawn", F.lit(MOST_BUCKETS)).alias("fine")
    sums = stored(
        docs.select(*_sized(docs, seed)).groupBy("_key", fine).agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n")),
        folder, "sums")
    plan = _planned(sums.groupBy(F.col("_key").alias("key")).agg(F.sum("words").alias("words"), F.sum("n").alias("n")), shards, seed, folder)
    counted = plan.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * DOCS_IN_BUCKET < (counted[1] or 0):
        buckets *= 2
    bucket = lambda c: F.pmod(c, F.lit(buckets)).alias("_bucket")
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.groupBy("_key", bucket("fine")).agg(F.sum("words").alias("_words")).select(
        "_key", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    keyed = docs.select(*_sized(docs, seed), *[F.col(c).alias(name) for c, name in carried.items()])
    plan = plan.select(
        F.col("key").alias("_key"), F.col("place").alias("_place"), F.col("words").alias("_source_size"), F.col("target").alias("_target"),
        F.col("block").alias("_block"), F.col("blocks").alias("_blocks"), F.col("quota").alias("_quota"), F.col("bounds").alias("_bounds"), "n")
    if counted[0] <= BROADCAST_SOURCES:
        placed = keyed.join(F.broadcast(plan.drop("n")), "_key")
    else:
        often = F.col("n") > counted[1] / BROADCAST_SOURCES
        many = F.broadcast(plan.filter(often).drop("n"))
        rest = keyed.join(F.broadcast(plan.filter(often).select("_key")), "_key", "left_anti")
        placed = keyed.join(many, "_key").unionByName(rest.join(plan.filter(~often).drop("n"), "_key"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_drawn", "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_bucket", bucket("_drawn")).join(offsets, ["_key", "_bucket"])
    return placed.withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))


_PLACE = ["_place", "_size", "_start", "_block", "_blocks", "_quota", "_bounds"]


def _draws(batch, seed: int) -> tuple[np.ndarray, ...]:
    """Row, copy, first word, number of words, shard and position of each block that is drawn of the batch's documents."""
    source, size, start, block, blocks, quota = (batch.column(c).to_numpy() for c in _PLACE[:-1])
    bounds = np.frombuffer(b"".join(batch.column("_bounds").to_pylist()), np.int64).reshape(len(size), -1)
    n = np.where(size > 0, (start + size - 1) // np.maximum(block, 1) - start // np.maximum(block, 1) + 1, 0) * MOST
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    copy, j = place % MOST, place // MOST + start[row] // np.maximum(block, 1)[row]
    draw = copy * blocks[row] + j
    taken = draw < quota[row]
    row, copy, j, draw = row[taken], copy[taken], j[taken], draw[taken]
    low = np.maximum(start[row], j * block[row])
    high = np.minimum(start[row] + size[row], (j + 1) * block[row])
    key = mixed((source[row].astype(np.uint64) << np.uint64(20)) + np.uint64(seed))
    position = permuted(draw, quota[row], key)
    shard = (bounds[row] <= position[:, None]).sum(1)
    return row, copy, low - start[row], high - low, shard, position


def _drawn(seed: int):
    """Each document with the draws of the blocks it lies in."""
    names = ["doc_id", "size", "source", "source_size", "target", "draws"]

    def drawn(batches):
        for batch in batches:
            row, copy, start, n_words, shard, position = _draws(batch, seed)
            draws = pa.StructArray.from_arrays(
                [pa.array(copy, pa.int32()), pa.array(start), pa.array(n_words), pa.array(shard, pa.int32()), pa.array(position)],
                ["copy", "start", "n_words", "shard", "position"],
            )
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            names_of = [None if k == "-" else k[1:] for k in batch.column("_key").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_size"), pa.array(names_of, pa.string()), batch.column("_source_size"),
                 batch.column("_target"), pa.ListArray.from_arrays(offsets, draws)], names)

    return drawn


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row per document: ``doc_id``, ``size``, ``source``, ``source_size``, ``target`` and ``draws``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. ``draws`` lists the blocks the mix takes of the document:
    copy number, first word, number of words, shard and the block's place in the source's permutation, which
    orders the shard. A null or empty text has size 0 and no draws; null is a source of its own, after the others.
    Repeated rows are documents of their own. Sources may be as many as documents. A very long text is
    many blocks. An empty table gives no rows.
    """
    line = _line(docs, {}, shards, seed)
    return line.select("_id", "_key", "_source_size", "_target", *_PLACE).mapInArrow(
        _drawn(seed), f"doc_id bigint, size bigint, source string, source_size bigint, target double, draws {DRAWS}")


def shards(docs: DataFrame, number: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The drawn blocks, shard by shard, in each shard's own order."""
    blocks = mixture(docs, number, seed).select("doc_id", "source", F.inline("draws"))
    order = F.xxhash64("shard", "source", "position", F.lit(seed))
    blocks = blocks.withColumn("place", order)
    return blocks.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "start")


def _cut(carried: dict[str, str], seed: int):
    """The parts that the mix takes of each document, a row per copy, with shard and place of its first block."""
    word, text = re.compile(WORD), carried["text"]

    def cut(batches):
        for batch in slices(batches, text):
            row, copy, start, n_words, shard, position = _draws(batch, seed)
            # Blocks of a copy that a document lies in are next to each other, so their ends give the part taken.
            order = np.lexsort((start, copy, row))
            row, copy, start, n_words, shard, position = (x[order] for x in (row, copy, start, n_words, shard, position))
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (copy[1:] != copy[:-1]))))
            last = np.append(first[1:], len(row)) - 1 if len(first) else first
            low, high = start[first], start[last] + n_words[last] if len(first) else start[first]
            part = batch.take(pa.array(row[first]))
            taken, size = part.column(text).to_pylist(), part.column("_size").to_numpy()
            for k in np.flatnonzero(high - low < size):
                spans = [m.span() for m in word.finditer(taken[k])][low[k] : high[k]]
                taken[k] = taken[k][spans[0][0] : spans[-1][1]]
            columns = [pa.array(taken, pa.string()) if name == text else part.column(name) for name in carried.values()]
            source = part.column("_place").to_numpy().astype(np.uint64)
            place = mixed(mixed(position[first].astype(np.uint64) + np.uint64(seed)) ^ mixed(source << np.uint64(2)) + copy[first].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(shard[first].astype(np.int64)), pa.array(place.view(np.int64))], [*carried.values(), "_shard", "_order"])

    return cut


def mixed_documents(docs: DataFrame, number: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and copy, shard by shard, in each shard's own order.

    A document is in the shard of the first block that is taken of it. All columns stay as they are, but for ``text``
    (and ``n_chars``, if there is one) of cut documents; at most one document of a source is cut. Documents without
    words have nothing to take and go. Repeated rows are drawn each for itself.
    """
    carried = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    types = ", ".join(f"{name} {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c, name in carried.items())
    line = _line(docs, carried, number, seed)
    rows = line.select(*carried.values(), *_PLACE).mapInArrow(_cut(carried, seed), f"{types}, _shard bigint, _order bigint")
    # A shard is written in pieces, which follow each other in its order.
    pieces = max(1, -(-docs.count() // (number * DOCS_IN_PIECE)))
    piece = F.floor((F.col("_order") / 2.0**63 + 1) * (pieces / 2)).cast("bigint")
    out = rows.withColumn("_piece", piece).repartition("_shard", "_piece").sortWithinPartitions("_shard", "_piece", "_order")
    out = out.select(*[F.col(name).alias(c) for c, name in carried.items()])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
