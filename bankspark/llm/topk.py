"""Exact top-k inner products by the no-random-access algorithm over sorted lists.

Candidates lie in blocks. In a block every dimension is a list of its values in order; a query reads a list
from the top where its weight is positive and from the bottom where it is negative. After each depth, what was
read gives a lower bound of every candidate's score (unread values are at least the list's end) and an upper
bound (at most the next value to be read). Reading stops for a query when no more candidates can reach its
k-th lower bound than are worth resolving; those get their full scores. Many queries read at the same time, so
the bounds are matrix products.

Packs of queries and blocks meet in tiles, each a task: it keeps its packs with their best so far and reads its blocks
one after another. From the second block on a query's k-th best score takes the place of the lower bounds.
"""

from __future__ import annotations

import heapq
import operator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from bankspark.llm.store import new_folder, stored

SCALE, K = 64, 20
BLOCK, QUERIES_AT_ONCE = 4096, 512
# Of a tile. More tiles copy blocks and packs more often; a tile of fewer blocks has lower k-th best scores to stop by.
MOST_BLOCKS, MOST_PACKS, LEAST_BLOCKS, TILES_PER_CORE = 256, 256, 24, 3
# So many components of queries are kept by a task.
MOST_COMPONENTS = 1 << 24
DEPTHS = (0.125, 0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375, 0.96875)
# A query stops reading when at most so many candidates of the block are left, and at most so large a part of it.
WORTH_RESOLVING, RESOLVED_SHARE = 128, 0.0625
# So many candidates of a tile are read before the others, to have k-th best scores early.
AHEAD = 512
# Below every score; a score is more than it in size only where it does not fit a long.
LEAST = np.iinfo(np.int64).min


class Lists:
    """A block's values, with the list of each dimension in falling order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.sorted = np.sort(values, axis=0)[::-1]
        self._values, self._ends = {}, {}

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each value in its dimension's list."""
        order = np.argsort(-self.values, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(self.ids))[:, None], axis=0)
        return place

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds after reading ``depth`` values of each list."""
        n, kind = len(self.ids), up.dtype
        last = self.sorted[-1], self.sorted[0]
        read = self.place < depth, self.place >= n - depth
        pick = lambda side: np.where(read[side], self.values, last[side]).astype(kind).T
        return up @ pick(0) + down @ pick(1), self.upper(depth, np.hstack([up, down]))

    def upper(self, depth: int, sides: np.ndarray) -> np.ndarray:
        """Upper bounds after reading ``depth`` values of each list; ``sides``: positive weights beside negative ones."""
        key = depth, sides.dtype
        if key not in self._ends:
            if len(self._ends) == 2:
                self._ends.clear()
            # What is read from the top is at least the next value there, what is not is at most that; at the bottom likewise.
            following = self.sorted[depth], self.sorted[len(self.ids) - 1 - depth]
            ends = np.concatenate([np.maximum(self.values, following[0]).T, np.minimum(self.values, following[1]).T])
            self._ends[key] = np.ascontiguousarray(ends.astype(sides.dtype, copy=False))
        return sides @ self._ends[key]

    def of_kind(self, kind: type) -> np.ndarray:
        if kind not in self._values:
            self._values[kind] = self.values.astype(kind, copy=False)
        return self._values[kind]


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which the products and their sums are exact; Python's whole numbers beyond 62 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _chosen(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _worth(n: int, k: int) -> int:
    return max(k, min(WORTH_RESOLVING, int(n * RESOLVED_SHARE)))


def search(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
    """``(query, candidate ids, scores)`` of each query's k best in the block, itself left out.

    Where products do not fit 64 bits, the lists are read to the end and scored in Python's whole numbers.
    """
    for row, ids, scores in _search_block(lists, query_ids, queries, k):
        yield int(query_ids[row]), ids, scores


def _search_block(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """As ``search``, with the query's place among the queries."""
    n = len(lists.ids)
    kind = _kind(queries, lists.values)
    if kind is object:
        yield from _scored(lists, query_ids, queries, k)
        return
    least = -np.inf if kind is not np.int64 else LEAST
    todo = np.arange(len(query_ids))
    worth = _worth(n, k)
    for depth in sorted({int(n * share) for share in DEPTHS if n > worth}):
        q = queries[todo].astype(kind)
        low, high = lists.bounds(depth, np.maximum(q, 0), np.minimum(q, 0))
        own = query_ids[todo][:, None] == lists.ids[None, :]
        low[own], high[own] = least, least
        reach = np.partition(low, n - k, axis=1)[:, n - k]
        may = (high >= reach[:, None]) & ~own
        stop = may.sum(1) <= worth
        for row in np.flatnonzero(stop):
            left = np.flatnonzero(may[row])
            scores = lists.values[left].astype(np.int64) @ queries[todo[row]].astype(np.int64)  # fits, by its kind
            best = _chosen(scores, lists.ids[left], k)
            yield todo[row], lists.ids[left[best]], scores[best]
        todo = todo[~stop]
        if not len(todo):
            return
    # The lists are read to the end: the bounds meet.
    scores = queries[todo].astype(kind) @ lists.of_kind(kind).T
    for row, at in zip(scores, todo):
        others = np.flatnonzero(lists.ids != query_ids[at])
        best = others[_chosen(row[others], lists.ids[others], k)]
        yield at, lists.ids[best], row[best].astype(np.int64)


def _scored(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int):
    rows = [[int(x) for x in v] for v in lists.values.tolist()]
    for at, (query, weights) in enumerate(zip(query_ids.tolist(), queries.tolist())):
        weights = [int(w) for w in weights]
        scores = ((-sum(map(operator.mul, row, weights)), i) for row, i in zip(rows, lists.ids.tolist()) if i != query)
        best = heapq.nsmallest(k, scores)
        if any(abs(s) >= 1 << 63 for s, _ in best):
            raise OverflowError(f"a score of query {query} does not fit 64 bits")
        yield at, np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


class Best:
    """The k best of each query of a pack in the blocks read so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        # Queries, candidates, scores: the best, and what was found better since, not yet sorted in.
        self.kept, self.new = [tuple(np.empty(0, np.int64) for _ in range(3))], []
        # A query's k-th best, while it has k.
        self.reach, self.reached = np.full(len(ids), LEAST), np.full(len(ids), LEAST)

    def read(self, lists: Lists, first: int) -> int:
        """Read a block, its lists at first to the depth numbered ``first``; returns where to begin in the next one."""
        if (self.reach == LEAST).any() or _kind(self.queries, lists.values) is object:
            found = list(_search_block(lists, self.ids, self.queries, self.k))
            sizes = [len(scores) for _, _, scores in found]
            self.new.append((np.repeat([row for row, _, _ in found], sizes), *(np.concatenate([f[i] for f in found]) for i in (1, 2))))
            self._sort()
            return first
        found, first = self._beyond(lists, first)
        self._add(found)
        return first

    def _beyond(self, lists: Lists, first: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """Queries, candidates and scores that are better than the k-th best; where to begin in the next block."""
        n, kind, worth = len(lists.ids), _kind(self.queries, lists.values), _worth(len(lists.ids), self.k)
        queries, found, following = self.queries.astype(kind), [], first
        # A k-th best that its kind does not hold exactly is beyond all scores of the block, on its side of them.
        reach, todo = self.reach.astype(kind), np.arange(len(self.ids))
        for share in DEPTHS[first::2] if n > worth else ():
            q = queries[todo]
            high = lists.upper(int(n * share), np.hstack([np.maximum(q, 0), np.minimum(q, 0)]))
            may = high >= reach[todo][:, None]
            left = np.count_nonzero(may, axis=1)
            stop = left <= worth
            if share == DEPTHS[first]:
                # Deeper where many queries read on, less deep where hardly any candidates are left.
                deeper, enough = 10 * np.count_nonzero(stop) < 9 * len(stop), 4 * left.mean() < worth
                following = min(first + 1, len(DEPTHS) - 1) if deeper else max(first - 1, 0) if enough else first
            row, place = np.divmod(np.flatnonzero(may if stop.all() else may[stop]), n)
            found += self._resolved(lists, queries, todo[stop][row], place)
            todo = todo[~stop]
            if not len(todo):
                return found, following
        # The lists are read to the end: the bounds meet.
        scores = queries[todo] @ lists.of_kind(kind).T
        reach = reach[todo]
        if n > self.k + 1:  # of which one may be the query's own
            reach = np.maximum(reach, np.partition(scores, n - self.k - 1, axis=1)[:, n - self.k - 1])
        row, place = np.divmod(np.flatnonzero(scores >= reach[:, None]), n)
        found.append(self._better(lists, todo[row], place, scores[row, place]))
        return found, following

    def _resolved(self, lists: Lists, queries: np.ndarray, row: np.ndarray, place: np.ndarray):
        values, at_once = lists.of_kind(queries.dtype.type), max(1, (1 << 21) // queries.shape[1])
        for k in range(0, len(row), at_once):
            r, p = row[k : k + at_once], place[k : k + at_once]
            yield self._better(lists, r, p, np.einsum("ij,ij->i", queries[r], values[p]))

    def _better(self, lists: Lists, row: np.ndarray, place: np.ndarray, scores: np.ndarray):
        scores, ids = scores.astype(np.int64), lists.ids[place]
        better = (scores > self.reach[row]) | ((scores == self.reach[row]) & (ids < self.reached[row]))
        better &= ids != self.ids[row]
        return row[better], ids[better], scores[better]

    def _add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.new += [f for f in found if len(f[0])]
        if sum(len(row) for row, _, _ in self.new) >= len(self.ids) * self.k // 4:
            self._sort()

    def _sort(self) -> None:
        row, ids, scores = map(np.concatenate, zip(*self.kept, *self.new))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.ids)))[row]
        last, best = rank == self.k - 1, rank < self.k
        self.reach[row[last]], self.reached[row[last]] = scores[last], ids[last]
        self.kept, self.new = [(row[best], ids[best], scores[best])], []

    def rows(self) -> pa.RecordBatch:
        self._sort()
        row, ids, scores = self.kept[0]
        columns = [pa.array(x, pa.int64()) for x in (self.ids[row], ids, scores)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def _as_wide(values: np.ndarray, width: int) -> np.ndarray:
    """Components that no query has take no part; those that a vector has not are zero."""
    return np.pad(values[:, :width], ((0, 0), (0, max(0, width - values.shape[1]))))


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the shortest type that has them all."""
    low, high = values.min(), values.max()
    kind = next((k for k in ("int8", "int16", "int32") if np.iinfo(k).min <= low and high <= np.iinfo(k).max), "float64")
    return kind, values.astype(kind).tobytes()


def _unpacked(ids, kind: str, values) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the components as floating-point numbers that are exact."""
    ids = np.frombuffer(ids, np.int64)
    values = np.frombuffer(values, kind).astype(np.float32 if kind in ("int8", "int16") else np.float64)
    return ids, values.reshape(len(ids), -1)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy()
    values = np.zeros((len(sizes), max(1, sizes.max())), np.float64)
    values[np.arange(values.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    return values


def _pack(limit: int):
    """Rows of a partition as blocks of ``limit`` rows, the last of fewer: ids and values. ``part`` numbers them, from the partition's own number on."""
    def block(part, rows):
        width = max(values.shape[1] for _, values in rows)
        kind, values = _packed(np.concatenate([_as_wide(values, width) for _, values in rows]))
        columns = [pa.array([part], pa.int32()), pa.array([np.concatenate([ids for ids, _ in rows]).tobytes()], pa.binary()),
                   pa.array([kind]), pa.array([values], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "ids", "kind", "values"])

    def pack(batches):
        part, rows, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            ids, at = batch.column("vec_id").to_numpy(), 0
            while at < len(ids):
                to = min(len(ids), at + limit - n)
                rows.append((ids[at:to], _matrix(batch.column("vector").slice(at, to - at))))
                n, at = n + to - at, to
                if n == limit:
                    yield block(part, rows)
                    part, rows, n = part + 1, [], 0
        if rows:
            yield block(part, rows)

    return pack


def _search(k: int):
    """Tile by tile, packs of queries first: each query's k best in the blocks of the tile."""
    def run(batches):
        tile, asked, width, first = None, [], None, 1
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["tile"].as_py() != tile:
                    yield from (best.rows() for best in asked)
                    tile, asked, width = row["tile"].as_py(), [], None
                ids, values = _unpacked(row["ids"].as_buffer(), row["kind"].as_py(), row["values"].as_buffer())
                if row["asked"].as_py():
                    asked.append(Best(ids, values, k))
                elif asked:
                    ahead = AHEAD if width is None and len(ids) >= 4 * AHEAD else 0
                    if width is None:
                        width = max(best.queries.shape[1] for best in asked)
                        for best in asked:
                            best.queries = _as_wide(best.queries, width)
                    values = _as_wide(values, width)
                    for part in (slice(0, ahead), slice(ahead, None)) if ahead else (slice(None),):
                        lists = Lists(ids[part], values[part])
                        for best in asked:
                            first = best.read(lists, first)
        yield from (best.rows() for best in asked)

    return run


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of floor(SCALE * x); rows equal in both once.

    A null vec_id, a null vector, and one with a null or non-finite component take no part. Components are whole
    numbers in doubles, of any size.
    """
    def whole(v):
        scaled = F.lit(float(SCALE)) * v.cast("double")
        # From 2 ** 53 on a double is a whole number.
        return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double")).otherwise(scaled)

    x = F.transform("embedding", whole)
    finite = lambda v: F.abs(v.cast("double")) < F.lit(float("inf"))
    good = F.forall("embedding", lambda v: F.coalesce(finite(v), F.lit(False)))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
        .select("vec_id", x.alias("vector")).distinct()
    )


def _tiles(blocks: int, packs: int, cores: int, width: int) -> tuple[int, int]:
    """In how many parts blocks and packs are dealt out, so that tiles keep the cores busy and each fits a task."""
    most = max(1, min(MOST_PACKS, MOST_COMPONENTS // (QUERIES_AT_ONCE * width)))
    wanted, across, down = TILES_PER_CORE * cores, -(-blocks // MOST_BLOCKS), -(-packs // most)
    across = max(across, min(-(-wanted // down), blocks // LEAST_BLOCKS))
    return across, max(down, min(-(-wanted // across), packs))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k candidates of the highest inner product for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both tables have ``vec_id`` and ``vector`` (of whole numbers, see ``whole_vectors``). Candidates are all rows
    of another vec_id; ties go to the smaller one. Missing components of a shorter vector count as zero. A vec_id
    with several vectors is several candidates or queries of that name; the best k by name remain. Scores are exact;
    one among the best that does not fit a long stops the job.
    """
    spark = vectors.sparkSession
    folder = new_folder(spark, "topk")
    vectors = stored(vectors, folder, "vectors")
    queries = stored(queries, folder, "queries")
    asked, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks, packs = max(1, -(-vectors.count() // BLOCK)), max(1, -(-asked // QUERIES_AT_ONCE))
    across, down = _tiles(blocks, packs, spark.sparkContext.defaultParallelism, max(1, width or 1))
    kind = "part int, ids binary, kind string, values binary"

    def dealt(packed: DataFrame, asked: bool, tile: Column) -> DataFrame:
        return packed.select(tile.alias("tile"), F.lit(asked).alias("asked"), "ids", "kind", "values")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Blocks and packs are sent to their tiles: a join would guess the packs' size from before they are copied, and broadcast them.
    read = vectors.mapInArrow(_pack(BLOCK), kind).withColumn("at", every(down))
    asked = queries.repartition(packs).mapInArrow(_pack(QUERIES_AT_ONCE), kind).withColumn("at", every(across))
    rows = dealt(read, False, F.col("at") * across + F.col("part") % across).unionAll(
        dealt(asked, True, F.col("part") % down * across + F.col("at")))
    rows = rows.repartitionById(across * down, "tile").sortWithinPartitions("tile", F.desc("asked"))
    found = rows.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
