"""Benchmark passages in documents, found by SimHash over windows of the items' size.

Windows of a few sizes slide over every word of every document. Their 64-bit SimHash is compared with those
of the windows of that size that the benchmark items hold. The 64 bits are cut into four blocks: two
fingerprints within radius 7 differ by at most one bit in some block, so tables of the items' blocks with
each bit flipped find all of them. Candidates are confirmed by the exact weighted similarity of the five-word
shingles of the item and of the document's window of its size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.llm.words import SHINGLE, shingle_hashes, slices, word_hashes

RADIUS, SIMILARITY = 7, 0.75
BLOCKS, BLOCK_BITS = 4, 16
# Windows grow by this factor, up to what eight-bit counters hold; a longer item is looked for by several windows.
GROWTH, LARGEST_WINDOW = 1.25, 120
# How far the compared window may lie from where the fingerprints agree.
SLACK = 4
# Benchmark words that go to the tasks at once; a larger benchmark takes several passes.
WORDS_AT_ONCE = 2_000_000

_WORD = re.compile(r"\w+")
_LANES = np.array([sum((value >> bit & 1) << (8 * bit) for bit in range(8)) for value in range(256)], np.uint64)
_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)

MATCHES = "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return _WORD.findall((text or "").lower())


def _side_by_side(length: int, size: int) -> list[int]:
    return sorted({*range(0, length - size + 1, size), length - size})


def windows(length: int) -> dict[int, list[int]]:
    """The windows that an item of so many words is looked for by: sizes and places.

    Both ends, and where the item is longer than a window, windows side by side. In a short item one changed word
    moves the fingerprint far, but a similar passage can differ in a few words at its ends only: a word further in
    takes SHINGLE shingles away. So it is looked for by what lies between the ends as well, which is then unchanged.
    """
    ladder = [SHINGLE]
    while ladder[-1] < LARGEST_WINDOW:
        ladder.append(min(LARGEST_WINDOW, max(ladder[-1] + 1, int(ladder[-1] * GROWTH))))
    size = max(s for s in ladder if s <= length)
    out = {size: _side_by_side(length, size)}
    # Of n shingles, at most so many can be other ones at a similarity of SIMILARITY.
    margin = int((length - SHINGLE + 1) * (1 - SIMILARITY) / (1 + SIMILARITY))
    if 0 < margin < SHINGLE:
        inner = max(s for s in ladder if s <= max(SHINGLE, length - 2 * margin))
        out[inner] = sorted({*out.get(inner, []), margin, length - margin - inner})
    return out


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the hash bits, eight counters to a 64-bit number; row 0 is before the first word.

    Sums run over, but the difference of two rows is exact as long as each counter of it stays below 256.
    """
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8).T]
    out = np.zeros((8, len(hashes) + 1), np.uint64)
    np.cumsum(lanes, axis=1, out=out[:, 1:])
    return out


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` words: bits set in more than half of them.

    A counter's top bit tells whether it is above half, once the rest to 128 is added; bit k of every byte of
    the result is from the k-th number of counters.
    """
    count = sums.shape[1] - size
    out, over = np.zeros(count, np.uint64), np.empty(count, np.uint64)
    above = _ONES * np.uint64(127 - size // 2)
    for k in range(8):
        np.subtract(sums[k, size:], sums[k, :count], out=over)
        over += above
        over &= _TOPS
        over >>= np.uint64(7 - k)
        out |= over
    return out


@dataclass
class Item:
    item_id: int
    hashes: np.ndarray
    shingles: Counter
    distinct: np.ndarray


def _shingles(hashes: np.ndarray) -> Counter:
    return Counter(shingle_hashes(hashes).tolist())


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shingles in both over shingles in either, each as often as it occurs."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class Index:
    """Fingerprints of the items' windows of one size, by block values within one bit."""

    def __init__(self, size: int, items: list[Item]):
        self.size = size
        prints, self.items, self.offsets = [], [], []
        for item in items:
            places = windows(len(item.hashes)).get(size) or _side_by_side(len(item.hashes), size)
            prints.append(fingerprints(prefix_sums(item.hashes), size)[places])
            self.items += [item] * len(places)
            self.offsets += places
        self.prints = np.concatenate(prints)
        near = np.array([0] + [1 << b for b in range(BLOCK_BITS)], np.int64)
        self.marked, self.starts, self.members = [], [], []
        for block in range(BLOCKS):
            value = self.prints.view(np.uint16)[block::BLOCKS].astype(np.int64)
            keys = (value[:, None] ^ near[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.members.append(np.repeat(np.arange(len(value)), len(near))[order])
            self.starts.append(np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)))
            marked = np.zeros(1 << BLOCK_BITS, bool)
            marked[keys] = True
            self.marked.append(marked)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``prints`` and the windows within the radius of them; all such pairs."""
        positions, members = [], []
        for block in range(BLOCKS):
            value = prints.view(np.uint16)[block::BLOCKS]
            at = np.flatnonzero(self.marked[block].take(value))
            if not len(at):
                continue
            low, high = self.starts[block][value[at]], self.starts[block][value[at].astype(np.int64) + 1]
            number = high - low
            first = np.repeat(low - (np.cumsum(number) - number), number)
            who = self.members[block][np.arange(number.sum()) + first]
            where = np.repeat(at, number)
            close = np.bitwise_count(prints[where] ^ self.prints[who]) <= RADIUS
            positions.append(where[close])
            members.append(who[close])
        if not positions:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(positions), np.concatenate(members)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _best(hashes: np.ndarray, item: Item, starts: set[int]) -> tuple[float, int, int]:
    """The most similar window of the item's size among those that begin at one of ``starts``."""
    size, best = len(item.hashes), (0.0, 0, 0)
    low, high = max(0, min(starts)), min(len(hashes), max(starts) + size)
    if high - low < SHINGLE:
        return best
    # A similar window shares this part of the item's shingles at least; most candidates share none.
    if np.isin(shingle_hashes(hashes[low:high]), item.distinct).sum() < SIMILARITY * sum(item.shingles.values()):
        return best
    for start in sorted(starts):
        low, high = max(0, start), min(len(hashes), start + size)
        if high - low >= SHINGLE:
            best = max(best, (weighted_similarity(_shingles(hashes[low:high]), item.shingles), -low, high - low))
    return best[0], -best[1], best[2]


def matches(hashes: np.ndarray, found: list[tuple[Item, int]]) -> Iterator[tuple[int, float, int, int]]:
    """Confirmed matches of one document from the items and places that the fingerprints give."""
    places: dict[int, tuple[Item, set[int]]] = {}
    for item, start in found:
        places.setdefault(id(item), (item, set()))[1].update(range(start - SLACK, start + SLACK + 1))
    for item, starts in places.values():
        similarity, start, size = _best(hashes, item, starts)
        if similarity >= SIMILARITY:
            yield item.item_id, similarity, start, size


class Search:
    """Looks for the items in batches of documents."""

    def __init__(self, items: list[tuple[int, str]]):
        known = []
        for item_id, text in items:
            own = word_hashes([words_of(text)])
            known.append(Item(item_id, own, _shingles(own), np.unique(shingle_hashes(own))))
        by_size: dict[int, list[Item]] = {}
        for item in known:
            for size in windows(len(item.hashes)):
                by_size.setdefault(size, []).append(item)
        self.indexes = [Index(size, by_size[size]) for size in sorted(by_size)]

    def __call__(self, column) -> Iterator[tuple[int, int, float, int, int]]:
        """Row number, item, similarity, start and size of each match."""
        rows = [words_of(t) for t in column.to_pylist()]
        hashes = word_hashes(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = np.cumsum(sizes)
        sums = prefix_sums(hashes)
        found: dict[int, list[tuple[Item, int]]] = {}
        for index in self.indexes:
            if len(hashes) >= index.size:
                at, who = index.within_radius(fingerprints(sums, index.size))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + index.size <= ends[doc]
                for p, w, d in zip(at[inside].tolist(), who[inside].tolist(), doc[inside].tolist()):
                    found.setdefault(d, []).append((index.items[w], p - index.offsets[w]))
            # A document shorter than the windows is one window by itself.
            for d in np.flatnonzero((sizes < index.size) & (sizes >= SHINGLE)).tolist():
                low = int(ends[d] - sizes[d])
                own = fingerprints(sums[:, low : ends[d] + 1], int(sizes[d]))
                for w in index.within_radius(own)[1].tolist():
                    found.setdefault(d, []).append((index.items[w], low - index.offsets[w]))
        for d, places in sorted(found.items()):
            low = int(ends[d] - sizes[d])
            for match in matches(hashes[low : ends[d]], [(i, s - low) for i, s in places]):
                yield d, *match


def _matches_of(items):
    def search(batches):
        look = Search(items)
        for batch in slices(batches, limit=1 << 18):
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[d], *match) for d, *match in look(batch.column("text"))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "similarity", "start_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return search


def _clean_of(items):
    def search(batches):
        look = Search(items)
        for batch in slices(batches, limit=1 << 18):
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, *_ in look(batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return search


def _parts(spark: SparkSession, benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Benchmark items in lists of at most WORDS_AT_ONCE words (or one item), read one list at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    parts, words = [[]], 0
    for row in rows.dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(row.text))
        if size < SHINGLE:
            continue
        if parts[-1] and words + size > WORDS_AT_ONCE:
            parts, words = parts + [[]], 0
        parts[-1].append((row.item_id, row.text))
        words += size
    return parts


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item it holds: ``doc_id``, ``item_id``, ``similarity``, and where.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; other columns are left
    out. Words are compared without case and punctuation. ``start_word`` and ``n_words`` give the most similar
    window, the first if several are. Texts that are null or have fewer than five words hold no shingle: they
    match nothing and are matched by nothing. Texts of any length are searched whole. Repeated documents or items give a row each; a repeated item row
    counts once. An empty table on either side gives no rows.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = _parts(docs.sparkSession, benchmark)
    return reduce(DataFrame.unionByName, [named.mapInArrow(_matches_of(part), MATCHES) for part in parts])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item; all columns stay."""
    for part in _parts(docs.sparkSession, benchmark):
        docs = docs.mapInArrow(_clean_of(part), docs.schema)
    return docs
