"""Dropping lines that many documents share, by a sharded minimal perfect hash.

Distinct line keys are counted over all documents. Those that are in enough documents enter an index of shards;
each shard is a minimal perfect hash of 128-bit line hashes with an array of fingerprints (64 bits, so that other
lines are turned away) and an array of counts. Documents probe the arrays; lines are never joined with lines.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from bankspark.llm.perfect_hash import SHARD_ROW, CountIndex
from bankspark.llm.store import new_folder, stored, unused
from bankspark.llm.words import slices, texts

LEAST_DOCUMENTS = 10
# Keys in a shard, on average.
SHARD_KEYS = 1 << 18
# Keys that make up more than one in so many of all occurrences in the index, so fewer than so many keys (about
# 13 bytes each), are probed where a document is read; the others by sending line hashes to their shard.
FREQUENT = 1_000_000
# Line hashes that one task probes.
PROBES = 4_000_000
COUNTED_AT_ONCE = 300_000

_ROW = "_line_row"


def line_keys(text: bytes) -> list[bytes]:
    """Key of each line: bytes 20 and 09 to 0D stripped at both ends, A-Z in lower case."""
    return [line.strip() for line in text.lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _counted(batches):
    """In how many documents each line key is, without the empty key."""
    counts: Counter = Counter()

    def rows():
        both = np.frombuffer(b"".join(counts), np.int64).reshape(-1, 2)
        out = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["high", "low", "n"])

    for batch in slices(batches):
        for text in texts(batch.column("text")):
            counts.update(map(xxh3_128_digest, set(line_keys(text)) - {b""}))
            if len(counts) > COUNTED_AT_ONCE:
                yield rows()
    yield rows()


def _shard(rows: pa.Table) -> pa.Table:
    high, low = (rows.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    index = CountIndex.of(high, low, rows.column("n").to_numpy())
    first = {c: rows.column(c)[0].as_py() for c in ("frequent", "shard")}
    return pa.Table.from_pylist([{**first, **index.row()}], _SHARDS)


_SHARDS = pa.schema([
    ("frequent", pa.bool_()), ("shard", pa.int64()), ("n", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()),
    ("fingerprints", pa.binary()), ("counts", pa.binary()),
])


@dataclass
class LineIndex:
    """The stored index: a row per shard. ``frequent`` and ``others`` are numbers of shards."""

    shards: DataFrame
    frequent: int
    others: int
    least: int


def line_index(docs: DataFrame, folder: str, least: int = LEAST_DOCUMENTS) -> LineIndex:
    """Index of the line keys that are in at least ``least`` rows of ``docs``, written below ``folder``."""
    counted = docs.select("text").mapInArrow(_counted, "high bigint, low bigint, n bigint")
    keys = stored(counted.groupBy("high", "low").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), folder, "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    keys = keys.withColumn("frequent", F.col("n") > total / FREQUENT)
    sizes = {r.frequent: r["count"] for r in keys.groupBy("frequent").count().collect()}
    frequent, others = (-(-sizes.get(kind, 0) // SHARD_KEYS) for kind in (True, False))
    number = F.when(F.col("frequent"), F.lit(max(1, frequent))).otherwise(F.lit(max(1, others)))
    shards = keys.withColumn("shard", F.pmod("high", number.cast("bigint"))).groupBy("frequent", "shard").applyInArrow(
        _shard, f"frequent boolean, shard bigint, {SHARD_ROW}")
    return LineIndex(stored(shards, folder, "shards"), frequent, others, least)


class _Arrays:
    """The shards of frequent keys, held by every task."""

    def __init__(self, rows: list[dict]):
        self.shards = {r["shard"]: CountIndex.read(r) for r in rows}

    def counts(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.zeros(len(high), np.int64)
        if not self.shards:
            return out
        shard = np.mod(high.view(np.int64), len(self.shards))
        for number, index in self.shards.items():
            mine = np.flatnonzero(shard == number)
            out[mine] = index.of_keys(high[mine], low[mine])
        return out


def _lines(column) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; for all lines with a key of at least one byte: their place and the halves of their hash."""
    each = texts(column)
    lines, keys = [t.split(b"\n") for t in each], [key for t in each for key in line_keys(t)]
    filled = np.flatnonzero(np.fromiter(map(len, keys), np.int64, len(keys)))
    high, low = _hashes([keys[i] for i in filled])
    of_text = np.repeat(np.arange(len(each)), np.fromiter(map(len, lines), np.int64, len(lines)))
    return lines, of_text, filled, high, low


def _probes(frequent):
    """The distinct line hashes of each row that the frequent keys do not settle."""
    arrays: list[_Arrays] = []

    def probes(batches):
        arrays.append(_Arrays(frequent.value))
        for batch in slices(batches):
            _, of_text, filled, high, low = _lines(batch.column("text"))
            rest = arrays[0].counts(high, low) == 0
            row = batch.column(_ROW).to_numpy()[of_text[filled[rest]]]
            each = np.unique(np.stack([row, high[rest].view(np.int64), low[rest].view(np.int64)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(each[:, k]) for k in range(3)], [_ROW, "high", "low"])

    return probes


def _found(least: int):
    """Of the hashes that follow a shard's own row, those whose count reaches ``least``."""
    def found(batches):
        index = None
        for batch in batches:
            starts = np.flatnonzero(batch.column("n").is_valid().to_numpy(zero_copy_only=False))
            for i, j in zip([0, *starts], [*starts, batch.num_rows]):
                part = batch.slice(i, j - i)
                if part.num_rows and part.column("n")[0].is_valid:
                    index = CountIndex.read(part.slice(0, 1).to_pylist()[0])
                    part = part.slice(1)
                if part.num_rows == 0:
                    continue
                high, low = (part.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
                yield part.select([_ROW, "high", "low"]).filter(pa.array(index.of_keys(high, low) >= least))

    return found


def _routed(rows: DataFrame, index: LineIndex, frequent, least: int, folder: str) -> DataFrame:
    """Per row the hashes of lines to drop that the shards of other keys know: ``(row, highs, lows)``."""
    probes = stored(rows.select(_ROW, "text").mapInArrow(_probes(frequent), f"{_ROW} bigint, high bigint, low bigint"), folder, "probes")
    # No key of these shards makes up more than one in FREQUENT, but unknown lines may be many: a shard is copied
    # to so many tasks that each probes about PROBES hashes.
    copies = max(1, -(-probes.count() // (index.others * PROBES)))
    shard = F.pmod("high", F.lit(index.others).cast("bigint"))
    names = [c.split()[0] for c in SHARD_ROW.split(", ")]
    asked = probes.select(
        shard.alias("shard"), F.pmod(F.xxhash64(_ROW, "low"), F.lit(copies)).alias("copy"), F.lit(1).alias("turn"), _ROW, "high", "low",
        *[F.lit(None).cast(kind.split()[1]).alias(name) for name, kind in zip(names, SHARD_ROW.split(", "))])
    none = F.lit(None).cast("bigint")
    shards = index.shards.filter("not frequent").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        "shard", F.col("copy").cast("bigint").alias("copy"), F.lit(0).alias("turn"), none.alias(_ROW), none.alias("high"), none.alias("low"), *names)
    key = ["shard", "copy"]
    ordered = shards.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "turn")
    found = ordered.mapInArrow(_found(least), f"{_ROW} bigint, high bigint, low bigint")
    return found.groupBy(_ROW).agg(F.collect_list("high").alias("_highs"), F.collect_list("low").alias("_lows"))


def _kept(names: list[str], text: str, counts: tuple[str, str], frequent, least: int, routed: bool):
    arrays: list[_Arrays] = []

    def kept(batches):
        arrays.append(_Arrays(frequent.value))
        for batch in slices(batches, text):
            lines, of_text, filled, high, low = _lines(batch.column(text))
            drop = np.zeros(len(of_text), bool)
            drop[filled] = arrays[0].counts(high, low) >= least
            if routed:
                highs, lows = batch.column("_highs").to_pylist(), batch.column("_lows").to_pylist()
                known = {(i, *pair) for i, (x, y) in enumerate(zip(highs, lows)) for pair in zip(x or (), y or ())}
                of_line = zip(of_text[filled].tolist(), high.view(np.int64).tolist(), low.view(np.int64).tolist())
                drop[filled] |= np.fromiter((key in known for key in of_line), bool, len(filled))
            dropped = np.bincount(of_text[drop], minlength=len(lines))
            ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
            out = [b"\n".join(x) for x in lines]
            for i in np.flatnonzero(dropped):
                out[i] = b"\n".join(compress(lines[i], ~drop[ends[i] - len(lines[i]) : ends[i]]))
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in names]
            sizes = [pa.array(np.diff(ends, prepend=0)), pa.array(dropped.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *sizes], [*names, *counts])

    return kept


def without_repeated_lines(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """``docs`` without the lines whose key is in at least ``least`` documents, in every document.

    A text is split at line feeds; a line's key has white space (20, 09 to 0D) stripped at both ends and A-Z in
    lower case. Lines of an empty key always stay. Kept lines are joined by line feeds as they were. Every row is
    a document, also repeated rows, rows without a doc_id and several rows of one; a line that a document holds
    more than once counts once. A null or empty text is one empty line and becomes ''. Texts of any length are read
    whole. All columns stay; ``n_lines`` (before dropping) and ``n_dropped`` follow, under longer names
    if ``docs`` has such columns. Keys are known by 128-bit hashes; a line that is not in the index passes for one
    of it with a probability of 2 to the power of -64.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lines")
    names = [unused(docs, n) for n in (n_lines, n_dropped)]
    index = line_index(docs, folder, least)
    held = index.shards.filter("frequent").toArrow().to_pylist()
    frequent = spark.sparkContext.broadcast(held)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    routed = index.others > 0
    if routed:
        # Written once: both readers see the same row numbers.
        rows = stored(rows.withColumn(_ROW, F.monotonically_increasing_id()), folder, "rows")
        rows = rows.join(_routed(rows, index, frequent, least, folder), _ROW, "left").select(*docs.columns, "_highs", "_lows")
    schema = ", ".join(
        [f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in docs.columns]
        + [f"`{n}` bigint" for n in names])
    return rows.mapInArrow(_kept(docs.columns, "text", tuple(names), frequent, least, routed), schema)
