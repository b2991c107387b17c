"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames and, at its end, the seek table of the public seekable
format: a skippable frame with the compressed size, full size and checksum (low half of XXH64) of every frame.
A frame holds whole documents; only a document above LARGEST ids goes over several frames. The table
``units`` beside the files has a row per run of frames that holds whole documents, with the first and last
doc_id in it, so a reader fetches and decompresses just the frames of the documents it wants.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_intdigest

from bankspark.llm.store import NewFile, open_file
from bankspark.llm.tokens import END_ID, WordEncoder, default_path
from bankspark.llm.words import release, slices, texts

FRAME_IDS, LARGEST = 1 << 16, 1 << 22
# Fixed values of the public format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

UNITS = (
    "part int, file string, frame bigint, frames bigint, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"
)


class FrameWriter:
    """Writes frames to a new file of its own and closes it with the seek table."""

    def __init__(self, folder: str):
        self.file = NewFile(folder, "tokens", ".zst")
        self.table: list[tuple[int, int, int]] = []
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.file.write(packed)
        self.table.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class FrameReader:
    """Reads single frames by the seek table at the end."""

    def __init__(self, folder: str, name: str):
        self.file = open_file(folder, name)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{name}: no seek table with checksums at the end")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        self.sizes, self.full, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        data = self.decompressor.decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.full[k]))
        if xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return data

    def close(self) -> None:
        self.file.close()


def pack(pieces: list[tuple[int | None, bool, bytes]]) -> bytes:
    """Content of a frame: how many pieces; their doc_ids, whether there is one, whether the document ends here, ids."""
    return b"".join([
        struct.pack("<I", len(pieces)), np.array([p[0] or 0 for p in pieces], "<i8").tobytes(),
        bytes(p[0] is not None for p in pieces), bytes(p[1] for p in pieces),
        np.array([len(p[2]) // 4 for p in pieces], "<u4").tobytes(), *[p[2] for p in pieces],
    ])


def unpack(data: bytes):
    n = struct.unpack_from("<I", data)[0]
    ids = np.frombuffer(data, "<i8", n, 4)
    has, last = data[4 + 8 * n : 4 + 9 * n], data[4 + 9 * n : 4 + 10 * n]
    sizes = np.frombuffer(data, "<u4", n, 4 + 10 * n).astype(np.int64)
    at = 4 + 14 * n
    for k in range(n):
        yield (int(ids[k]) if has[k] else None), bool(last[k]), data[at : at + 4 * int(sizes[k])]
        at += 4 * int(sizes[k])


def _write(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        encoder, end, out = WordEncoder(tokenizer), struct.pack("<I", end_id), None
        part = TaskContext.get().partitionId()
        rows, pieces, held = [], [], 0

        def flush(first_frame: int) -> None:
            nonlocal pieces, held
            n_ids = sum(len(p[2]) // 4 for p in pieces)
            out.frame(pack(pieces))
            rows.append((part, out.file.name, first_frame, 1, len(pieces), n_ids, pieces[0][0], pieces[-1][0]))
            pieces, held = [], 0

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                out = out or FrameWriter(folder)
                ids = encoder.encode(text) + end
                if len(ids) > 4 * LARGEST:
                    if pieces:
                        flush(len(out.table))
                    first = len(out.table)
                    for k in range(0, len(ids), 4 * LARGEST):
                        out.frame(pack([(doc_id, k + 4 * LARGEST >= len(ids), ids[k : k + 4 * LARGEST])]))
                    rows.append((part, out.file.name, first, len(out.table) - first, 1, len(ids) // 4, doc_id, doc_id))
                    continue
                pieces.append((doc_id, True, ids))
                held += len(ids) // 4
                if held >= FRAME_IDS:
                    flush(len(out.table))
        del encoder
        release()
        if out:
            if pieces:
                flush(len(out.table))
            out.close()
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
            names = [x.split()[0] for x in UNITS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, ``end_id`` after each document, in ascending doc_id order below ``folder``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out. A null or empty text is its end id alone.
    Rows without a doc_id come first; rows of the same doc_id follow each other in the order of their texts' hash.
    An empty table gives no file. The tokenizer's path must exist on all machines.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Range partitioning keeps the order over the files; each partition is a file.
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_write(folder, tokenizer or default_path(), end_id), UNITS).write.mode("overwrite").parquet(f"{folder}/units")


def units(spark: SparkSession, folder: str) -> DataFrame:
    """The units of the files, each with ``start``: the ids of all documents before it."""
    rows = spark.read.schema(UNITS).parquet(f"{folder}/units")
    # A row per file here, and its units in order below: neither grows into one task.
    files = rows.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return rows.join(files, "part").select(*rows.columns, start.alias("start"))


def _read(folder: str):
    def read(batches):
        reader, name = None, None
        for batch in batches:
            for unit in batch.to_pylist():
                if unit["file"] != name:
                    if reader:
                        reader.close()
                    reader, name = FrameReader(folder, unit["file"]), unit["file"]
                ids, starts, values, start, parts = [], [], [], unit["start"], []
                for k in range(unit["frame"], unit["frame"] + unit["frames"]):
                    for doc_id, last, data in unpack(reader.frame(k)):
                        parts.append(data)
                        if last:
                            value = b"".join(parts) if len(parts) > 1 else data
                            ids.append(doc_id)
                            starts.append(start)
                            values.append(value)
                            start, parts = start + len(value) // 4, []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())],
                    ["doc_id", "start", "ids"],
                )
        if reader:
            reader.close()

    return read


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` and ``ids`` (little-endian 32-bit numbers) of all documents, or of ``doc_ids`` alone.

    For ``doc_ids`` only the frames that may hold them are fetched and decompressed.
    """
    wanted = units(spark, folder)
    if doc_ids is not None:
        inside = F.exists(
            F.array(*[F.lit(int(i)).cast("bigint") for i in doc_ids]) if doc_ids else F.array().cast("array<bigint>"),
            lambda i: i.between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id")),
        )
        wanted = wanted.filter(inside)
    # Units of a file stay together in file order, so that a task opens each file once.
    spread = wanted.repartitionByRange("part", "frame").sortWithinPartitions("part", "frame")
    docs = spread.mapInArrow(_read(folder), "doc_id bigint, start bigint, ids binary")
    return docs if doc_ids is None else docs.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def token_rows(rows: DataFrame) -> DataFrame:
    """Digest of what the files hold: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    return rows.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
