"""Token counts of flat token files that have no index, by a scan for the end-of-document id.

A file is ids and nothing else. Blocks of it are scanned on their own: one vector comparison finds the
separators. A document that goes over blocks is put together by a prefix scan over the blocks: the last
separator before a block and the number of documents that end before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bankspark.llm.store import NewFile, open_file, stored
from bankspark.llm.tokens import WordEncoder, default_path
from bankspark.llm.words import slices, texts

# Ids that are read and compared at once.
BLOCK_IDS = 1 << 20

ORDER = "file string, place bigint, doc_id bigint"


def id_format(tokenizer: str) -> tuple[int, int]:
    """Separator and bytes per id: the first number that is no id of the tokenizer, so no text holds it."""
    size = WordEncoder(tokenizer).tokenizer.get_vocab_size()
    return size, 2 if size < 1 << 16 else 4


def _write(folder: str, tokenizer: str, end_id: int, bytes_per_id: int):
    def write(batches):
        encoder, out, place = WordEncoder(tokenizer), None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out = out or NewFile(folder, f"flat-{TaskContext.get().partitionId():06d}", ".bin")
            ids = b"".join([encoder.encode(t) + end for t in texts(batch.column("text"))])
            out.write(np.frombuffer(ids, "<u4").astype(f"<u{bytes_per_id}").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([out.name] * n, pa.string()), pa.array(np.arange(place, place + n)), batch.column("doc_id")],
                ["file", "place", "doc_id"],
            )
            place += n
        if out:
            out.close()

    return write


def write_flat(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Write the ids of every whole text to flat files below ``folder``, the separator after each document.

    The table ``order`` beside them names the documents of each file in order; it holds no places and no counts.
    Documents stay in the partitions and the order they have. A null or empty text is a separator alone.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = tokenizer or default_path()
    named.mapInArrow(_write(folder, path, *id_format(path)), ORDER).write.mode("overwrite").parquet(f"{folder}/order")


def _sizes(folder: str, bytes_per_id: int):
    def sizes(batches):
        for batch in batches:
            names, counts = batch.column("file").to_pylist(), []
            for name in names:
                with open_file(folder, name) as file:
                    counts.append(file.size() // bytes_per_id)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(counts, pa.int64())], ["file", "ids"])

    return sizes


def _separators(folder: str, bytes_per_id: int, end_id: int):
    def separators(batches):
        for batch in batches:
            for name, first, count in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "count"))):
                with open_file(folder, name) as file:
                    file.seek(first * bytes_per_id)
                    ids = np.frombuffer(file.read(count * bytes_per_id), f"<u{bytes_per_id}")
                at = np.flatnonzero(ids == end_id) + first
                # What ends in the block began after the separator before; the first one's is in an earlier block.
                sizes = np.diff(at, prepend=first - 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([first] * n, pa.int64()), pa.array(np.arange(n)),
                     pa.array(at), pa.array(sizes)],
                    ["file", "first", "nth", "at", "size"],
                )

    return separators


def count_tokens(files: DataFrame, folder: str, bytes_per_id: int, scratch: str, end_id: int) -> DataFrame:
    """Per document of the flat files: ``file``, ``place`` (from 0), ``start`` and ``n_tokens``, the end id included.

    ``files`` has the names below ``folder``, each once. Only the files' ids are read. Ids after the last
    separator are a document without an end; an empty file has none.
    """
    sizes = stored(files.select("file").mapInArrow(_sizes(folder, bytes_per_id), "file string, ids bigint"), scratch, "sizes")
    blocks = sizes.filter("ids > 0").select(
        "file", "ids", F.explode(F.sequence(F.lit(0), F.expr(f"(ids - 1) div {BLOCK_IDS}"))).alias("block"))
    blocks = blocks.select(
        "file", (F.col("block") * BLOCK_IDS).alias("first"),
        F.least(F.lit(BLOCK_IDS), F.col("ids") - F.col("block") * BLOCK_IDS).alias("count"),
    )
    # Blocks of a file are dealt to all tasks.
    found = blocks.repartition("file", "first").mapInArrow(
        _separators(folder, bytes_per_id, end_id), "file string, first bigint, nth bigint, at bigint, size bigint")
    found = stored(found, scratch, "separators")
    # The prefix scan has a row per block: last separator and number of documents before it.
    summary = found.groupBy("file", "first").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "file", "first", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
    )
    size = F.when(F.col("nth") == 0, F.col("at") - F.col("previous")).otherwise(F.col("size"))
    ended = found.join(carried, ["file", "first"]).select(
        "file", (F.col("ended") + F.col("nth")).alias("place"), (F.col("at") - size + 1).alias("start"), size.alias("n_tokens"))
    last = found.groupBy("file").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    unended = sizes.join(last, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).alias("place"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"),
        (F.col("ids") - 1 - F.coalesce("last", F.lit(-1))).alias("n_tokens"),
    ).filter("n_tokens > 0")
    return ended.unionByName(unended)


def token_counts(spark: SparkSession, folder: str, scratch: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``file``, ``place``, ``start`` and ``n_tokens`` (with the separator) of what ``write_flat`` has written."""
    order = spark.read.schema(ORDER).parquet(f"{folder}/order")
    end_id, width = id_format(tokenizer or default_path())
    counts = count_tokens(order.select("file").distinct(), folder, width, scratch, end_id)
    return order.join(counts, ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
