"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are bigram models over one vocabulary, all words of the corpus. The target model counts the target
texts, the background model all texts. A document's score is its loss per token under the target model minus
that under the background model: the lower, the more it is like the target. Words and pairs are known by 64-bit hashes.

Texts are counted in slices. A slice's counts go, as sorted hashes in one row for each part of the hash range, to the
task of that part, which adds up all slices and answers each with the totals of its own words and pairs; a pair that
the corpus has once and the target never needs no answer. The slice's texts, kept as word numbers, are then scored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from bankspark.llm.store import NewFile, new_folder, open_file, stored
from bankspark.llm.words import ascii_words, mixed, slices, texts, word_hashes

# Weight of the word's own frequency in the estimate after a given word, and of an even spread in that.
FROM_WORD, EVEN = 50.0, 1.0
COUNTED_AT_ONCE = 300_000
# Bytes of text in a slice, and for each part of the hash range.
SLICE, PART = 8 << 20, 8 << 20
# Slices that one task counts.
SLICES_IN_TASK = 4
# Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
# Losses are added up as whole numbers of this part, exact in doubles, so that the order of adding changes nothing.
UNIT = 1 << 32

SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"
# Rows that slices send to the parts: pairs, words; and one of their own, which only names the slice.
PAIRS, WORDS, NAME = 0, 1, 2
_COUNTS = "kind int, part bigint, slice string, keys binary, first binary, second binary, first_in binary, second_in binary"
_ANSWERS = "slice string, kind int, part bigint, at binary, totals binary, n_words bigint, n_all bigint, m_all bigint"


def _word_counts(batches):
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in texts(batch.column("text")):
            counts.update(ascii_words(text))
        if len(counts) > COUNTED_AT_ONCE:
            yield rows()
            counts.clear()
    yield rows()


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all first bytes first: alike bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs."""
    top = int(values.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    return bytes([size]) + _packed(values.astype(f"<u{size}"))


def _read_small(data: bytes, number: int) -> tuple[np.ndarray, bytes]:
    """So many numbers, and the bytes that follow them."""
    end = 1 + data[0] * number
    return _unpacked(data[1:end], np.dtype(f"<u{data[0]}")).astype(np.int64), data[end:]


def _sorted_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _read_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the hash range starts in sorted keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


class _Slice:
    """Texts as numbers of their words, with the sorted hashes of words and pairs.

    ``words`` are the hashes of the texts' words (0 stands for the start of a text and for unknown words), ``of_token`` has
    each token's word, ``sizes`` the tokens of each text, ``chosen`` whether the text is one of the target.
    """

    def __init__(self, words: np.ndarray, of_token: np.ndarray, sizes: np.ndarray, chosen: np.ndarray):
        self.words, self.of_token, self.sizes, self.chosen = words, of_token, sizes, chosen

    @classmethod
    def of(cls, documents: list[bytes], known: np.ndarray | None, chosen: np.ndarray) -> _Slice:
        number: dict[bytes, int] = {}
        each = []
        # Text by text: the words of a whole slice as objects would take ten times its size.
        for text in documents:
            split = ascii_words(text)
            for word in split:
                number.setdefault(word, len(number))
            each.append(np.fromiter(map(number.__getitem__, split), np.uint32, len(split)))
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        hashes = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number))
        if known is not None:
            hashes = np.where(np.isin(hashes, known), hashes, np.uint64(0))
        words, of_word = np.unique(np.concatenate((np.zeros(1, np.uint64), hashes)), return_inverse=True)
        of_token = np.concatenate(each) if each else np.empty(0, np.uint32)
        return cls(words, of_word[1:].astype(np.uint32)[of_token], sizes, chosen)

    def write(self, file, doc_ids: pa.Array) -> None:
        ids = doc_ids.cast(pa.int64())
        parts = [
            ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), self.sizes.tobytes(),
            _sorted_keys(self.words), _packed(self.of_token), self.chosen.tobytes(),
        ]
        data = np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)
        file.write(zstandard.ZstdCompressor(level=1).compress(data))

    @classmethod
    def read(cls, data: bytes) -> tuple[_Slice, pa.Array]:
        data = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(np.frombuffer(data[:48], np.int64)) + 48
        ids, valid, sizes, words, of_token, chosen = (data[a:b] for a, b in zip([48, *ends[:-1]], ends))
        doc_ids = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(valid, np.bool_))
        sizes, chosen = np.frombuffer(sizes, np.int64), np.frombuffer(chosen, np.bool_)
        return cls(_read_keys(words), _unpacked(of_token, np.uint32), sizes, chosen), doc_ids

    def before(self) -> np.ndarray:
        """The word before each token; the first of a text follows the start, which is word 0 by its hash."""
        out = np.concatenate((np.zeros(1, np.uint32), self.of_token))[: len(self.of_token)]
        out[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct pairs, and each token's pair among them."""
        each = mixed(mixed(self.words[self.before()]) * np.uint64(0x9E3779B97F4A7C15) + self.words[self.of_token])
        return np.unique(each, return_inverse=True)


def _counts(name: str, of: _Slice, parts: int):
    """Rows of a slice for the parts: how often its words and pairs occur, and how often in texts of the target."""
    keys, of_token = of.pairs()
    chosen = np.repeat(of.chosen, of.sizes)
    # Sums of zeros and ones are exact.
    count = lambda at, n: (np.bincount(at, minlength=n), np.bincount(at[chosen], minlength=n))
    n, m = count(of_token, len(keys))
    (after, after_in), (into, into_in) = (count(x, len(of.words)) for x in (of.before(), of.of_token))
    used = np.flatnonzero((after > 0) | (into > 0))
    rows = []
    for kind, these, counts in (
        (PAIRS, keys, (n, None, m, None)), (WORDS, of.words[used], tuple(x[used] for x in (after, into, after_in, into_in)))
    ):
        edges = _edges(these, parts)
        for part in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[part], edges[part + 1]
            rows.append((kind, part, name, _sorted_keys(these[a:b]), *(None if x is None else _small(x[a:b]) for x in counts)))
    return rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in _COUNTS.split(", ")])


def _written(folder: str, known: np.ndarray | None, size: int):
    """Writes the texts as slices; gives the names of their files and the bytes of text."""
    def written(batches):
        for batch in slices(batches, limit=size):
            documents = texts(batch.column("text"))
            chosen = batch.column("target").fill_null(False).to_numpy(zero_copy_only=False)
            file = NewFile(folder, "slice", ".zst")
            _Slice.of(documents, known, chosen).write(file, batch.column("doc_id"))
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.name]), pa.array([sum(map(len, documents))], pa.int64())], ["slice", "bytes"])

    return written


def _counted(folder: str, parts: int):
    def counted(batches):
        for batch in batches:
            for name in batch.column("slice").to_pylist():
                with open_file(folder, name) as file:
                    of, _ = _Slice.read(file.read())
                rows = [(NAME, 0, name, *[None] * 5), *_counts(name, of, parts)]
                for start in range(0, len(rows), 256):
                    yield _rows(rows[start : start + 256])

    return counted


def _added(batches):
    """Totals of each part, as answers to the slices that asked; and how many words and pairs there are in all."""
    def answers(kind: int, part: int, rows: list[dict]):
        if kind == NAME:
            return [(r["slice"], NAME, 0, None, None, None, None, None) for r in rows]
        keys = [_read_keys(r["keys"]) for r in rows]
        names = ("first", "first_in") if kind == PAIRS else ("first", "second", "first_in", "second_in")
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        totals = np.zeros((len(names), len(distinct)), np.int64)
        for a, b, row in zip([0, *ends[:-1]], ends, rows):
            for c, name in enumerate(names):
                totals[c, at[a:b]] += _read_small(row[name], b - a)[0]
        out = []
        for a, b, row in zip([0, *ends[:-1]], ends, rows):
            mine = totals[:, at[a:b]]
            told = np.flatnonzero((mine[0] > 1) | (mine[1] > 0)) if kind == PAIRS else np.arange(b - a)
            if len(told):
                found = b"".join(_small(x[told]) for x in mine)
                out.append((row["slice"], kind, part, len(told).to_bytes(8, "little") + _small(np.diff(told, prepend=0)), found, None, None, None))
        if kind == WORDS:
            # Once for the part: its words (the start is none) and the pairs that lead to them.
            out.append((None, WORDS, part, None, None, int((distinct != 0).sum()), int(totals[1].sum()), int(totals[3].sum())))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in _ANSWERS.split(", ")])

    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["kind"], row["part"]) != at:
                yield batch_of(answers(*at, held))
                held = []
            at = row["kind"], row["part"]
            held.append(row)
    if held:
        yield batch_of(answers(*at, held))


def _scored(folder: str, parts: int, width: int, n_all: int, m_all: int):
    """Scores of each slice's texts from the answers that lie next to each other."""
    def loss(count, after, into, in_all):
        share = (into + EVEN) / (in_all + EVEN * width)
        return np.rint(-np.log((count + FROM_WORD * share) / (after + FROM_WORD)) * UNIT)

    def scored(name: str, answers: list[dict]):
        with open_file(folder, name) as file:
            of, doc_ids = _Slice.read(file.read())
        keys, of_token = of.pairs()
        pairs, words = np.zeros((2, len(keys))), np.zeros((4, len(of.words)))
        pairs[0] = 1
        after, into = of.before(), of.of_token
        used = np.zeros(len(of.words), bool)
        used[after], used[into] = True, True
        place = np.flatnonzero(used)
        edges = {PAIRS: _edges(keys, parts), WORDS: _edges(of.words[place], parts)}
        for r in answers:
            if r["kind"] != NAME:
                number, rest = int.from_bytes(r["at"][:8], "little"), r["totals"]
                at = edges[r["kind"]][r["part"]] + np.cumsum(_read_small(r["at"][8:], number)[0])
                for counts in pairs if r["kind"] == PAIRS else words:
                    counts[at if r["kind"] == PAIRS else place[at]], rest = _read_small(rest, number)
        # One token of each pair gives the words of it.
        some = np.zeros(len(keys), np.int64)
        some[of_token] = np.arange(len(of_token))
        a, b = after[some], into[some]
        document = np.repeat(np.arange(len(of.sizes)), of.sizes)
        mean = lambda x: np.bincount(document, x[of_token], len(of.sizes)) / UNIT / np.maximum(of.sizes, 1)
        empty = of.sizes == 0
        background = mean(loss(pairs[0], words[0, a], words[1, b], n_all))
        target = mean(loss(pairs[1], words[2, a], words[3, b], m_all))
        columns = [pa.array(x, pa.float64(), mask=empty) for x in (target, background, target - background)]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(of.sizes), *columns], [c.split()[0] for c in SCORES.split(", ")])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["slice"] != at:
                    yield scored(at, held)
                    held = []
                at = row["slice"]
                held.append(row)
        if held:
            yield scored(at, held)

    return run


def marked(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells whether a row's doc_id is one of ``ids``."""
    ids = ids.select("doc_id").filter("doc_id is not null").distinct().withColumn(name, F.lit(True))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cross_entropy_difference(docs: DataFrame, target: Column, vocabulary: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out. ``target`` tells which rows are target texts (null:
    not). Vocabulary and background model come from all of ``docs``, the target model from the target texts. Words are
    runs without white space, A-Z in lower case. A null or empty text has no tokens and null losses and score. With
    ``vocabulary`` only so many most frequent words are told apart, those of equal counts in order of their bytes.
    Repeated rows count as often as they occur, rows without a doc_id too; without target texts that model is even. A
    very long text is a slice of its own.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "cross-entropy")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", target.cast("boolean").alias("target"))
    known = None
    if vocabulary is not None:
        words = rows.select("text").mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        common = words.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
        known = word_hashes([[bytes(r.word) for r in common]])
    # Only the files that this table names count: a task that runs again writes others.
    written = stored(rows.mapInArrow(_written(f"{folder}/files", known, SLICE), "slice string, bytes bigint"), folder, "slices")
    size = written.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(1, -(-(size[1] or 0) // PART))
    tasks = max(1, -(-size[0] // SLICES_IN_TASK))
    counts = written.select("slice").repartition(tasks).mapInArrow(_counted(f"{folder}/files", parts), _COUNTS)
    # Names of slices are dealt by themselves.
    dealt = F.when(F.col("kind") == NAME, F.xxhash64("slice")).otherwise(F.col("part"))
    ordered = counts.withColumn("part", dealt).repartition("kind", "part").sortWithinPartitions("kind", "part")
    answers = stored(ordered.mapInArrow(_added, _ANSWERS), folder, "answers")
    sums = answers.filter("slice is null").agg(F.sum("n_words"), F.sum("n_all"), F.sum("m_all")).first()
    width = 1 + (sums[0] or 0 if vocabulary is None else vocabulary)
    told = answers.filter("slice is not null").select("slice", "kind", "part", "at", "totals")
    return told.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        _scored(f"{folder}/files", parts, width, sums[1] or 0, sums[2] or 0), SCORES)
