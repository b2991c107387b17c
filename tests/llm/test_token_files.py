"""Exact round trips of the token files, and the encoder against the library."""

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bankspark.llm import token_files as T
from bankspark.llm.store import opened
from bankspark.llm.token_counts import count_tokens, token_counts, write_flat
from bankspark.llm.tokens import WordEncoder, default_path


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder(library):
    rng = random.Random(8)
    letters = "aBcé'ssÉñ 12٣Ⅷ² .,!?_-<|>İΣς́  \x1c\x1f\x85\t\n\x0bßﬁ中文한 国🙂‍"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "it's 'tis don't we'LL ..'s", "", "ΑΣ ΑΣΑ", "Ǆ ŉ"]
    encoder = WordEncoder(default_path())
    assert all(np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() == library(t) for t in texts)


def test_encoder_works_out_a_word_once_and_reads_its_file_once(monkeypatch):
    encoder = WordEncoder(default_path())
    monkeypatch.setattr(Tokenizer, "from_file", lambda path: pytest.fail("read again"))
    again, asked = WordEncoder(default_path()), []
    monkeypatch.setattr(again, "word", lambda word: asked.append(word) or b"")
    again.encode(b"one two one three two one")
    again.encode(b"three four")
    assert asked == ["one", "two", "three", "four"]
    # What one task remembers goes with it.
    assert not encoder and not encoder.parts


def expected(rows, library):
    out, at = [], 0
    for doc_id, text in rows:
        ids = library(text) + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_with_odd_rows(spark, documents, odd, tmp_path, library, monkeypatch):
    rows = [r for r in odd if r[0] != 6 and r[0] is not None] + [(-3, "below zero # and #"), (8, "x")]
    T.write_tokens(documents(rows), str(tmp_path / "a"))
    got = sorted(map(tuple, T.token_rows(T.read_tokens(spark, str(tmp_path / "a"))).collect()))
    assert got == expected(sorted(rows), library)
    wanted = T.token_rows(T.read_tokens(spark, str(tmp_path / "a"), [5, 8, 1234])).collect()
    assert sorted(map(tuple, wanted)) == [g for g in got if g[0] in (5, 8)]
    # With equal and missing ids the totals still hold.
    T.write_tokens(documents(odd), str(tmp_path / "b"))
    whole = T.token_rows(T.read_tokens(spark, str(tmp_path / "b"))).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in whole) == sorted((str(i), len(library(t)) + 1) for i, t in odd)
    T.write_tokens(documents([]), str(tmp_path / "c"))
    assert T.read_tokens(spark, str(tmp_path / "c")).count() == 0


def test_frames_and_documents_over_several(tmp_path):
    folder = str(tmp_path)
    writer = T.FrameWriter(folder)
    pieces = [[(1, True, struct.pack("<3I", 5, 6, 7)), (None, True, b"")], [(9, False, struct.pack("<I", 1))], [(9, True, struct.pack("<I", 2))]]
    for p in pieces:
        writer.frame(T.pack(p))
    writer.close()
    reader = T.FrameReader(folder, writer.file.name)
    assert [list(T.unpack(reader.frame(k))) for k in (2, 0, 1)] == [pieces[2], pieces[0], pieces[1]]
    rows = list(T._read(folder)([__import__("pyarrow").RecordBatch.from_pylist([{"file": writer.file.name, "frame": 1, "frames": 2, "start": 10}])]))
    assert rows[0].to_pylist() == [{"doc_id": 9, "start": 10, "ids": struct.pack("<2I", 1, 2)}]
    path = tmp_path / writer.file.name
    data = bytearray(path.read_bytes())
    data[-10] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="checksum"):
        T.FrameReader(folder, writer.file.name).frame(2)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_flat_files(spark, documents, odd, tmp_path, library, monkeypatch, block):
    monkeypatch.setattr("bankspark.llm.token_counts.BLOCK_IDS", block)
    rows = [r for r in odd if r[0] != 5] + [(8, "# has the id 2")]
    write_flat(documents(rows).repartition(3), str(tmp_path / "a"))
    got = token_counts(spark, str(tmp_path / "a"), str(tmp_path / "s")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library(t)) + 1) for i, t in rows)
    write_flat(documents([]), str(tmp_path / "b"))
    assert token_counts(spark, str(tmp_path / "b"), str(tmp_path / "t")).count() == 0


def test_files_of_others(spark, tmp_path, monkeypatch):
    """Files without separators, with only separators, empty, and with an open end, against a plain loop."""
    monkeypatch.setattr("bankspark.llm.token_counts.BLOCK_IDS", 4)
    rng = np.random.default_rng(9)
    files = {"empty": [], "none": [1] * 9, "only": [7] * 6, **{f"r{k}": rng.integers(0, 9, rng.integers(1, 60)).tolist() for k in range(6)}}
    _, path = opened(str(tmp_path))
    want = []
    for name, ids in files.items():
        np.array(ids, "<u4").tofile(f"{path}/{name}")
        start, place = 0, 0
        for k, x in enumerate(ids):
            if x == 7 or k + 1 == len(ids):
                want.append((name, place, start, k + 1 - start))
                start, place = k + 1, place + 1
    names = spark.createDataFrame([(n,) for n in files], "file string")
    assert sorted(map(tuple, count_tokens(names, str(tmp_path), 4, str(tmp_path / "scratch"), 7).collect())) == sorted(want)
