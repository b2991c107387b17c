"""Archives written and read back; directories of both kinds."""

import hashlib
import io
import struct
import zipfile

import pytest

from bankspark.llm import warc as W


def ranged(data):
    return lambda offset, length: data[offset : offset + length]


def test_directories(monkeypatch):
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
        z.comment = b"a comment PK"
    data = plain.getvalue()
    members = W.directory(ranged(data), len(data))
    place, size = W.member_range(ranged(data), members["b"])
    assert data[place : place + size] == b"second"
    # The same with every number in the ZIP64 records.
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
    data = wide.getvalue()
    assert W.LOCATOR64 in data
    place, size = W.member_range(ranged(data), W.directory(ranged(data), len(data))["b"])
    assert data[place : place + size] == b"second"
    with pytest.raises(ValueError):
        W.directory(ranged(b"no archive"), 10)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = packed.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        W.member_range(ranged(data), W.directory(ranged(data), len(data))["a"])


def test_wrong_payload_is_an_error():
    data = W.record(1, "http://x", b"abc", hashlib.sha1(b"abd").hexdigest(), None, False)
    with pytest.raises(ValueError, match="digest"):
        W.parsed(data)


def test_pages(spark, tmp_path):
    long = "é\r\n\r\n<p>" * 300
    rows = [(1, "http://a/1", long), (5, "http://a/ü?q=1\r\nX: y", long), (5, "again", long), (3, None, long), (None, "n", long),
            (6, "s", "short"), (7, "s", "short"), (8, "", None), (9, "e", ""), (10, "v", "long " * 40_000), (None, "m", "z" * 2000), (None, "m2", "z" * 2000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, size int")
    W.write_archives(pages.coalesce(1), str(tmp_path / "a"), archive_bytes=900)
    assert spark.read.parquet(str(tmp_path / "a/archives")).count() > 2
    got = W.read_archives(spark, str(tmp_path / "a"), range_bytes=300).collect()
    want = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        revisit = len(payload) >= 1000 and bool(same) and page_id != max(same)
        want.append((page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     max(same) if revisit else None, None if revisit else payload))
    assert sorted(map(str, want)) == sorted(str(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)) for r in got)
    W.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert W.read_archives(spark, str(tmp_path / "b")).count() == 0
