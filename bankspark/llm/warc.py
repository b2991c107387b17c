"""WARC records in ZIP archives: written by partition, read by range without extraction.

An archive holds two stored members: ``archive/data.warc.gz``, a gzip member per record, and
``indexes/index.cdxj`` with the place of each record in it. The reader finds the central directory from the end
of the file, in the ZIP64 form as well, and fetches the index and then single records by their byte ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bankspark.llm.store import NewFile, open_file, stored
from bankspark.llm.words import slices, texts

LEAST_REVISIT = 1000
# An archive is closed when its records take this much; a task holds one in memory.
ARCHIVE_BYTES = 32 << 20
# Records that one range of reading covers, about.
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the WARC and ZIP formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    name = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record. A revisit keeps the HTTP head, which tells the payload's length, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=-._~")))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields and payload. The payload of a response must have the digest that the record states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": None if uri is None else unquote(uri), "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
    }


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name to method, offset of the local header and stored size.

    ``read(offset, length)`` fetches a range. Numbers that don't fit their 16 or 32 bits are in the ZIP64 records.
    """
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end + tail_at >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        locator = read(end + tail_at - 20, 20)
        if locator[:4] == LOCATOR64:
            record64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != END64:
                raise ValueError("no ZIP64 directory")
            count, length, start = struct.unpack_from("<QQQ", record64, 32)
    data, at, out = read(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("wrong entry in the ZIP directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        packed, full, names, extras, comments = struct.unpack_from("<IIHHH", data, at + 20)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + names].decode()
        extra, k = data[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{room // 8}Q", extra, k + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            k += 4 + room
        out[name] = (method, offset, packed)
        at += 46 + names + extras + comments
    return out


def member_range(read, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Offset and length of a stored member's bytes."""
    method, offset, size = entry
    local = read(offset, 30)
    if method != 0 or local[:4] != LOCAL:
        raise ValueError("member is not stored")
    names, extras = struct.unpack_from("<HH", local, 26)
    return offset + 30 + names + extras, size


def _ranged(file):
    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return read


class ArchiveWriter:
    """Gathers records and writes them as one archive."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.index.append(json.dumps({
            "page": page_id, "url": url, "filename": DATA, "offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def write(self, folder: str) -> tuple[str, int, int]:
        whole = io.BytesIO()
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as z:
            z.writestr(DATA, self.data.getbuffer())
            z.writestr(INDEX, "\n".join(self.index))
        file = NewFile(folder, "pages", ".wacz")
        file.write(whole.getbuffer())
        file.close()
        return file.name, file.size, len(self.index)


def _write(folder: str, archive_bytes: int):
    def write(batches):
        out, archive = [], ArchiveWriter()
        for batch in slices(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")]
            for payload, page_id, url, digest, refers_to, revisit in zip(texts(batch.column("payload")), *columns):
                archive.add(page_id, url, record(page_id, url, payload, digest, refers_to, revisit))
                if archive.data.tell() >= archive_bytes:
                    out.append(archive.write(folder))
                    archive = ArchiveWriter()
        if archive.index:
            out.append(archive.write(folder))
        names, sizes, counts = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            ["file", "size", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) to archives below ``folder``.

    Of rows with equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is a response, as
    are rows that repeat that page_id; the others are revisits of it. A null or empty html is an empty payload. A
    null page_id is smaller than any other; rows of equal payload that all lack one are all responses. Other
    columns are left out; an empty table gives no archive. The table ``archives`` lists the files that count.
    """
    named = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # Counts and largest ids combine before the shuffle. Only payloads that occur more than once are joined back;
    # a payload that very many pages share is a skewed join, which adaptive execution splits.
    shared = (
        named.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        .select("digest", "bytes", "first_page", F.lit(True).alias("shared"))
    )
    decided = named.join(shared, ["digest", "bytes"], "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = decided.select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_page")).alias("refers_to"), revisit.alias("revisit"))
    rows.mapInArrow(_write(folder, archive_bytes), "file string, size bigint, records bigint").write.mode("overwrite").parquet(f"{folder}/archives")


def _ranges(folder: str, range_bytes: int):
    """Byte ranges of about ``range_bytes`` that hold whole records, from the index in each archive."""
    def ranges(batches):
        for batch in batches:
            for name, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist()):
                with open_file(folder, name) as file:
                    read = _ranged(file)
                    members = directory(read, size)
                    start, _ = member_range(read, members[DATA])
                    lines = read(*member_range(read, members[INDEX])).decode().split("\n")
                out, lengths = [], []
                places = [json.loads(line) for line in lines if line]
                for k, place in enumerate(places):
                    lengths.append(place["length"])
                    if sum(lengths) >= range_bytes or k + 1 == len(places):
                        out.append((name, start + place["offset"] + place["length"] - sum(lengths), lengths))
                        lengths = []
                names, offsets, sizes = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.list_(pa.int64()))],
                    ["file", "offset", "lengths"])

    return ranges


def _records(folder: str, with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def records(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(folder, row["file"]) as file:
                    data, at, out = _ranged(file)(row["offset"], sum(row["lengths"])), 0, []
                for length in row["lengths"]:
                    found = parsed(gzip.decompress(data[at : at + length]))
                    out.append([found[n] for n in names[:-1]] + [found["payload"] if with_payload else None])
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return records


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives that ``write_archives`` lists; ``payload`` is null for revisits."""
    archives = spark.read.schema("file string, size bigint, records bigint").parquet(f"{folder}/archives")
    places = archives.repartition("file").mapInArrow(_ranges(folder, range_bytes), "file string, offset bigint, lengths array<bigint>")
    # Ranges are of like size; dealt out evenly, they don't depend on how large an archive is.
    places = stored(places, folder, "ranges")
    return places.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_records(folder, with_payload), RECORDS)
