"""WARC records in ZIP packages, written and range-read on the executors.

A package is a ZIP file whose members are stored, not deflated:

    archive/data.warc.gz    one gzip member per WARC record
    indexes/index.cdx.gz    gzip members of lines "page_id offset length" (64-bit, little-endian triples)

As nothing is deflated by the ZIP, a record's place in the package is its member's
place plus its offset. The reader takes the end record and the central directory
(ZIP64 included) from the tail of the file, the index from its member, and then
fetches ranges of records; no member is ever unpacked as a whole.

Packages are plain files in the shared folder, reached with pyarrow.fs, so any
store it knows serves (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import durable, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx.gz"
# Fixed values of the ZIP format: signatures and the marks of 64-bit fields.
LOCAL, CENTRAL, EOCD, EOCD64, LOCATOR = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07",
)
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
TRIPLE = "<qqq"

MANIFEST = "path string, bytes long, records long"
ENTRY = "path string, start long, length long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and its length, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload_bytes, digest, payload or None) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = field["warc-payload-digest"].partition(":")[2]
    revisit = field["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {field['warc-record-id']} is damaged")

    def number(x: str | None):
        x = None if x is None else x.rpartition(":")[2].rstrip(">")
        return None if x in (None, "None") else int(x)

    return (
        number(field["warc-record-id"]), field["warc-target-uri"], field["warc-type"],
        number(field.get("warc-refers-to")), length, digest, None if revisit else payload,
    )


class PackageWriter:
    """Writes stored members one after the other, sizes in data descriptors."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # Version 4.5, flag 8: CRC and sizes follow the data, as 64-bit fields.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> None:
        member = self.members[-1]
        member[2] = zlib.crc32(data, member[2])
        member[3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, at, crc, size in self.members:
            large = self.zip64 or max(at, size) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if large else b""
            s, a = (FULL32, FULL32) if large else (size, at)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        length, n = self.at - begin, len(self.members)
        large = self.zip64 or max(begin, length) >= FULL32
        if large:
            there = self.at
            self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(LOCATOR + struct.pack("<IQI", 0, there, 1))
        self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, n, n, *((FULL32, FULL32) if large else (length, begin)), 0))


def _range(f, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)


def central_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first data byte, length) of every stored member, by the tail of the file."""
    tail_at = max(0, size - 65_557 - 76)
    tail = _range(f, tail_at, size - tail_at)
    end = tail.rfind(EOCD)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, begin = struct.unpack_from("<HII", tail, end + 10)
    if FULL32 in (length, begin) or n == FULL16:
        if tail[end - 20 : end - 16] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        (there,) = struct.unpack_from("<Q", tail, end - 12)
        record = _range(f, there, 56)
        if record[:4] != EOCD64:
            raise ValueError("no ZIP64 end record")
        n, length, begin = struct.unpack_from("<QQQ", record, 32)
    raw, at, found = _range(f, begin, length), 0, {}
    for _ in range(n):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", raw, at + 20)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + names].decode()
        extra, x = raw[at + 46 + names : at + 46 + names + extras], 0
        while x + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                values = [v for (v,) in struct.iter_unpack("<Q", extra[x + 4 : x + 4 + long // 8 * 8])]
                full = values.pop(0) if full == FULL32 else full
                packed = values.pop(0) if packed == FULL32 else packed
                offset = values.pop(0) if offset == FULL32 else offset
            x += 4 + long
        if method == 0:
            head = _range(f, offset, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + names + extras + notes
    return found


def gzip_members(raw: bytes) -> Iterator[bytes]:
    while raw:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(raw)
        raw = unpack.unused_data


def write_packages(records: DataFrame, *, zip64: bool = False) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to) and return the manifest (path, bytes, records).

    Each partition becomes one package, streamed to a file of its own name, so a
    repeated task leaves a file that no manifest names. An empty partition makes none.
    """
    folder = f"{shared_folder(records.sparkSession)}/llm/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = package = None
        index, rows = bytearray(), 0
        for batch in batches:
            for page, url, payload, digest, refers in batch.itertuples(index=False, name=None):
                if out is None:
                    files, root = open_fs(folder)
                    files.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = files.open_output_stream(f"{root}/{name}")
                    package = PackageWriter(out, zip64)
                    package.begin(DATA)
                    start = package.at
                known = lambda x: None if x is None or x != x or x is pd.NA else int(x)
                raw = gzip.compress(warc_record(known(page), url, payload or b"", digest, known(refers)), 3, mtime=0)
                index += struct.pack(TRIPLE, -1 if known(page) is None else known(page), package.at - start, len(raw))
                package.add(raw)
                rows += 1
        if out is not None:
            package.end()
            package.begin(INDEX)
            # One gzip member for each 4096 lines.
            step = 4096 * struct.calcsize(TRIPLE)
            for at in range(0, len(index), step):
                package.add(gzip.compress(bytes(index[at : at + step]), 6, mtime=0))
            package.end()
            package.close()
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [package.at], "records": [rows]})

    columns = ("page_id", "url", "payload", "digest", F.col("refers_to").cast("long").alias("refers_to"))
    return durable(records.select(*columns).mapInPandas(write, MANIFEST), "manifest")


def package_ranges(packages: DataFrame, *, range_bytes: int = 1 << 20) -> DataFrame:
    """(path, start, length): runs of whole records of about range_bytes, from each package's index."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                files, name = open_fs(path)
                size = files.get_file_info(name).size
                with files.open_input_file(name) as f:
                    members = central_directory(f, size)
                    data, _ = members[DATA]
                    at, length = members[INDEX]
                    spans: list[list[int]] = []
                    for part in gzip_members(_range(f, at, length)):
                        for _, offset, long in struct.iter_unpack(TRIPLE, part):
                            if spans and spans[-1][1] < range_bytes:
                                spans[-1][1] = offset + long - spans[-1][0]
                            else:
                                spans.append([offset, long])
                yield pd.DataFrame(
                    {"path": path, "start": [data + a for a, _ in spans], "length": [n for _, n in spans]}
                )

    return packages.select("path").mapInPandas(locate, ENTRY)


def read_records(ranges: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records in the given ranges; every payload is checked against its digest."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            for path, start, length in batch.itertuples(index=False, name=None):
                files, name = open_fs(path)
                with files.open_input_file(name) as f:
                    rows = [parse_record(raw) for raw in gzip_members(_range(f, start, length))]
                frame = pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                if not payloads:
                    frame["payload"] = None
                yield frame

    return ranges.mapInPandas(fetch, RECORD)


def mark_revisits(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): the plan of what is written.

    Of pages with equal payloads of at least min_bytes, the smallest page_id is
    the response; all others refer to it and their payload stays only as a length,
    as the WARC keeps no more. Null html is an empty payload; a null page_id never
    is the one referred to unless all are null, and then each is a response. Of
    rows that repeat the smallest page_id, all are responses.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("_sha1"))
    # Decided on ids and digests alone; payloads move once, by page.
    known = rows.select("page_id", "_sha1", F.octet_length("payload").alias("_bytes")).distinct()
    first = known.where(F.col("_bytes") >= min_bytes).groupBy("_sha1").agg(F.min("page_id").alias("_first"))
    refers = known.join(first, "_sha1").where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(
        F.col("page_id").alias("_page"), F.col("_sha1").alias("_hex"), F.col("_first").alias("refers_to")
    )
    marked = rows.join(
        refers.where(F.col("refers_to").isNotNull()),
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha1") == F.col("_hex")),
        "left",
    )
    return marked.select("page_id", "url", "payload", base32(F.col("_sha1")).alias("digest"), "refers_to")


def base32(hex_digest):
    """Upper-case base32 of a 40-digit hexadecimal SHA-1, without padding as 160 bits need none."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 5):  # 20 bits, four digits of base 32
        number = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        parts += [
            F.substring(F.lit(alphabet), F.shiftright(number, s).bitwiseAND(31) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)
        ]
    return F.concat(*parts)


def archive_pages(pages: DataFrame, *, min_bytes: int = 0, zip64: bool = False, payloads: bool = True) -> DataFrame:
    """Pages written as WARC packages and read back, one row per record.

    Columns besides page_id, url and html are ignored. Reruns write new packages.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_packages(mark_revisits(pages, min_bytes=min_bytes), zip64=zip64)
    # Packages to tasks, then ranges to tasks: a large package is read by many.
    ranges = package_ranges(manifest.repartition(n, "path"))
    return read_records(ranges.repartition(n, "path", "start"), payloads=payloads)
