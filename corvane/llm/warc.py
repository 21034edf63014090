"""WARC archives packed in ZIP files, written and read back by range reads.

Every archive is one ZIP file of bounded size with two stored (uncompressed)
members: ``archive/data.warc.gz``, one gzip member for every WARC record, and
``indexes/index.tsv``, the place of every record. The reader goes from the end
of central directory (ZIP64 where there is one) to the central directory, from
there to the index, and then reads the byte range of each record on its own;
no member is ever extracted.

The files are written with Spark's own committers, one file for each archive
and all in one folder, so they can be in any store that Spark writes, and a
lost executor leaves no half-written archive behind. Spark's text writer ends
each file with a newline: the ZIP comment, one byte long, accounts for it.
The reader lists names and lengths only; tasks open the files themselves and
seek (``file:`` folders, and stores that pyarrow opens). Where they can't, Spark
hands a task the bytes of one archive at a time.

Ids are written percent-encoded, so any characters may be in them; an id of no
characters and a missing id differ.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, delete_at_end, materialise, scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
ARCHIVE_BYTES = 16 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
MIN_REVISIT = 1000
COMMENT = b"\n"

# Fixed values of the ZIP format: signatures, and the marker of a value kept in a ZIP64 field.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
END64, LOCATOR64 = 0x06064B50, 0x07064B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header_at: int
    crc: int


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


# --- ZIP -------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, bytes]], comment: bytes = b"", zip64: bool = False) -> bytes:
    """A ZIP file with stored members. ``zip64`` forces the 64-bit fields that large archives need."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        wide = zip64 or len(data) >= MAX32 or at >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = MAX32 if wide else len(data)
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x0800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x0800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, MAX32 if wide else at)
        central += raw + extra
    at, n = len(out), len(members)
    out += central
    wide = zip64 or n >= MAX16 or at + len(central) >= MAX32
    if wide:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<IIQI", LOCATOR64, 0, end, 1)
    count, size, start = (MAX16, MAX32, MAX32) if wide else (n, len(central), at)
    return bytes(out) + struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, len(comment)) + comment


class ZipRanges:
    """Directory of a ZIP file of which only byte ranges are ever read.

    ``read_at(offset, length)`` gives those bytes of the file.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at, self.size, self.close = read_at, size, lambda: None
        tail_at = max(0, size - MAX16 - 22)
        tail = bytes(read_at(tail_at, size - tail_at))
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == count or MAX32 in (length, start):
            sign, _, end64 = struct.unpack("<IIQ", bytes(read_at(tail_at + at - 20, 16)))
            if sign != LOCATOR64:
                raise ValueError("not a ZIP file: no ZIP64 locator")
            sign, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", bytes(read_at(end64, 56)))
            if sign != END64:
                raise ValueError("not a ZIP file: no ZIP64 end of central directory")
        self.members: dict[str, Member] = {}
        raw, at = bytes(read_at(start, length)), 0
        for _ in range(count):
            sign, _, _, _, method, _, _, crc, stored, size, n, e, c, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
            if sign != CENTRAL:
                raise ValueError("not a ZIP file: broken central directory")
            name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + e]
            size, stored, header = self._wide(extra, size, stored, header)
            self.members[name] = Member(name, method, size, stored, header, crc)
            at += 46 + n + e + c

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """``values`` with those that don't fit 32 bits taken from the ZIP64 field."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                out = [next(wide) if v == MAX32 else v for v in values]
            at += 4 + n
        return out

    def start(self, name: str) -> int:
        """Where the data of a stored member begin."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        sign, *_, n, e = struct.unpack("<IHHHHHIIIHH", bytes(self.read_at(m.header_at, 30)))
        if sign != LOCAL:
            raise ValueError(f"{name} has no local header")
        return m.header_at + 30 + n + e

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"range outside {name}")
        return bytes(self.read_at(self.start(name) + offset, length))


def open_ranges(path: str) -> ZipRanges:
    """A ZIP file, by seek and read: a path, a ``file:`` address, or an address of a store that pyarrow opens."""
    if "://" in path and not path.startswith("file:"):
        store, name = pafs.FileSystem.from_uri(path)
        f = store.open_input_file(name)
        size = f.size()
    else:
        f = open(path.removeprefix("file:"), "rb")  # noqa: SIM115
        size = f.seek(0, 2)

    def read_at(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    found = ZipRanges(read_at, size)
    found.close = f.close
    return found


# --- WARC ------------------------------------------------------------------


def _written(page_id: object) -> str:
    """An id as it is written: percent-encoded after an equals sign; nothing at all for a missing id."""
    return "" if page_id is None else "=" + urllib.parse.quote(str(page_id), safe="")


def _read(written: str) -> str | None:
    return urllib.parse.unquote(written[1:]) if written else None


def _urn(page_id: object) -> str:
    return f"<urn:corvane:page:{_written(page_id)}>"


def _id_of(urn: str | None) -> str | None:
    return _read(urn[len("<urn:corvane:page:") : -1]) if urn else None


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(raw: bytes) -> Record:
    """The record in one gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


def archive_bytes(records: list[tuple[object, bytes]]) -> bytes:
    """A ZIP archive of records, which are given with their ids."""
    data, index = bytearray(), []
    for page_id, raw in records:
        index.append(f"{_written(page_id)}\t{len(data)}\t{len(raw)}")
        data += raw
    return zip_bytes([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())], COMMENT)


def archive_records(z: ZipRanges) -> Iterator[Record]:
    """All records of an archive, each by its own range read."""
    index = z.range(INDEX, 0, z.members[INDEX].size).decode()
    for line in index.split("\n") if index else []:
        _, offset, length = line.split("\t")
        yield parse_record(z.range(DATA, int(offset), int(length)))


# --- Spark -----------------------------------------------------------------


def revisits(pages: DataFrame) -> DataFrame:
    """page_id (string), url, payload, digest, refers_to (string).

    Only digests are aggregated (combined before the shuffle); of payloads that
    occur once nothing is kept. The winners are broadcast if their number,
    checked here, allows it, and no page is shuffled then. Beyond that pages are
    dealt by digest and salt, short ones (which refer to nothing) by their id,
    so neither a payload of a third of all rows nor an empty one meets in a task.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= MIN_REVISIT
    first = base.where(long).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner")
    first = materialise(first, "winners")
    if first.count() <= BROADCAST_ROWS:
        keyed = base.join(F.broadcast(first.select(F.col("digest").alias("of"), "winner")), long & (F.col("digest") == F.col("of")), "left")
    else:
        salted = first.select(F.col("digest").alias("of"), "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
        spread = F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))
        dealt = base.withColumns({"of_digest": F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), spread)), "salt": F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")})
        keyed = dealt.join(salted.hint("merge"), (F.col("of_digest") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    same = F.col("page_id").eqNullSafe(F.col("winner"))
    return keyed.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "payload", "digest", F.when(~same, F.col("winner")).cast("string").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes_max: int = ARCHIVE_BYTES) -> None:
    """Write one WARC record for every row of ``pages`` to ZIP archives in the folder ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive_bytes(held)], pa.binary())], ["content"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record_bytes(page_id, url, payload, digest, refers_to)
                if held and size + len(raw) > archive_bytes_max:
                    yield out()
                    held, size = [], 0
                held.append((page_id, raw))
                size += len(raw)
        if held:
            yield out()

    packed = revisits(pages).mapInArrow(pack, "content binary")
    packed.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _seekable(path: str) -> bool:
    """Whether tasks can open files of this folder themselves."""
    if path.startswith("file:"):
        return True
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def read_archives(pages: DataFrame, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of all records in the folder ``path``.

    ``pages`` gives the type of the ids. The payload of every response is
    checked against its recorded length and digest.
    """
    spark = pages.sparkSession
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows_of(archive: ZipRanges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for r in archive_records(archive):
            kind_of, digest = r.headers["WARC-Type"], r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
            n = int(r.http["Content-Length"])
            if kind_of == "response" and (len(r.payload) != n or hashlib.sha1(r.payload).hexdigest() != digest):
                raise ValueError(f"damaged record {r.headers['WARC-Record-ID']}")
            rows.append((_id_of(r.headers["WARC-Record-ID"]), r.headers.get("WARC-Target-URI"), n, digest, kind_of, _id_of(r.headers.get("WARC-Refers-To"))))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                archive = open_ranges(name)
                yield from rows_of(archive)
                archive.close()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                yield from rows_of(ZipRanges(lambda at, n, v=view: v[at : at + n], len(view)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    local = _seekable(path)
    found = files.select("path" if local else "content").mapInArrow(seek if local else slices, schema)
    kind = pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to archives (below the shared folder unless ``path`` is given) and read them back.

    Of equal payloads of at least 1000 bytes the largest page_id is the
    response and the others revisit it; repeated rows with that id are all
    responses. A null html is an empty payload. A row without page_id revisits
    like any other; if no row of its group has an id, all are responses. Ids
    keep their type and every character. An empty table gives no rows. Other
    columns are not read.
    """
    own = path is None
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    if own:
        delete_at_end(pages.sparkSession, path)
    return read_archives(pages, path if ":" in path.split("/")[0] else f"file:{path}")
