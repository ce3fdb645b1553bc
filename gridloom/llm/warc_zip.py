"""WARC records in ZIP-packaged archives: written by Spark, and read back by byte ranges.

An archive holds stored members only: ``archive/N.warc.gz``, of one gzip member a record, each
beside ``indexes/N.cdxj``, which has the place of each of its records. A reader takes the central
directory (ZIP or ZIP64) from a file's end, finds these members there, and reads the index and
the records by their ranges, so nothing is extracted and a lookup reads a few ranges only.

Archives are written as pieces of bytes through Spark's own text writer, so tasks commit and retry
as for any table and any store will do. It ends each piece with a separator, which is made the
value of a private extra field in the next member's local header, or the comment at the very end;
the files are plain ZIP.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a
response and the others revisit it, without their payload. Two longs and a digest a page decide
that. Payloads are written out once, and shuffle only if the pages that revisit are too many to
broadcast (Spark checks their size), by a key that is unique.

Edge cases: a null payload is empty; a null page_id comes after all others, so such a page is
refered to only by others of its kind, with null; repeated page_ids are records of their own, of
which one is the response; a null url is the record's own name, and control characters and spaces
in one are escaped; other columns are not read; an empty table writes files without records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ranges import open_ranges, read_at
from .common import map_batches, materialize, scratch_dir, spread_lookup

# Signatures and layouts of ZIP, and the profile of a revisit.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL_HEAD, _CENTRAL_HEAD = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII")
_END_HEAD, _END64_HEAD, _LOCATOR_HEAD = struct.Struct("<IHHHHIIH"), struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ends every piece: the value of this private extra field of a local header, or the last comment.
SEPARATOR, _OWN_FIELD = b"\r\n\r\n", 0x6C67
#: Compressed bytes after which a member is closed, and bytes read at a time.
MEMBER_BYTES, READ_BYTES = 8 << 20, 4 << 20
_FULL, _NULL = 0xFFFFFFFF, 1 << 127

RECORD_SCHEMA = "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


# --- records ---------------------------------------------------------------------------------


def record_name(page: int | None, row: int) -> str:
    """A record's identifier: its row and its page in 32 hexadecimal digits, by which it's found again."""
    digits = f"{(_NULL if page is None else 0) | row << 64 | (page or 0) & ((1 << 64) - 1):032x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def page_of(name: str) -> int | None:
    number = int(name.strip("<>").rpartition(":")[2].replace("-", ""), 16)
    low = number & ((1 << 64) - 1)
    return None if number & _NULL else low - ((low >> 63) << 64)


def target_of(url: str) -> str:
    """``url`` as a field holds it: control characters and spaces are escaped."""
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(name: str, target: str, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record ``refers``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers}"]
    body = head if refers else head + payload
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode() + SEPARATOR + body + SEPARATOR


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's fields, those of its HTTP head, and the payload that it holds."""
    top, _, rest = data.partition(SEPARATOR)
    fields = _fields(top)
    block = rest[: int(fields["content-length"])]
    head, _, payload = block.partition(SEPARATOR)
    return fields, _fields(head), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


# --- writing ---------------------------------------------------------------------------------


class ZipPieces:
    """Bytes of a ZIP of stored members, in pieces that each end where the separator belongs."""

    def __init__(self, zip64: bool = False):
        self.zip64, self.at, self.held = zip64, 0, b""
        self.central: list[tuple[bytes, int, int, int]] = []

    def add(self, name: str, data: bytes) -> bytes:
        """The piece up to a member's data, which is held until the next call."""
        label, crc = name.encode(), zlib.crc32(data)
        offset = self.at + len(self.held)
        head = _LOCAL_HEAD.pack(_LOCAL, 20, 0, 0, 0, 33, crc, len(data), len(data), len(label), 8) + label + struct.pack("<HH", _OWN_FIELD, 4)
        self.central.append((label, crc, len(data), offset))
        piece, self.held = self.held + head, data
        self.at += len(piece) + len(SEPARATOR)
        return piece

    def close(self) -> bytes:
        """The last member's data, the central directory and the end."""
        start, entries = self.at + len(self.held), []
        for label, crc, size, offset in self.central:
            wide = self.zip64 or offset >= _FULL
            extra = struct.pack("<HHQ", 1, 8, offset) if wide else b""
            entries.append(_CENTRAL_HEAD.pack(_CENTRAL, 45, 45 if wide else 20, 0, 0, 0, 33, crc, size, size, len(label), len(extra), 0, 0, 0, 0, _FULL if wide else offset) + label + extra)
        directory, n = b"".join(entries), len(entries)
        wide = self.zip64 or n >= 0xFFFF or start >= _FULL or len(directory) >= _FULL
        end = b""
        if wide:
            end = _END64_HEAD.pack(_END64, 44, 45, 45, 0, 0, n, n, len(directory), start) + _LOCATOR_HEAD.pack(_LOCATOR, 0, start + len(directory), 1)
        count, size, at = (0xFFFF, _FULL, _FULL) if wide else (n, len(directory), start)
        return self.held + directory + end + _END_HEAD.pack(_END, 0, 0, count, count, size, at, len(SEPARATOR))


def _archive(rows: Iterable[tuple], date: str, member_bytes: int, zip64: bool) -> Iterator[bytes]:
    """The pieces of one archive, from (page_id, row, url, payload, digest and name of what it revisits)."""
    zipped, held, index, size, number = ZipPieces(zip64), [], [], 0, 0

    def closed():
        name = f"{number:06d}"
        yield zipped.add(f"archive/{name}.warc.gz", b"".join(held))
        yield zipped.add(f"indexes/{name}.cdxj", "".join(index).encode())

    for page, row, url, payload, known, refers in rows:
        digest = hashlib.sha256(payload).hexdigest()
        if known is not None and known != digest:
            raise RuntimeError("A row isn't the one that its digest was taken of.")
        name = record_name(page, row)
        target = target_of(url) if url else name.strip("<>")
        packed = gzip.compress(record(name, target, payload, digest, refers, date), 6, mtime=0)
        told = json.dumps({"url": target, "page_id": page, "offset": size, "length": len(packed), "digest": f"sha256:{digest}"})
        index.append(f"{target} {re.sub('[^0-9]', '', date)} {told}\n")
        held.append(packed)
        size += len(packed)
        if size >= member_bytes:
            yield from closed()
            held, index, size, number = [], [], 0, number + 1
    if held:
        yield from closed()
    if zipped.central:
        yield zipped.close()


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, row), written out once, so that a row's number stays its own."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    return materialize(pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row")))


def revisits(rows: DataFrame, least: int = 100) -> DataFrame:
    """(row, digest, first_page, first_row) of the ``numbered`` rows whose payload of ``least`` bytes or more an earlier page_id has.

    Digests are counted by partial aggregation and only those that repeat are looked up, a hot one
    by salts, so no task holds a group.
    """
    keys = materialize(rows.filter(F.octet_length("payload") >= least).select("row", "page_id", F.sha2("payload", 256).alias("digest")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")).alias("first")
    shared = keys.groupBy("digest").agg(F.count("*").alias("n"), first).filter("n > 1").select("digest", "first")
    found = spread_lookup(keys, "digest", shared).filter(F.col("row") != F.col("first.row"))
    return materialize(found.select("row", "digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "2000-01-01T00:00:00Z", member_bytes: int = MEMBER_BYTES, zip64: bool = False) -> str:
    """Writes a record for each row of ``pages`` (page_id, url, html), an archive for each partition."""
    rows = numbered(pages)
    # A table of known size: Spark broadcasts it if it is small, and else both sides shuffle by a key that is unique.
    again = revisits(rows, least).withColumnRenamed("row", "__again")
    joined = rows.join(again, F.col("row") == F.col("__again"), "left").select("page_id", "row", "url", "payload", "digest", "first_page", "first_row")

    def run(batches):
        def told():
            for batch in batches:
                for k in range(batch.num_rows):
                    page, row, url, payload, digest, first, first_row = (c[k].as_py() for c in batch.columns)
                    yield page, row, url, payload, digest, None if first_row is None else record_name(first, first_row)

        for piece in _archive(told(), date, member_bytes, zip64):
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.binary())})

    pieces = map_batches(joined, run, "piece binary")
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return path


# --- reading ---------------------------------------------------------------------------------


def central_directory(file, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, size) of a ZIP's members, ZIP64 or not."""
    tail_at = max(0, size - _END_HEAD.size - 0xFFFF)
    tail = read_at(file, tail_at, size - tail_at)
    at = len(tail) - _END_HEAD.size
    while at >= 0:
        at = tail.rfind(struct.pack("<I", _END), 0, at + 4)
        if at >= 0 and at + _END_HEAD.size + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("not a ZIP file")
    *_, entries, length, start, _ = _END_HEAD.unpack_from(tail, at)
    if 0xFFFF == entries or _FULL in (length, start):
        place = tail_at + at - _LOCATOR_HEAD.size
        locator = read_at(file, place, _LOCATOR_HEAD.size) if place >= 0 else b""
        if locator and _LOCATOR_HEAD.unpack(locator)[0] == _LOCATOR:
            wide = _END64_HEAD.unpack(read_at(file, _LOCATOR_HEAD.unpack(locator)[2], _END64_HEAD.size))
            entries, length, start = wide[7:10]
    data, at, found = read_at(file, start, length), 0, []
    for _ in range(entries):
        _, _, _, flags, method, _, _, _, packed, whole, name, extra, comment, _, _, _, offset = _CENTRAL_HEAD.unpack_from(data, at)
        at += _CENTRAL_HEAD.size
        label, more = data[at : at + name], data[at + name : at + name + extra]
        at += name + extra + comment
        place = 0
        while place + 4 <= len(more):
            kind, n = struct.unpack_from("<HH", more, place)
            if kind == 1:  # ZIP64: only the fields that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", more, place + 4))
                whole = next(wide) if whole == _FULL else whole
                packed = next(wide) if packed == _FULL else packed
                offset = next(wide) if offset == _FULL else offset
            place += 4 + n
        found.append((label.decode("utf-8" if flags & 0x800 else "cp437"), method, offset, packed))
    return found


def data_start(file, offset: int) -> int:
    """Where a member's data lies: the local header has lengths of its own."""
    head = _LOCAL_HEAD.unpack(read_at(file, offset, _LOCAL_HEAD.size))
    if head[0] != _LOCAL:
        raise ValueError("a member's local header is missing")
    return offset + _LOCAL_HEAD.size + head[9] + head[10]


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, offset, size, index_offset, index_size) of the archives' WARC members, whose files are listed by Spark and not read.

    A member's index is the one of its name, or else the archive's only one; without any, the
    index columns are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")

    def run(batches):
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                with open_ranges(path) as file:
                    found = central_directory(file, size)
                    stem = {n.rpartition("/")[2].partition(".")[0]: (m, o, s) for n, m, o, s in found if re.search(r"(^|/)indexes/.*\.cdxj?$", n)}
                    warcs = [x for x in found if re.search(r"\.warc(\.gz)?$", x[0])]
                    rows = []
                    for name, method, offset, length in warcs:
                        index = stem.get(name.rpartition("/")[2].partition(".")[0]) or (next(iter(stem.values())) if len(stem) == len(warcs) == 1 else None)
                        if method or index and index[0]:
                            raise NotImplementedError(f"{name} in {path} is compressed; archives and indexes must be stored.")
                        rows.append((path, name, data_start(file, offset), length, *((data_start(file, index[1]), index[2]) if index else (None, None))))
                names = ["path", "name", "offset", "size", "index_offset", "index_size"]
                types = [pa.string(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names=names)

    return map_batches(files, run, "path string, name string, offset bigint, size bigint, index_offset bigint, index_size bigint")


def index_entries(text: bytes) -> list[dict]:
    """An index's lines as their fields; offset and length are numbers."""
    found = [json.loads(line[line.index(b"{") :]) for line in text.splitlines() if b"{" in line]
    return [e | {"offset": int(e["offset"]), "length": int(e["length"])} for e in found]


def _ranges(file, start: int, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at (offset, length) after ``start``; neighbours are read together."""
    at = 0
    while at < len(places):
        upto, first = at + 1, places[at][0]
        while upto < len(places) and places[upto][0] == sum(places[upto - 1]) and sum(places[upto]) - first <= READ_BYTES:
            upto += 1
        data = read_at(file, start + first, sum(places[upto - 1]) - first)
        for offset, length in places[at:upto]:
            yield data[offset - first : offset - first + length]
        at = upto


def _stream(file, start: int, size: int, packed: bool) -> Iterator[bytes]:
    """A member's bytes in their order, unpacked."""
    unpack, at = zlib.decompressobj(31), 0
    while at < size:
        data = read_at(file, start + at, min(READ_BYTES, size - at))
        at += len(data)
        while packed and data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        if data:
            yield data


def _scanned(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a member that has no index, one after the other."""
    held = bytearray()
    more = True
    while more or held:
        end = held.find(SEPARATOR)
        size = int(_fields(bytes(held[:end]))["content-length"]) if end >= 0 else 0
        if end >= 0 and len(held) >= end + 8 + size:
            yield bytes(held[: end + 8 + size])
            del held[: end + 8 + size]
            continue
        chunk = next(chunks, None)
        if chunk is None:
            if held.strip():
                raise EOFError("A WARC member ends within a record.")
            return
        held += chunk


def _told(data: bytes, payloads: bool) -> tuple:
    fields, http, payload = parse_record(data)
    kind = fields["warc-type"]
    revisit = kind == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    size = int(http.get("content-length", 0)) if revisit else len(payload)
    refers = page_of(fields["warc-refers-to"]) if revisit and "warc-refers-to" in fields else None
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, size, digest, payload if payloads and not revisit else None


def read_records(spark: SparkSession, path: str, payloads: bool = False, urls: list[str] | None = None) -> DataFrame:
    """The response and revisit records of all archives under ``path`` (see RECORD_SCHEMA).

    The digest and size of a response are those of the payload as it was read; a revisit tells
    them itself. Members are dealt to tasks, and a task holds an index and READ_BYTES of records.
    With ``urls`` only these records' ranges are read.
    """
    found = members(spark, path)
    wanted = None if urls is None else set(map(target_of, urls))

    def run(batches):
        for batch in batches:
            for path, name, start, size, index_start, index_size in zip(*(c.to_pylist() for c in batch.columns)):
                with open_ranges(path) as file:
                    if index_start is None:
                        records = _scanned(_stream(file, start, size, name.endswith(".gz")))
                    else:
                        entries = index_entries(read_at(file, index_start, index_size))
                        places = sorted((e["offset"], e["length"]) for e in entries if wanted is None or e.get("url") in wanted)
                        records = (gzip.decompress(d) if d[:2] == b"\x1f\x8b" else d for d in _ranges(file, start, places))
                    rows = []
                    for data in records:
                        if re.search(rb"(?im)^warc-type:\s*(response|revisit)\s*$", data[: data.find(SEPARATOR)]):
                            row = _told(data, payloads)
                            rows += [row] if wanted is None or row[1] in wanted else []
                        if len(rows) >= (16 if payloads else 1024):
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    # A number of partitions of its own: these rows are few and small, but what they stand for isn't.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return map_batches(found.repartition(tasks, "path", "offset"), run, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names=[f.split()[0] for f in RECORD_SCHEMA.split(", ")])


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes ``pages`` to the shared folder as archives and tells what their records hold."""
    spark = pages.sparkSession
    found = read_records(spark, write_archives(pages, scratch_dir(spark), least))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
