"""Web archives: writing and reading the legacy ARC format, its conversion to WARC, and reading WARC.

Archives are read as streams: a header line (of WARC a header block), then as many bytes as it declares, then the next one, wherever gzip members begin and end in it. So a
file may be plain, packed as one member, or packed record by record; files may have any name. What is cut off, or is left over after the last record, is an error.

An archive of this package's own is written as one file of gzip members, a member for each record, by Spark's text writer, which takes the bytes as
they are; the zero byte that it puts after an archive is padding that gzip readers skip. So archives live wherever Spark
can write, and are read back as binary files.

ARC: a file opens with a version block, whose second line names the version and whose third line names the fields of the
header lines that follow; version 1 and version 2 differ in those fields. A record is its header line, then as many bytes
as the line's last field declares. A record whose content is an HTTP response becomes a ``response``, or a ``revisit`` of one; any other (as ``dns:``)
becomes a ``resource`` with the whole content as its block and its own content type, and is never a revisit.

Defined cases: a null payload is empty; a null or empty URL is written as ``unknown:``; blanks and control characters in a URL are
percent-encoded, as they would end a header field; rows with equal ids stay separate records; of these the later one in
archive order, by archive and then by offset, counts as larger; a null id stays null and counts as smallest; an archive without records gives no rows;
columns besides the id, the URL and the payload are left alone."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import delete, map_arrow, materialise, shared_path, ship

#: Compressed bytes after which a new archive begins; a longer record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
#: The gzip level of members.
LEVEL = 4
#: Bytes of payload after which a batch of parsed records is passed on.
BATCH_BYTES = 4 << 20
#: The namespace of record identifiers.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")

#: The field that holds the length of a revisit's payload.
PAYLOAD_LENGTH = "WARC-X-Payload-Length"

# The header fields of the two versions of the ARC format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def digest(data: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Bytes that are unpacked at once.
PIECE = 1 << 16


def pieces(data: bytes) -> Iterator[bytes]:
    """The bytes of a file, unpacked if they are gzip members; zero bytes between and after members are skipped."""
    view, at = memoryview(data), 0
    while at < len(view) and view[at] == 0:
        at += 1
    if bytes(view[at : at + 2]) != b"\x1f\x8b":
        for a in range(at, len(view), PIECE):
            yield bytes(view[a : a + PIECE])
        return
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        unpacker, begin = zlib.decompressobj(31), at
        while not unpacker.eof:
            chunk = view[at : at + (1 << 15)]
            if not len(chunk):
                raise ValueError(f"the member at {begin} is cut off")
            yield unpacker.decompress(chunk)
            at += len(chunk)
        at -= len(unpacker.unused_data)


class Stream:
    """An unpacked archive, read step by step. ``offset`` is the place in it."""

    def __init__(self, data: bytes):
        self.left, self.held, self.at, self.offset = pieces(data), bytearray(), 0, 0

    def _more(self) -> bool:
        piece = next(self.left, None)
        if piece is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += piece
        return True

    def skip(self, unwanted: bytes) -> bool:
        """Step over these bytes; whether others follow."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in unwanted:
                self.at += 1
                self.offset += 1
            if self.at < len(self.held):
                return True
            if not self._more():
                return False

    def until(self, end: bytes) -> bytes:
        """The bytes before the next ``end``, which is stepped over."""
        scanned = 0
        while (found := self.held.find(end, self.at + scanned)) < 0:
            scanned = max(0, len(self.held) - self.at - len(end) + 1)
            if not self._more():
                raise ValueError(f"the header at {self.offset} is cut off, or bytes are left over")
        out = bytes(self.held[self.at : found])
        self.offset += found + len(end) - self.at
        self.at = found + len(end)
        return out

    def take(self, n: int) -> bytes:
        begin = self.offset
        while len(self.held) - self.at < n:
            if not self._more():
                raise ValueError(f"the record at {begin} has {len(self.held) - self.at} bytes of {n}")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        self.offset += n
        return out


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[x] for x in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(name: str, version: int, date: str, offset: int, url: str | None, content: bytes) -> bytes:
    values = {"URL": _url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": digest(content), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return " ".join(values[x] for x in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, content) of the records of an archive, by its header lines and declared lengths; the version block sets the fields."""
    stream, fields = Stream(data), None
    while stream.skip(b"\r\n\0"):
        offset = stream.offset
        line = stream.until(b"\n").rstrip(b"\r").decode("utf-8", "replace")
        values = line.split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"the line at {offset} of the archive declares no length: {line[:80]!r}")
        content = stream.take(int(values[-1]))
        if line.startswith("filedesc://"):
            about = content.decode("utf-8", "replace").splitlines()
            version = int(about[0].split(" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = about[1].split(" ") if len(about) > 1 and about[1] else ARC_FIELDS[version]
            continue
        if fields is None:
            raise ValueError("an ARC file begins with a version block")
        # the type may hold blanks, so fields are taken from both ends around it
        kind = fields.index("Content-type")
        tail = len(fields) - kind - 1
        if len(values) < len(fields):
            raise ValueError(f"the line at {offset} of the archive has {len(values)} of {len(fields)} fields")
        header = dict(zip(fields[:kind], values[:kind], strict=True)) | dict(zip(fields[kind + 1 :], values[len(values) - tail :], strict=True))
        header["Content-type"] = " ".join(values[kind : len(values) - tail])
        yield offset, header, content


def _packed(records: Iterator[bytes], opening) -> Iterator[pa.RecordBatch]:
    """Archives of the records; opening(name) gives the first member."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    for make in records:
        if not held:
            name = f"{uuid.uuid4().hex}"
            held, size = [_member(opening(name))], 0
            size = len(held[0])
        packed = _member(make(name, size))
        held.append(packed)
        size += len(packed)
        if size >= ARCHIVE_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _write(archives: DataFrame, path: str) -> None:
    """One file for each row of the binary column ``archive``."""
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _read(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A record for each row. The archived response has a header with the id and the length, then the payload."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator:
            for batch in batches:
                for page, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    payload = payload or b""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    yield lambda name, size, url=url, content=head + payload: arc_record(name, version, date, size, url, content)

        yield from _packed(records(), lambda name: arc_version_block(f"{name}.arc.gz", version, date))

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"))
    _write(rows.transform(map_arrow, run, "archive binary"), path)


def is_http(uri: str, content: bytes) -> bool:
    return content.startswith(b"HTTP/") and not re.match(r"(?i)(dns|filedesc|ftp|whois):", uri)


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header as it is, its fields by lower-case name, payload) of an archived response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.decode("utf-8", "replace").split(": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    return head + gap, {k.lower(): v for k, v in fields.items()}, payload


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_arc(spark: SparkSession, path: str, whole: bool, names: str = "*") -> DataFrame:
    """(record, archive, offset, page_id, uri, ip, date, kind, http, payload_digest, payload_bytes, content) of each record of the files under a path whose names fit; record is the
    place, archive and offset in it when unpacked; kind is the content type; http whether it is a response, whose payload then follows its header, else all of it is
    payload; content is packed, and there if ``whole``, else null."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "archive", "offset", "page_id", "uri", "ip", "date", "kind", "http", "payload_digest", "payload_bytes", "content"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        pack = zstandard.ZstdCompressor(level=1).compress
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                place, data = batch.column(0)[i].as_py().rsplit("/", 1)[-1], batch.column(1)[i].as_py()
                for offset, header, content in parse_arc(data):
                    http = is_http(header["URL"], content)
                    _, fields, payload = _http(content) if http else (b"", {}, content)
                    rows.append((f"{place}#{offset}", place, offset, _number(fields.get("x-page-id")), header["URL"], header["IP-address"], header["Archive-date"], header["Content-type"], http, digest(payload), len(payload), pack(content) if whole else None))
                    held += len(rows[-1][-1]) if whole else 0
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return _read(spark, path, names).transform(map_arrow, run, "record string, archive string, offset long, page_id long, uri string, ip string, date string, kind string, http boolean, payload_digest string, payload_bytes long, content binary")


def record_id(record: str) -> str:
    """The identifier that a record of this place has, however often it is made."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, record)}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields by lower-case name, with the version as ``version``, and the block of each record, by declared lengths."""
    stream = Stream(data)
    while stream.skip(b"\r\n\0"):
        first, *lines = stream.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"a record begins with {first[:40]!r}")
        fields = {"version": first} | {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
        yield fields, stream.take(int(fields["content-length"]))


def warc_date(date: str) -> str:
    """20240131235959 as 2024-01-31T23:59:59Z; shorter legacy dates are filled up."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def convert_arc(spark: SparkSession, arc: str, path: str, least_bytes: int = 0, names: str = "*") -> None:
    """Write the ARC archives under ``arc`` whose names fit as WARC. Of records with equal payloads of at least ``least_bytes`` bytes the one
    with the largest id becomes the response, the others revisit records that refer to it."""
    ship(spark)
    seen = read_arc(spark, arc, False, names).where("http").select("record", "archive", "offset", "page_id", "uri", "payload_digest", "payload_bytes")
    seen = materialise(seen.where(F.col("payload_bytes") >= least_bytes), "seen")
    last = seen.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "archive", "offset", "record", "uri")).alias("last"), F.count("*").alias("n")).where("n > 1")
    refers = seen.join(last, ["payload_digest", "payload_bytes"]).where(F.col("record") != F.col("last.record")).select("archive", "offset", F.col("last.record").alias("to_record"), F.col("last.uri").alias("to_uri"))
    # what an archive's revisits refer to goes to the archive, so files meet it as they are and records stay where they are unpacked
    refers = refers.groupBy("archive").agg(F.collect_list(F.struct("offset", "to_record", "to_uri")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator:
            for batch in batches:
                for i in range(batch.num_rows):
                    place, data, known = (batch.column(k)[i].as_py() for k in range(3))
                    to = {r["offset"]: (r["to_record"], r["to_uri"]) for r in known or []}
                    for offset, header, content in parse_arc(data):
                        http = is_http(header["URL"], content)
                        head, _, payload = _http(content) if http else (b"", {}, content)
                        fields = {"WARC-Record-ID": record_id(f"{place}#{offset}"), "WARC-Date": warc_date(header["Archive-date"]), "WARC-Target-URI": header["URL"], "WARC-IP-Address": header["IP-address"], "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response"}
                        if not http:
                            out = warc_record("resource", fields | {"Content-Type": header["Content-type"]}, content)
                        elif offset not in to:
                            out = warc_record("response", fields, content)
                        else:
                            # the payload is not here, so a field of the record's own says how long it was
                            fields |= {PAYLOAD_LENGTH: str(len(payload)), "WARC-Refers-To": record_id(to[offset][0]), "WARC-Refers-To-Target-URI": to[offset][1], "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                            out = warc_record("revisit", fields, head)
                        yield lambda name, size, out=out: out

        about = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
        yield from _packed(records(), lambda name: warc_record("warcinfo", {"WARC-Record-ID": record_id(name), "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Filename": f"{name}.warc.gz", "Content-Type": "application/warc-fields"}, about))

    files = _read(spark, arc, names).select(F.substring_index("path", "/", -1).alias("archive"), "content").join(refers.hint("shuffle_hash"), "archive", "left")
    _write(files.select("archive", "content", "refers").transform(map_arrow, run, "archive binary"), path)


def read_warc(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(record_id, page_id, record_type, refers_to_id, payload_bytes, payload_digest) of each response, revisit and resource. Lengths and
    digests are those of the bytes read, which must equal the declared digest if there is one; a revisit's are declared, and null where they are not."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block in parse_warc(batch.column(1)[i].as_py()):
                    if (kind := fields["warc-type"]) not in ("response", "revisit", "resource"):
                        continue
                    _, http, payload = (b"", {}, block) if kind == "resource" else _http(block)
                    declared = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    if kind != "revisit":
                        found = digest(payload)
                        if declared not in (None, found):
                            raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                        declared = found
                    size = _number(fields.get(PAYLOAD_LENGTH.lower())) if kind == "revisit" else len(payload)
                    rows.append((fields["warc-record-id"], _number(http.get("x-page-id")), kind, fields.get("warc-refers-to"), size, declared))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["record_id", "page_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"])

    return _read(spark, path, names).transform(map_arrow, run, "record_id string, page_id long, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def pages_through_archives(pages: DataFrame, least_bytes: int = 0, version: int = 1) -> DataFrame:
    """Write ``pages`` as ARC, convert the archives to WARC, and return what these hold, a row for each page."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, version)
    convert_arc(spark, arc, warc, least_bytes)
    delete(spark, arc)  # the WARC files are written
    found = materialise(read_warc(spark, warc), "warc-index")
    # most records refer to none, and would all meet under a null
    targets = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    joined = found.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found.where("refers_to_id is not null").join(targets, "refers_to_id", "left"))
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
