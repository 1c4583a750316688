"""Archives that others wrote: plain and packed in any way, of both versions, with any name; and broken ones."""

import base64
import gzip
import hashlib

import pytest

from tessera.llm import archives

DATE = "20040229235958"
PAGES = [("http://a.com/", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello\n\nhttp://fake 1 2 text/html 9\n"), ("http://b.com/x y".replace(" ", "%20"), b"HTTP/1.0 404 Not Found\r\n\r\n"), ("dns:a.com", DATE.encode() + b"\na.com. 60 IN A 1.2.3.4\n"), ("http://c.com/", b"")]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def written(version, end=b"\n"):
    """(version block, records) by the format's own description."""
    body = b"%d 0 Some Crawler\n" % version + {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version] + b"\n<arcmetadata>\n</arcmetadata>\n"
    more = b"" if version == 1 else b" 200 - - 0 x.arc"
    line = lambda url, kind, n: url + b" 0.0.0.0 " + DATE.encode() + b" " + kind + more + b" %d" % n + end
    block = line(b"filedesc://x.arc", b"text/plain", len(body)) + body + b"\n"
    return block, [line(u.encode(), b"text/html; charset=x y", len(c)) + c + b"\n" for u, c in PAGES]


PACKINGS = {
    "plain.arc": lambda parts: b"".join(parts),
    "one.arc.gz": lambda parts: gzip.compress(b"".join(parts)),
    "each.arc.gz": lambda parts: b"".join(map(gzip.compress, parts)),
    "cut anywhere.gz": lambda parts: b"".join(gzip.compress(b"".join(parts)[k : k + 37]) for k in range(0, len(b"".join(parts)), 37)) + b"\0\0",
}


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("name", PACKINGS)
def test_archives_of_any_packing(spark, tmp_path, version, name):
    block, records = written(version, b"\r\n" if version == 2 else b"\n")
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / name).write_bytes(PACKINGS[name]([block, *records]))
    (folder / "notes.txt").write_text("not an archive")
    archives.convert_arc(spark, str(folder), str(tmp_path / "warc"), names=name)
    found = sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    payloads = [(c.partition(b"\r\n\r\n")[2] if c.startswith(b"HTTP") else c, "response" if c.startswith(b"HTTP") else "resource") for _, c in PAGES]
    assert found == sorted((kind, len(p), digest(p)) for p, kind in payloads)
    rows = archives.read_arc(spark, str(folder), False, name).collect()
    assert sorted((r.uri, r.date, r.kind) for r in rows) == sorted((u, DATE, "text/html; charset=x y") for u, _ in PAGES)
    # identifiers are the same however often an archive is converted
    archives.convert_arc(spark, str(folder), str(tmp_path / "again"), names=name)
    ids = lambda path: {r.record_id for r in archives.read_warc(spark, str(tmp_path / path)).collect()}
    assert ids("warc") == ids("again") and len(ids("warc")) == 4


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_broken_archives_are_refused(pack):
    block, records = written(1)
    whole = block + b"".join(records)
    assert len(list(archives.parse_arc(pack(whole + b"\n\n\0")))) == 4 and list(archives.parse_arc(b"")) == [] == list(archives.parse_arc(pack(block)))
    for data, why in ((whole[: whole.index(b"fake")], "bytes of"), (whole + b"left over", "left over"), (whole + b"some line\n", "no length"), (b"".join(records), "version block"), (block.replace(b"1 0 Some", b"7 0 Some"), "not known"), (block + b"http://a 0\n", "of 5 fields")):
        with pytest.raises(ValueError, match=why):
            list(archives.parse_arc(pack(data)))
    with pytest.raises(ValueError, match="cut off"):
        list(archives.parse_arc(gzip.compress(whole)[:-30]))


def test_other_warc_files(spark, tmp_path):
    payload = b"hello"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    record = lambda kind, block, more=b"": b"WARC/1.0\r\nwarc-type:" + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    data = record(b"warcinfo", b"a: b\r\n\r\n") + record(b"request", b"GET / HTTP/1.1\r\n\r\n") + record(b"response", block) + record(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC-Payload-Digest: sha1:ABC\r\n")
    for name, content in (("a.warc", data), ("b.warc.gz", gzip.compress(data))):
        (tmp_path / name).write_bytes(content)
    got = sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in archives.read_warc(spark, str(tmp_path)).collect())
    assert got == [("response", 5, digest(payload))] * 2 + [("revisit", None, "ABC")] * 2
    with pytest.raises(ValueError, match="begins with"):
        list(archives.parse_warc(data + b"left over\r\n\r\n"))
