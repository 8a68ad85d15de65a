"""WARC archives: a writer of one gzip member per record and a sequential reader.

Writing: payloads are digested first; of equal payloads of ``least`` bytes or more the one with the largest
page_id is a ``response`` and the others are ``revisit`` records that name it and carry no payload. Each task
writes archives of its own, a new one every ``FILE_BYTES`` compressed bytes.

Reading: one task goes through one archive from front to back. Compressed bytes are read in pieces and
inflated in pieces (``zlib.decompressobj``); a record is framed by its header's end, its Content-Length and
the two line ends behind it; block and payload digests are computed on the way and compared with the
header's. A record that breaks a rule is returned with its ``error``; after a damaged member the reader goes
on at the next one. A task holds one piece of the archive, one record and one batch of rows.

Cases: a null html is the empty payload; rows that repeat a page_id with an equal payload are records of
their own, and those with the largest page_id are all responses, since a record doesn't revisit itself; a
null page_id is no leader while another row of that payload has an id; line ends and other control characters
in a url are percent-encoded; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import shared

LEAST_REVISIT = 1000
FILE_BYTES = 128 << 20
PIECE = 1 << 18
MOST_HEADER = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, REFERS_PAGE = "WARC-X-Page-ID", "WARC-X-Refers-To-Page-ID"
_FILES = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([
    ("file", pa.string()), ("place", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])
READ = "file string, place long, record_type string, record_id string, url string, date string, page_id long, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, payload binary, error string"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _hex(labelled: str | None) -> str | None:
    """Lower-case hex of a header's SHA-1, which is base32 or hex; None for other digests."""
    kind, _, value = (labelled or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record, the same wherever it is computed."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def _plain(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields), f"Content-Length: {len(block)}".encode()])
    return b"".join((z.compress(head + b"\r\n\r\n"), z.compress(block), z.compress(b"\r\n\r\n"), z.flush()))


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of ``refers_to``'s response, as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _plain(url))] if url is not None else []
    fields += [(PAGE, str(page_id))] if page_id is not None else []
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), (REFERS_PAGE, str(refers_to))]
    fields += [("WARC-Payload-Digest", _base32(bytes.fromhex(digest))), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response")]
    return member(fields, block)


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (binary), digest, refers_to (null for responses).

    Leaders are a partial aggregate; the join that hands them out has no need of a payload's rows in one place, so AQE may split it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    leaders = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("leader")).filter("leader is not null")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("leader")), F.col("leader"))
    return rows.join(leaders, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in a shared folder: file, records, bytes of each."""
    folder = folder or shared.new_folder(pages.sparkSession, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        rows = (r for b in shared.slices(batches, "html") for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            attempt = uuid.uuid4().hex
            name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{attempt}.warc.gz"
            count = size = 0
            with shared.written(name) as out:
                size += out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(attempt)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                while row is not None and size < file_bytes:
                    page_id, url, html, digest, refers_to = row
                    size += out.write(page_record(page_id, url, html, digest, refers_to, date))
                    count += 1
                    row = next(rows, None)
            yield shared.batch_of(_FILES, {"file": [name], "records": [count], "bytes": [size]})

    return shared.staged(shared.in_arrow(roles(pages, least), run, "file string, records long, bytes long"), "warc-files")


class _Damaged(Exception):
    """A record or member that breaks the format."""


class _Members:
    """Inflated bytes of one gzip member after the other, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.ahead = stream, b"", 0  # ahead: bytes taken from the stream
        self.z, self.out, self.start = None, bytearray(), 0

    def _fill(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            self.ahead += len(self.raw)
        return bool(self.raw)

    def open(self) -> bool:
        """Go to the next member; False at the archive's end."""
        self.out.clear()
        if not self._fill():
            return False
        self.start, self.z = self.ahead - len(self.raw), zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Inflate a further piece; False at the member's end."""
        if self.z.eof:
            return False
        if not self._fill():
            raise _Damaged("the archive ends within a record")
        try:
            piece = self.z.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise _Damaged(f"member can't be inflated: {e}") from None
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.out += piece
        return bool(piece) or not self.z.eof

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to and with the mark."""
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if seen > most or not self.more():
                raise _Damaged("a header without an end")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        data = bytes(self.out[:n])
        del self.out[:n]
        return data

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.out and not self.more():
                raise _Damaged("a record shorter than its Content-Length")
            data = self.take(n)
            n -= len(data)
            yield data

    def at_end(self) -> bool:
        """Whether the member has no bytes left; its check sum has been compared then."""
        while not self.out:
            if not self.more():
                return True
        return False

    def skip(self) -> None:
        """Behind a damaged member: to its end if it can be inflated, else to the next that begins like one."""
        try:
            while self.more():
                self.out.clear()
        except _Damaged:
            while True:
                # not the damaged member again
                at = self.raw.find(b"\x1f\x8b\x08", self.ahead - len(self.raw) == self.start)
                if at >= 0:
                    self.raw = self.raw[at:]
                    return
                self.raw = self.raw[-2:]
                piece = self.stream.read(PIECE)
                if not piece:
                    self.raw = b""
                    return
                self.ahead += len(piece)
                self.raw += piece


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise _Damaged("no record begins here")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise _Damaged("a header line without a colon")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name.lower())
    return int(value) if value is not None and value.lstrip("-").isdigit() else None


def records(stream, payloads: bool = True) -> Iterator[dict]:
    """Records of an open archive in order, as rows of ``READ`` without the file."""
    source = _Members(stream)
    while source.open():
        fields: dict[str, str] = {}
        try:
            while not source.at_end():
                fields = {}
                fields = _fields(source.until(b"\r\n\r\n", MOST_HEADER))
                yield _record(source, fields, payloads)
        except _Damaged as e:
            yield {"place": source.start, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "page_id": _number(fields, PAGE), "error": str(e)}
            source.skip()


def _record(source: _Members, fields: dict[str, str], payloads: bool) -> dict:
    """The record whose header was read; its block is framed, digested and compared."""
    length, kind, http = _number(fields, "Content-Length"), fields.get("warc-type"), "application/http" in fields.get("content-type", "")
    if length is None or length < 0:
        raise _Damaged("no Content-Length")
    block, own, head, body, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
    in_head = http
    for piece in source.exactly(length):
        block.update(piece)
        if in_head:
            head += piece
            at = head.find(b"\r\n\r\n")
            if at < 0:
                continue
            head, piece, in_head = head[: at + 2], head[at + 4 :], False
        own.update(piece)
        size += len(piece)
        if payloads and kind != "revisit":
            body.append(piece)
    if b"".join(source.exactly(4)) != b"\r\n\r\n":
        raise _Damaged("no line ends behind the block")
    given, error = _hex(fields.get("warc-payload-digest")), None
    if (said := _hex(fields.get("warc-block-digest"))) and said != block.hexdigest():
        error = "block digest"
    elif kind != "revisit" and given and given != own.hexdigest():
        error = "payload digest"
    if kind == "revisit":  # the payload stands in the record it refers to; the HTTP header tells its length
        said = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(said[0]) if said and said[0].strip().isdigit() else None
    return {
        "place": source.start, "record_type": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "page_id": _number(fields, PAGE), "refers_to": _number(fields, REFERS_PAGE),
        "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": given if kind == "revisit" else own.hexdigest(), "payload": b"".join(body) if payloads and kind != "revisit" else None, "error": error,
    }


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of archives (``files``: file) as rows of ``READ``; one task reads an archive."""

    def run(batches):
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, size = [], 0
                with shared.opened(file) as stream:
                    for r in records(stream, payloads):
                        rows.append({"file": file, **r})
                        size += 500 + len(r.get("payload") or b"")
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return shared.in_arrow(files.select("file").repartition(max(1, min(10_000, files.count()))), run, READ)


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, error of the responses and revisits, and of records that can't be told."""
    kept = found.filter("record_type in ('response', 'revisit') or error is not null")
    return kept.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")


def resolved(found: DataFrame) -> DataFrame:
    """Responses and revisits with whole payloads: a revisit has that of the record it refers to, ``error`` where there is none."""
    own = found.filter("record_type = 'response'")
    full = own.filter("record_id is not null").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max(F.struct("payload_digest", "payload")).alias("x"))
    back = found.filter("record_type = 'revisit'").join(full, "refers_to_id", "left")
    same = F.col("x.payload_digest") == F.col("payload_digest")
    wrong = F.when(F.col("x").isNull(), "refers to no record").when(~same, "refers to another payload")
    columns = found.columns
    return own.unionByName(back.withColumn("payload", F.when(same, F.col("x.payload"))).withColumn("error", F.coalesce("error", wrong)).select(*columns))
