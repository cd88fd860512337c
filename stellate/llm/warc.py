"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

Writer. Each page becomes a record, a gzip member of its own, made where the page is read. Of equal payloads of MIN_PAYLOAD
bytes or more the page of the least id is a response, the others are revisits that name it. Members are written by Spark's
text sink, whose separator is one zero byte: a member's last byte, the highest of the length of less than 16 MB, is zero and
left to the sink, so that files are plain concatenated members on any file system that Spark writes, with its commits.
Longer records take several members.

Reader. The bytes of an archive come in chunks (sources.raw), by as many tasks as there are splits, and are dealt by file; a
task holds one record and a chunk at a time, whatever the size of the archive. Every record is checked: the member by its
own checksum, header and lengths, the block by its digest. After a failed check the reader looks for the next member or
version line at which a whole valid record begins and goes on there; the bytes between are a row of kind `gap`.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes, cut, tidy, written
from stellate.sources.raw import chunks

MIN_PAYLOAD = 100
SMALL, SALTS = 100_000, 16  # groups of equal payloads that are broadcast at most; parts of a group beyond
MEMBER, LEVEL = 8 << 20, 5
MAX_RECORD, MAX_HEADER = 1 << 30, 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_PIECE = 16 << 10


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes, with its length and the digest of its block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, or several where the data is long; the last byte is zero."""
    out = []
    for i in range(0, max(len(data), 1), MEMBER):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.append(z.compress(data[i : i + MEMBER]) + z.flush())
    return b"".join(out)


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: int | None, tie: int, url: str | None, html: str, digest: str, first: tuple | None, date: str) -> bytes:
    """The record of a page; first: (page id, tie) of the page that it repeats."""
    payload = html.encode()
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, tie)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http if first else http + payload)


def record_id(page_id: int | None, tie: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{tie}>"


def _firsts(src: DataFrame) -> DataFrame:
    """(digest, first): of each payload that several pages have, the least page id (nulls last), how many of these pages
    have it, and the first of them."""
    one = src.filter(F.col("size") >= MIN_PAYLOAD).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("tie"))
    every = one.groupBy("digest").agg(F.sum("n").alias("all"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n", "tie")).alias("first"))
    return cut(every.filter(F.col("all") > 1).select("digest", "first"))


def with_firsts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, tie, url, html, digest, size, first): first is null for a response."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).select("*", F.monotonically_increasing_id().alias("tie"), F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    firsts = _firsts(src)
    if not firsts.filter("first.n > 1").isEmpty():  # pages that share an id and a payload are told apart by their place in a table that stays
        src = written(src, "pages")[0]
        firsts = _firsts(src)
    if firsts.count() <= SMALL:
        joined = src.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = src.withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    it = F.col("page_id").eqNullSafe(F.col("first.page_id")) & ((F.col("first.n") == 1) | (F.col("first.tie") == F.col("tie")))
    return joined.select("page_id", "tie", "url", "html", "digest", "size", F.when(F.col("first").isNotNull() & ~it & (F.col("size") >= MIN_PAYLOAD), F.struct("first.page_id", "first.tie")).alias("first"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """One record for each row of `pages` in archives at `path`, each of which begins with a warcinfo record.

    A null html is an empty payload. A null url gives a record without a target; line ends in a url are percent-encoded. A
    null id comes last where the least is sought. Rows with an equal id and payload are one response and revisits of it; payloads
    of under MIN_PAYLOAD bytes are responses all. An empty table gives no archives with records. Other columns aren't read.
    """
    rows = with_firsts(pages, id_col, url_col, html_col)

    def run(batches):
        begun = False
        for b in by_bytes(batches, "html"):
            out = []
            for page_id, tie, url, html, digest, first in zip(*(b[c].to_pylist() for c in ("page_id", "tie", "url", "html", "digest", "first")), strict=True):
                if not begun:
                    out.append(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:info:{tie}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    begun = True
                out.append(member(page_record(page_id, tie, url, html, digest, first and (first["page_id"], first["tie"]), date)))
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in out], pa.binary())], ["member"])

    with tidy(pages.sparkSession):
        members = bounded_batches(rows).mapInArrow(run, "member binary")
        members.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


class Damaged(ValueError):
    """A check failed."""


class _More(Exception):
    """The record goes on beyond the bytes that are here."""


def _head(data, at: int = 0) -> tuple[int, dict[str, str]] | None:
    """(end of the header, its fields), None if it doesn't end here."""
    end = data.find(b"\r\n\r\n", at, at + MAX_HEADER)
    if end < 0:
        if len(data) - at >= MAX_HEADER:
            raise Damaged("header")
        return None
    lines = bytes(data[at:end]).split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d\.\d", lines[0]):
        raise Damaged("version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return end + 4, fields


def _length(fields: dict[str, str], limit: int) -> int:
    text = fields.get("content-length", "")
    if not text.isascii() or not text.isdigit() or int(text) > limit:
        raise Damaged("length")
    return int(text)


def _digest_holds(stated: str | None, block: bytes) -> bool:
    """Digests of other kinds than SHA-256 and SHA-1 are not checked."""
    kind, _, value = (stated or "").partition(":")
    make = {"sha256": sha256, "sha-256": sha256, "sha1": sha1, "sha-1": sha1}.get(kind.lower())
    if make is None:
        return True
    d = make(block)
    return value.lower() == d.hexdigest() or value.upper() == base64.b32encode(d.digest()).decode()


def checked(data: bytes, limit: int) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a whole record."""
    head = _head(data)
    if head is None:
        raise Damaged("header")
    at, fields = head
    n = _length(fields, limit)
    if len(data) != at + n + 4 or data[-4:] != b"\r\n\r\n":
        raise Damaged("length")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("fields")
    block = data[at : at + n]
    if not _digest_holds(fields.get("warc-block-digest"), block):
        raise Damaged("digest")
    return fields, block


class Salvage:
    """Takes an archive's bytes piece by piece and gives its records and gaps."""

    def __init__(self, limit: int = MAX_RECORD):
        self.limit, self.buf, self.base, self.at, self.wait = limit, b"", 0, 0, 0
        self.bad: tuple[int, str] | None = None

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple]:
        """(offset, length, None, fields, block) or (offset, length, reason, None, None)"""
        self.buf = self.buf[self.at :] + data
        self.base, self.at = self.base + self.at, 0
        if len(self.buf) < self.wait and not last:
            return
        self.wait = 0
        while self.at < len(self.buf):
            try:
                end, fields, block = self._record(self.at, last)
            except _More:
                self.wait = 2 * (len(self.buf) - self.at)  # what was tried is tried again only when as much has come
                break
            except Damaged as e:
                if self.bad is None:
                    self.bad = self.base + self.at, str(e)
                m = _START.search(self.buf, self.at + 1)
                self.at = m.start() if m else len(self.buf) if last else max(self.at + 1, len(self.buf) - 9)
                continue
            if self.bad:
                yield self._gap(self.base + self.at)
            yield self.base + self.at, end - self.at, None, fields, block
            self.at = end
        if last and self.bad:
            yield self._gap(self.base + len(self.buf))

    def _gap(self, end: int) -> tuple:
        start, reason = self.bad
        self.bad = None
        return start, end - start, reason, None, None

    def _record(self, at: int, last: bool) -> tuple[int, dict, bytes]:
        short = _More if not last else lambda: Damaged("cut off")
        begins = self.buf[at : at + 10]
        if begins.startswith(b"WARC/"):
            head = _head(self.buf, at)
            if head is None:
                raise short()
            end = head[0] + _length(head[1], self.limit) + 4
            if end > len(self.buf):
                raise short()
            return end, *checked(self.buf[at:end], self.limit)
        if begins.startswith(b"\x1f\x8b\x08"):
            return self._members(at, short)
        if len(begins) < 5 and (b"WARC/".startswith(begins) or b"\x1f\x8b\x08".startswith(begins)):
            raise short()
        raise Damaged("no record")

    def _members(self, at: int, short) -> tuple[int, dict, bytes]:
        """A record of one or more gzip members."""
        out, want = bytearray(), None
        while True:
            z = zlib.decompressobj(31)
            while not z.eof:
                if at >= len(self.buf):
                    raise short()
                piece = self.buf[at : at + _PIECE]
                at += len(piece)
                try:
                    out += z.decompress(piece)
                except zlib.error as e:
                    raise Damaged(f"member: {e}") from None
                if want is None and (head := _head(out)):
                    want = head[0] + _length(head[1], self.limit) + 4
                if want is not None and len(out) > want:
                    raise Damaged("length")
            at -= len(z.unused_data)
            if want is None:
                raise Damaged("header")
            if len(out) == want:
                return at, *checked(bytes(out), self.limit)
            if at >= len(self.buf):
                raise short()
            if self.buf[at : at + 1] != b"\x1f":
                raise Damaged("length")


RECORDS = "file string, offset long, length long, kind string, reason string, type string, record_id string, refers_to string, target string, date string, payload_length long, payload_digest string, payload binary"


def _row(file: str, offset: int, length: int, reason: str | None, fields: dict | None, block: bytes | None, payloads: bool) -> dict:
    """A row of RECORDS. The payload of an HTTP response is what follows its header; a revisit has none, but its header may tell
    the length and its record the digest of the full one."""
    row = dict.fromkeys((c.split()[0] for c in RECORDS.split(", "))) | {"file": file, "offset": offset, "length": length, "kind": "gap" if reason else "record", "reason": reason}
    if reason:
        return row
    row |= {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    payload, http = block, b""
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
    if row["type"] == "revisit":
        m = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)
        kind, _, value = fields.get("warc-payload-digest", "").partition(":")
        return row | {"payload_length": int(m[1]) if m else None, "payload_digest": value.lower() if kind.lower() in ("sha256", "sha-256") else None}
    return row | {"payload_length": len(payload), "payload_digest": sha256(payload).hexdigest(), "payload": payload if payloads else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = False, limit: int = MAX_RECORD) -> DataFrame:
    """The rows of RECORDS of all archives at `path`, compressed by members or not: kind `record`, with the payload if asked for,
    and kind `gap`, a run of bytes at offset and length in which no valid record begins, with the first check that failed.

    Records over `limit` bytes count as damaged, which bounds a task's memory. An archive is read by one task, as its members
    follow each other; several are read at once. Empty archives have no rows. Names that end in .gz or the like are read
    whole (see sources.raw). Two whole copies of a record are two rows.
    """
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("kind", "reason", "type", "record_id", "refers_to", "target", "date")), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        name, salvage, rows, held = None, None, [], 0
        for b in batches:
            for file, body in zip(b["file"].to_pylist(), b["body"], strict=True):
                if file != name:
                    if salvage:
                        rows += [_row(name, *r, payloads) for r in salvage.feed(b"", True)]
                    name, salvage = file, Salvage(limit)
                for r in salvage.feed(body.as_py()):
                    rows.append(_row(file, *r, payloads))
                    held += len(r[4]) if payloads and r[4] else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if salvage:
            rows += [_row(name, *r, payloads) for r in salvage.feed(b"", True)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    bytes_ = chunks(spark, path).select("file", "offset", "body").repartition("file").sortWithinPartitions("file", "offset")
    return bounded_batches(bytes_).mapInArrow(run, RECORDS)


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page id, for revisits) of the records
    that write_archives made of pages."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    pages = records.filter("kind = 'record' and type in ('response', 'revisit')")
    return pages.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def gaps(records: DataFrame) -> DataFrame:
    """The quarantined bytes: file, offset, length, reason."""
    return records.filter("kind = 'gap'").select("file", "offset", "length", "reason")
