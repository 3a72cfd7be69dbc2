"""WARC archives: a writer, and a reader that salvages what damage leaves.

The reader goes from record to record. Where a check fails (no gzip member or version
line, a broken stream, a bad length, a wrong digest, a cut end) it searches for the
next place where a whole record passes every check, logs the bytes between as one
quarantined gap, and goes on from there. It reads archives by pyarrow's file systems,
so they may lie wherever the cluster's shared folder does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_path, new_path, written

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")
#: Digest algorithms that are verified; by any other, a record stands as it is.
DIGESTS = frozenset(["md5", "sha1", "sha256", "sha384", "sha512"])
#: Bytes read at a time.
CHUNK = 1 << 20
#: Bytes that headers have at most, or somewhat more, and how many bytes one of deflated data stands for at most.
HEADERS, DEFLATED = 1 << 20, 1040


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


class BrokenLine(Damaged):
    """Headers that end in a line that is none or without a length, and where."""

    def __init__(self, why: str, at: int):
        super().__init__(why)
        self.at = at


class Source:
    """Random access to a file by a buffer that only moves on, so a long archive isn't held whole."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""
        self.hopeless = 0  # no version line before this place begins a record: it would have the end of the same headers

    def read(self, offset: int, length: int) -> bytes:
        end = min(self.size, offset + length)
        if end <= offset:
            return b""
        if not (self.at <= offset and end <= self.at + len(self.held)):
            self.file.seek(offset)
            self.held, self.at = self.file.read(max(length, CHUNK)), offset
        return self.held[offset - self.at : end - self.at]

    def peek(self, offset: int, length: int) -> bytes:
        """A few bytes from anywhere, without moving the buffer."""
        if self.at <= offset and offset + length <= self.at + len(self.held):
            return self.held[offset - self.at : offset - self.at + length]
        self.file.seek(offset)
        return self.file.read(length)

    def find(self, wanted: re.Pattern, offset: int) -> int:
        """The first place at or after ``offset`` where ``wanted`` (16 bytes at most) matches, or the size."""
        while offset < self.size:
            if not self.at <= offset < self.at + len(self.held) - 16:
                self.read(offset, CHUNK)
            if m := wanted.search(self.held, offset - self.at):  # in the buffer itself, no copy of it
                return self.at + m.start()
            behind = self.at + len(self.held)
            if behind >= self.size:
                break
            offset = max(offset + 1, behind - 16)
        return self.size


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not FIELD.fullmatch(name):
            raise Damaged("a line that is no header field")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def agrees(header: str, data: bytes) -> bool | None:
    """Whether a digest header (``algorithm:value``, in hex, base32 or base64) is that of
    ``data``; None if there is none or its algorithm isn't computed here."""
    kind, _, value = header.partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip()
    if kind not in DIGESTS or not value:
        return None
    own = hashlib.new(kind, data)
    if len(value) == 2 * own.digest_size:
        return value.lower() == own.hexdigest()
    base32, base64_ = (f(own.digest()).decode().rstrip("=") for f in (base64.b32encode, base64.urlsafe_b64encode))
    value = value.rstrip("=")
    return value.upper() == base32 or value.replace("+", "-").replace("/", "_") == base64_


def _unchunked(body: bytes) -> bytes | None:
    """``body`` without its chunked transfer coding; None if it isn't one."""
    out, at = [], 0
    while m := CHUNK_SIZE.match(body, at):
        size, at = int(m[1], 16), m.end()
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2
    return None


def payload_agrees(header: str, http: bytes, body: bytes) -> bool | None:
    """As :func:`agrees` for a response's body as it is stored or, where that is in chunks, as they are joined."""
    same = agrees(header, body)
    if same is False and re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", http) and (joined := _unchunked(body)) is not None:
        return agrees(header, joined)
    return same


def _head(pull) -> tuple[dict[str, str], int, int]:
    """Headers, where the block begins, and its length, of the record that ``pull(n)`` gives the first n bytes of.

    Lines are looked at as they come, so what is no header is left at its first line that is no field.
    """
    want, data, checked = 4096, pull(4096), 0
    if not VERSION.match(data):
        raise Damaged("no version line")
    while True:
        split = data.find(b"\r\n\r\n", max(0, checked - 4))
        upto = split + 2 if split >= 0 else data.rfind(b"\r\n") + 2
        at = checked or data.find(b"\r\n") + 2
        while at < upto:
            end = data.find(b"\r\n", at)
            name, colon, _ = data[at:end].partition(b":")
            if not colon or not FIELD.fullmatch(name):
                raise BrokenLine("a line that is no header field", at)
            at = end + 2
        checked = at
        if split >= 0:
            break
        if len(data) < want or want > HEADERS:
            raise BrokenLine("headers without an end", checked)
        want *= 4
        data = pull(want)
    headers = _headers(data[:split])
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,15}", length):
        raise BrokenLine("no content length", split)
    return headers, split + 4, int(length)


def _block(headers: dict[str, str], data: bytes, begin: int, length: int) -> bytes:
    """The block of a record whose bytes are ``data``, checked."""
    end = begin + length
    if len(data) < end + 4:
        raise Damaged("cut short")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end of record where the length says")
    block = data[begin:end]
    if agrees(headers.get("warc-block-digest", ""), block) is False:
        raise Damaged("wrong block digest")
    return block


def record_at(source: Source, offset: int) -> Record:
    """The record, plain or a gzip member, that begins at ``offset`` and passes all checks.

    A length is held against what is left of the file before anything is read for it, and a plain record's end is looked at before its block is.
    """
    left = source.size - offset
    if source.read(offset, 3) == GZIP:
        member, plain, at = zlib.decompressobj(31), [], offset
        have = 0

        def pull(n: int) -> bytes:
            nonlocal at, have
            while have < n and not member.eof:
                raw = member.unconsumed_tail
                if not raw:
                    raw = source.read(at, CHUNK // 4)
                    at += len(raw)
                    if not raw:
                        raise Damaged("cut short")
                try:
                    plain.append(member.decompress(raw, max(1, n - have)))
                except zlib.error as e:
                    raise Damaged("broken gzip member") from e
                have += len(plain[-1])
            whole = b"".join(plain)
            plain[:] = [whole]
            return whole[:n]

        headers, begin, length = _head(pull)
        if length > DEFLATED * left:
            raise Damaged("cut short")
        block = _block(headers, pull(begin + length + 4), begin, length)
        pull(begin + length + 5)  # to the member's end, where its checksum is held against the data
        if not member.eof or have != begin + length + 4:
            raise Damaged("a member that isn't one record")
        return Record(offset, at - len(member.unused_data), headers, block)
    if offset < source.hopeless:
        raise Damaged("a line that is no header field")
    try:
        headers, begin, length = _head(lambda n: source.read(offset, n))
    except BrokenLine as e:
        source.hopeless = offset + e.at
        raise
    whole = begin + length + 4 <= left
    if not whole or source.peek(offset + begin + length, 4) != b"\r\n\r\n":
        source.hopeless = offset + begin  # a version line further on in these headers has the same length from the same place, or none
        raise Damaged("no end of record where the length says" if whole else "cut short")
    block = _block(headers, source.read(offset, begin + length + 4), begin, length)
    return Record(offset, offset + begin + length + 4, headers, block)


def salvage(source: Source) -> Iterator[Record | Gap]:
    """Every whole record in order, and a gap for all bytes between that belong to none."""
    begin = re.compile(re.escape(GZIP) + rb"|WARC/1\.[01]\r\n")
    offset, lost, why = 0, None, ""
    while offset < source.size:
        try:
            record = record_at(source, offset)
        except Damaged as e:
            if lost is None:
                lost, why = offset, str(e)
            offset = source.find(begin, offset + 1)
            continue
        if lost is not None:
            yield Gap(lost, offset - lost, why)
            lost = None
        yield record
        offset = record.end
    if lost is not None:
        yield Gap(lost, source.size - lost, why)


def _line(value: str | None) -> str:
    """A header's value on one line: control characters, spaces and percent signs of ``value`` escaped."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "")


def response_record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None, compress: bool = True) -> bytes:
    """A response with its payload, or, with ``refers_to``, a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(uri)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return record
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_name(page_id: object) -> str:
    return f"urn:page:{page_id}"


def page_of(name: str | None) -> int | None:
    m = re.fullmatch(r"<?urn:page:(-?\d+)>?", name or "")
    return int(m[1]) if m else None


def deduplicated(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """``pages`` (id, url, html) plus ``digest`` and ``first``: the smallest id of the
    rows with an equal payload of ``least_bytes`` or more, else null.

    Only payloads that occur again take part in a join, and of these ids and digests only: the first join
    finds whose they are, and a hot digest is one side of it that adaptive execution splits; the second goes by id, so
    pages are dealt evenly, and small ones (all empty ones, say) stay out of both.
    """
    hashed = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= least_bytes
    again = hashed.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = hashed.where(long).select("id", "digest").join(again, "digest").distinct().select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first")
    found = hashed.where(long).join(firsts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__digest")
    return found.unionByName(hashed.where(~long).withColumn("first", F.lit(None).cast(hashed.schema["id"].dataType)))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, compress: bool = True) -> DataFrame:
    """Writes archives of about ``archive_bytes`` into ``folder`` and returns the
    manifest (path, records, bytes) of those that were finished.

    Each attempt of a task has file names of its own, so one that is lost or run twice
    leaves files that no manifest names. The manifest is written to the shared folder.
    """
    def of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for frame in frames:
            for page_id, url, html, digest, first in zip(frame["id"], frame["url"], frame["html"], frame["digest"], frame["first"]):
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                own = None if pd.isna(page_id) else int(page_id)
                refers = None if pd.isna(first) or own == int(first) else record_name(int(first))
                data = response_record(record_name(own), url, html.encode("utf-8"), digest, refers, compress)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    manifest, _ = written(pages.select("id", "url", "html", "digest", "first").mapInPandas(of, "path string, records long, bytes long"), "manifest")
    return manifest


RECORDS = "archive string, offset long, length long, kind string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, reason string"


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``manifest`` (path), and one of kind
    ``gap`` for each quarantined range of bytes, with the reason.

    ``payload_bytes`` is the HTTP body's length as the record's headers give it, which
    for a revisit is that of the full payload. ``payload_digest`` is SHA-256 in hex, for a
    response computed where its header gives none or another; other records, whose
    payload isn't at hand, keep what another header says, with its algorithm. A response is
    quarantined if its header's digest is of an algorithm in DIGESTS and differs. Null
    paths are passed over.
    """
    def of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORDS.split(", ")]
        for frame in frames:
            for path in frame["path"].dropna():
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for x in salvage(Source(file, file.size())):
                        if isinstance(x, Gap):
                            rows.append((path, x.offset, x.length, "gap", None, None, None, None, None, None, x.reason))
                        else:
                            h = x.headers
                            http, _, body = x.block.partition(b"\r\n\r\n") if x.block.startswith(b"HTTP/") else (b"", b"", x.block)
                            m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            full = int(m[1]) if m else len(body)
                            kind = h.get("warc-type", "")
                            named = h.get("warc-payload-digest", "")
                            same = payload_agrees(named, http, body) if kind == "response" else None
                            if same is False:
                                rows.append((path, x.offset, x.end - x.offset, "gap", None, None, None, None, None, None, "wrong payload digest"))
                                continue
                            sha256 = re.fullmatch(r"(?i)\s*sha-?256:\s*([0-9a-f]{64})\s*", named)
                            if kind == "response":
                                digest = sha256[1].lower() if sha256 else hashlib.sha256(body).hexdigest()
                            else:
                                digest = sha256[1].lower() if sha256 else named
                            rows.append((path, x.offset, x.end - x.offset, kind, h.get("warc-record-id", "").strip("<>"), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-target-uri"), digest, full, body if keep_payload and kind == "response" else None, None))
                            held += len(body) if keep_payload else 0
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    spread = manifest.select("path").where("path IS NOT NULL")
    return spread.repartition(max(1, spark_parallelism(manifest.sparkSession))).mapInPandas(of, RECORDS)


def spark_parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism * 2


def page_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives, reads these back, and returns
    (page_id, payload_bytes, payload_digest, record_type, refers_to) from the records.

    A null html is an empty payload. A page whose id is null is written and read as one
    with no id. Rows that repeat an id with an equal payload are all responses if that
    id is the smallest. An empty table gives no rows. Columns beyond these three are
    not read. A gap in an archive that was just written, or a record too few, is an error that
    names the gaps; the archives are dropped once they were read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_archives(deduplicated(pages, least_bytes=least_bytes), folder)
    records, _ = written(read_archives(manifest, keep_payload=False), "records")
    gaps = records.where("kind = 'gap'")
    wrote, read = manifest.agg(F.sum("records")).first()[0] or 0, records.where("kind <> 'gap'").count()
    if wrote != read or not gaps.isEmpty():
        lost = gaps.select("archive", "offset", "length", "reason").orderBy("archive", "offset").take(10)
        raise ValueError(f"{wrote} records were written and {read} read back; the first gaps: {[tuple(r) for r in lost]}")
    number = lambda c: F.when(page_number(F.col(c)) != "", page_number(F.col(c)).cast("long"))
    drop_path(spark, folder)
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"),
    )
