"""WARC archives: a writer of one gzip member for each record, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch_folder, small_arrow_batches

PIECE, HEAD = 1 << 20, 1 << 20  # bytes inflated at once; bytes that a record's or a response's header may have
GZIP, FOLLOWED = 31, b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Fixed value of the format's first revisit profile.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    pass


# writing


def packed(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    own = [*fields, ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in own) + "\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return b"".join([deflate.compress(head.encode()), deflate.compress(block), deflate.compress(FOLLOWED), deflate.flush()])


def labelled(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def address(url: str | None, record: str) -> str:
    """The target: white space, controls and what is not ASCII percent-encoded; a page without one is named by its record."""
    url = (url or "").strip()
    return re.sub(r"[^\x21-\x7e]", lambda m: quote(m[0]), url) if url else record


def record_id(page: object, digest: str) -> str:
    return f"urn:page:{'' if page is None else quote(str(page), safe='')}:{digest}"


def page_record(page: object, url: str | None, payload: bytes | None, size: int, digest: str, response: object, date: str, level: int) -> bytes:
    """A response with its payload, or a revisit of the page `response`; a revisit's block is the HTTP header alone."""
    revisit = response is not None
    own = record_id(page, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("WARC-Target-URI", address(url, own)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", labelled(bytes.fromhex(digest)))]
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{record_id(response, digest)}>"), ("WARC-Refers-To-Date", date)]
    return packed(fields, http if revisit else http + (payload or b""), level)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, archive_bytes: int = 128 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 6, spread: int = 16) -> DataFrame:
    """(archive, records, bytes): the archives written in folder, which executors share.

    Each page is a record, its payload the text in UTF-8. Of pages with equal
    payloads, by SHA-1 and length, of `least` bytes or more that with the
    largest id is a response and the others are revisits of it; where none has
    an id, and where rows repeat that id too, all are responses. The join that
    tells them spreads a payload's copies over `spread` keys.

    A task writes under names of its own, beginning a new archive after
    archive_bytes. Only what finished tasks wrote is in the stored list, so a
    task that was lost or ran twice leaves files behind but no records.
    """
    spark = pages.sparkSession
    small_arrow_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    first = rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("_d"), F.col("size").alias("_z")).agg(F.max("page").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.filter("_n > 1 and _first is not null").drop("_n").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    salt = F.pmod(F.xxhash64("page"), F.lit(spread)).cast("int")
    met = rows.withColumn("_salt", salt).join(first, (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_z")) & (F.col("_salt") == F.col("_s")), "left")
    response = F.when(F.col("_first").isNotNull() & ~F.col("page").eqNullSafe(F.col("_first")), F.col("_first"))
    met = met.withColumn("response", response)
    met = met.select("page", "url", F.when(F.col("response").isNull(), F.col("payload")).alias("payload"), "size", "digest", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, records, length = "", None, 0, 0

        def finish() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [records], "bytes": [length]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    length = out.write(packed(about, b"format: WARC File Format 1.1\r\n", level))
                length += out.write(page_record(row["page"], row["url"], row["payload"], row["size"], row["digest"], row["response"], date, level))
                records += 1
                if length >= archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return materialize(met.mapInArrow(write, "archive string, records long, bytes long"), "warc-archives")


# reading


@dataclass
class Raw:
    """A file's bytes in pieces, of which unused ones are given back."""

    file: pa.NativeFile
    held: bytes = b""

    def piece(self) -> bytes:
        out, self.held = self.held or self.file.read(PIECE), b""
        return out

    @property
    def offset(self) -> int:
        return self.file.tell() - len(self.held)

    def seek(self, offset: int) -> None:
        self.file.seek(offset)
        self.held = b""

    def skip_to_magic(self) -> bool:
        """Moves to the next place that could begin a member; False at the end."""
        rest = b""
        while data := self.piece():
            joined = rest + data
            at = joined.find(MAGIC)
            if at >= 0:
                self.held = joined[at:]
                return True
            rest = joined[-2:]
        return False


@dataclass
class Member:
    """The inflated bytes of the gzip member that begins here, no more of them at once than a piece."""

    raw: Raw
    inflate: zlib._Decompress = field(default_factory=lambda: zlib.decompressobj(GZIP))
    held: bytes = b""

    def more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw.piece()
            if not data:
                raise DamagedRecord("the archive ends within a record")
            try:
                new = self.inflate.decompress(data, PIECE)
            except zlib.error as error:
                raise DamagedRecord(f"not inflated: {error}") from None
            if self.inflate.eof:
                self.raw.held = self.inflate.unused_data
            if new:
                self.held += new
                return True
        return False

    def line(self, most: int) -> bytes:
        """Up to a line's end, without it."""
        while (at := self.held.find(b"\n")) < 0:
            if len(self.held) > most or not self.more():
                raise DamagedRecord("a header without an end")
        out, self.held = self.held[:at], self.held[at + 1 :]
        return out.removesuffix(b"\r")

    def take(self, count: int) -> Iterator[bytes]:
        """The next `count` bytes in pieces."""
        while count:
            if not self.held and not self.more():
                raise DamagedRecord("the record is shorter than its Content-Length")
            out, self.held = self.held[:count], self.held[count:]
            count -= len(out)
            yield out

    def finish(self) -> None:
        """What follows a block must be two line ends and the member's end."""
        while len(self.held) <= len(FOLLOWED) and self.more():
            pass
        if self.held != FOLLOWED:
            raise DamagedRecord("the record is longer than its Content-Length")


def named_fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon:
            raise DamagedRecord("a header line without a colon")
        out[name] = value.strip()
    return out


def known_digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, hex) of a labelled digest in base 32 or 16; None where it can't be checked."""
    algorithm, _, text = (value or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(algorithm).digest_size
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (algorithm, raw.hex()) if len(raw) == size else None


def _content_length(fields: dict[str, str]) -> int | None:
    value = fields.get("content-length", "")
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


def next_record(raw: Raw, payloads: bool) -> dict:
    """The record that begins here. Its block is hashed as it is inflated, and held only if payloads are asked for."""
    member = Member(raw)
    if not re.fullmatch(rb"WARC/\d+\.\d+", member.line(64)):
        raise DamagedRecord("not a WARC record")
    lines, length = [], 0
    while line := member.line(HEAD):
        lines.append(line)
        length += len(line)
        if length > HEAD:
            raise DamagedRecord("a header without an end")
    fields = named_fields(lines)
    left = _content_length(fields)
    if left is None:
        raise DamagedRecord("no Content-Length")
    block_digest, payload_digest = known_digest(fields.get("warc-block-digest")), known_digest(fields.get("warc-payload-digest"))
    block = hashlib.new(block_digest[0]) if block_digest else None
    sha1, asked = hashlib.sha1(), hashlib.new(payload_digest[0]) if payload_digest else None
    kind = fields.get("warc-type", "").lower()
    http = fields.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit", "request")
    head, in_head, size, kept = b"", http, 0, []
    for piece in member.take(left):
        if block:
            block.update(piece)
        if in_head:
            head += piece
            ended = re.search(rb"\r?\n\r?\n", head)
            if not ended:
                if len(head) > HEAD:
                    raise DamagedRecord("a response header without an end")
                continue
            in_head, piece, head = False, head[ended.end() :], head[: ended.start()]
        size += len(piece)
        sha1.update(piece)
        if asked:
            asked.update(piece)
        if payloads:
            kept.append(piece)
    if in_head and left:
        raise DamagedRecord("a response header without an end")
    member.finish()
    digest, matched = sha1.hexdigest(), not payload_digest or asked.hexdigest() == payload_digest[1]
    if kind == "revisit":  # its payload is elsewhere: header fields tell of it
        size, matched = _content_length(named_fields(head.splitlines()[1:])) if head else None, payload_digest is not None
        digest = payload_digest[1] if payload_digest and payload_digest[0] == "sha1" else None
    plain = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "record_id": plain("warc-record-id"), "record_type": kind, "target": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": plain("warc-refers-to"), "payload_bytes": size,
        "payload_digest": digest, "verified": matched and (not block_digest or block.hexdigest() == block_digest[1]), "error": None, "payload": b"".join(kept) if payloads and kind != "revisit" else None,
    }


def records(file: pa.NativeFile, payloads: bool = False) -> Iterator[dict]:
    """Records in the order of the archive.

    Where one is damaged, a row says why, and the reader goes on at the next
    gzip member that holds a record.
    """
    raw, lost = Raw(file), False
    while True:
        offset = raw.offset
        if not (head := raw.piece()):
            return
        raw.held = head
        try:
            yield {"offset": offset, **next_record(raw, payloads)}
            lost = False
        except DamagedRecord as error:
            if not lost:
                yield {"offset": offset, "error": str(error), "verified": False}
            lost = True
            raw.seek(offset + 1)
            if not raw.skip_to_magic():
                return


FIELDS = "archive string, offset long, record_id string, record_type string, target string, date string, refers_to string, payload_bytes long, payload_digest string, verified boolean, error string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the archives (archive): FIELDS, in an archive's order by offset.

    An archive is read by one task from front to end; what is inflated is held
    piece by piece, and payloads only where they are asked for. offset is where
    the record's member begins. payload_digest is the payload's SHA-1 in hex,
    and verified says that it and the block's digest agree with the header; a
    revisit, whose payload is not there, has both its length and digest from
    headers. A damaged record is a row with `error`. An archive that is absent
    is an error of the job. A null name has no records.
    """
    spark = archives.sparkSession
    small_arrow_batches(spark)
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for row in records(file, payloads):
                        held.append({"archive": archive} | row)
                        size += len(row.get("payload") or b"")
                        if len(held) >= 2000 or size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    listed = archives.select(F.col("archive").cast("string")).filter("archive is not null")
    return listed.repartition(partitions(spark)).mapInArrow(read, FIELDS)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified): pages written as archives and read back.

    A null text is an empty payload; a null or blank address is named by the
    record. Pages of `least` bytes or more with one payload are revisits of the
    one with the largest id, which refers_to names; a page without an id is a
    record too, and a revisit where another has one; rows that repeat the
    largest id and its payload are all responses. Other columns are not looked
    at. An empty table makes no archives and gives an empty result.
    """
    folder = f"{scratch_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, id_col, url_col, payload_col, least)
    kind = pages.schema[id_col].dataType
    page = lambda name: F.url_decode(F.nullif(F.regexp_extract(name, r"^urn:page:([^:]*):", 1), F.lit(""))).cast(kind)
    found = read_archives(archives).filter("record_type is null or record_type <> 'warcinfo'")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "verified")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY n, d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to, true AS verified FROM m
"""
