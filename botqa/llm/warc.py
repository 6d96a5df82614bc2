"""WARC archives in Zstandard frames: writer and reader.

An archive (``.warc.zst``) holds its compression dictionary in a leading skippable
frame and then one frame per record, so that a record is decoded by itself.  The
reader loads the dictionary, walks from frame to frame, decodes each and validates
the record: version, field lines, mandatory fields, block length, end of record,
the HTTP head of the block and the digests.  A frame that fails any of this is a
row with ``error``; reading goes on with the next frame.

``write_archives`` makes one record per page.  Of pages with one payload (of
``MIN_REVISIT`` bytes or more) the first by (page_id, url), nulls last, is a
``response``; the others are ``revisit`` records that name it and hold no payload.
Record ids are made from page_id, url and payload digest, so a revisit's target is
known before anything is written.  Each task writes archives of about
``ARCHIVE_BYTES`` under names of its own; the written list of archives (path,
records, bytes) says which count, so files of lost or repeated tasks are never
read.  The dictionary of an archive is trained on its first ``SAMPLE_BYTES`` of
records.  A task holds that sample, one record and its output buffer.

Files are opened through ``pyarrow.fs``, by the URI of the shared folder.

Edges: null html is an empty payload; a null url is written as ``urn:none``, a
null page_id has no page field; rows alike in page_id, url and payload make the
same record (one id) as often as they occur; pages without page_id come after all
others; an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_to_unique, shared_dir, staged

MIN_REVISIT = 100
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 1 << 20, 64 << 10
#: Decoded bytes of one record at most; a frame that claims more is an error row.
MAX_RECORD_BYTES = 1 << 30
BATCH_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"

# FIXED VALUES: magic numbers of Zstandard frames, and fields and profile of the WARC format
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0x184D2A50
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "Page-ID"


# --- records -------------------------------------------------------------------------

def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def record_id(page_id, url: str | None, digest: str) -> str:
    """``<urn:uuid:...>`` from the page and its payload."""
    told = hashlib.sha256(f"{page_id!r} {url!r} {digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=told[:16], version=5)}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else "urn:none"


def page_record(page_id, url: str | None, payload: bytes, size: int, digest: str, first: tuple | None) -> bytes:
    """The record of a page with a payload of ``size`` bytes; ``first``: (page_id, url)
    of the response that it revisits, if any (the payload is then not used)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if first else head + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", DATE),
              ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append((PAGE_FIELD, str(page_id)))
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Target-URI", _uri(first[1])),
                   ("WARC-Refers-To-Date", DATE)]
    return _record(fields, block)


_FIELD = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+:")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one decoded record; ValueError if it is not valid."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise ValueError("no WARC version line")
    if end < 0:
        raise ValueError("fields don't end")
    fields: dict[str, str] = {}
    for line in raw[10:end].split(b"\r\n"):
        if not _FIELD.match(line):
            raise ValueError(f"not a field line: {line[:40]!r}")
        name, _, value = line.partition(b":")
        try:
            fields[name.decode()] = value.strip().decode()
        except UnicodeDecodeError:
            raise ValueError(f"field {name!r} is not UTF-8") from None
    missing = [k for k in MANDATORY if k not in fields]
    if missing:
        raise ValueError(f"no {missing[0]}")
    if not re.fullmatch(r"\d+", fields["Content-Length"]):
        raise ValueError("Content-Length is not a number")
    block = raw[end + 4:-4]
    if not raw.endswith(b"\r\n\r\n") or len(raw) < end + 8 or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"block of {max(0, len(raw) - end - 8)} bytes, Content-Length {fields['Content-Length']}")
    _check(fields, "WARC-Block-Digest", block)
    return fields, block


def _check(fields: dict[str, str], name: str, data: bytes) -> None:
    kind, _, told = fields.get(name, "").partition(":")
    if kind == "sha256" and hashlib.sha256(data).hexdigest() != told.lower():
        raise ValueError(f"{name} differs")


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload of an HTTP response; None for records that hold none."""
    if fields["WARC-Type"] != "response":
        if fields["WARC-Type"] == "revisit" and "WARC-Refers-To" not in fields:
            raise ValueError("no WARC-Refers-To")
        return None
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    told = re.search(rb"\r\nContent-Length: *(\d+)", head, re.IGNORECASE)
    if told and int(told[1]) != len(payload):
        raise ValueError(f"payload of {len(payload)} bytes, HTTP Content-Length {int(told[1])}")
    _check(fields, "WARC-Payload-Digest", payload)
    return payload


# --- archives ------------------------------------------------------------------------

def train(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for records like these; None if they are too few to learn from."""
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 16)
    if len(sample) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:  # records without anything in common
        return None


class _Writer:
    """Writes records into archives, one at a time."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.limit, self.sample, self.out, self.sampled = folder, archive_bytes, [], None, 0

    def add(self, record: bytes) -> dict | None:
        """Put one record; the archive's entry of the list once it is full."""
        if self.out is None:
            self.sample.append(record)
            self.sampled += len(record)
            if self.sampled >= min(SAMPLE_BYTES, self.limit):
                self._open()
        else:
            self._put(record)
        return self.close() if self.out is not None and self.size >= self.limit else None

    def _open(self) -> None:
        trained, self.name = train(self.sample), f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.records = self.size = 0
        if trained:
            raw = trained.as_bytes()
            self._raw(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
        self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                           ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        for record in self.sample:
            self._put(record)
        self.sample, self.sampled = [], 0

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _put(self, record: bytes) -> None:
        self._raw(self.compressor.compress(record))
        self.records += 1

    def close(self) -> dict | None:
        """End the open archive, or what is not in one yet."""
        if self.out is None and self.sample:
            self._open()
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return {"path": f"{self.folder}/{self.name}", "records": self.records, "bytes": self.size}


def _folder_uri(spark: SparkSession) -> str:
    """A new folder in the shared one, as a URI (a bare path belongs to the default file system)."""
    base = shared_dir(spark)
    if not re.match(r"[a-z][a-z0-9+.-]*:", base):
        base = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").rstrip("/") + base
    return re.sub(r"^file:/+", "file:///", base) + f"/llm/warc-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into archives; the list of them: path, records, bytes."""
    folder = folder or _folder_uri(pages.sparkSession)
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size"))
    firsts = staged(firsts.where("n > 1").select("digest", "n", F.when(F.col("size") >= MIN_REVISIT, F.col("first")).alias("first")), "firsts")
    rows = joined_to_unique(rows, firsts.drop("n"), "digest", firsts.select("digest", "n"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    again = F.col("first").isNotNull() & ~is_first
    rows = rows.select("page_id", "url", "digest", again.alias("again"), F.octet_length("payload").alias("size"),
                       F.when(~again, F.col("payload")).alias("payload"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, schema = _Writer(folder, archive_bytes), pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            payload = batch.column("payload")
            told = batch.drop_columns(["payload"]).to_pylist()
            for i, r in enumerate(told):
                first = (r["first_id"], r["first_url"]) if r["again"] else None
                closed = writer.add(page_record(r["page_id"], r["url"], payload[i].as_py() or b"", r["size"], r["digest"], first))
                if closed:
                    yield pa.RecordBatch.from_pylist([closed], schema)
        closed = writer.close()
        if closed:
            yield pa.RecordBatch.from_pylist([closed], schema)
    return staged(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


# --- reading -------------------------------------------------------------------------

class _Frames:
    """Walks over the frames of a stream, holding one frame and one read ahead."""

    def __init__(self, stream, ahead: int = 1 << 20):
        self.stream, self.ahead, self.buffer, self.at, self.offset = stream, ahead, b"", 0, 0

    def need(self, n: int) -> bool:
        """Whether the buffer holds ``n`` bytes from here on, after reading on."""
        if len(self.buffer) - self.at < n:
            parts, have = [self.buffer[self.at:]], len(self.buffer) - self.at
            while have < n and (more := self.stream.read(max(self.ahead, n - have))):
                parts.append(more)
                have += len(more)
            self.buffer, self.at = b"".join(parts), 0
        return len(self.buffer) - self.at >= n

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(offset, magic, whole frame); ValueError where no frame can be told."""
        while self.need(1):
            if not self.need(8):
                raise ValueError("truncated frame")
            magic, size = struct.unpack_from("<II", self.buffer, self.at)
            n = 8 + size if magic & ~15 == SKIPPABLE else self._length(magic)
            if not self.need(n):
                raise ValueError("truncated frame")
            yield self.offset, magic, self.buffer[self.at:self.at + n]
            self.at += n
            self.offset += n

    def _length(self, magic: int) -> int:
        """Bytes of a data frame: header, blocks, checksum."""
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        self.need(18)
        kind = self.buffer[self.at + 4]
        single = kind >> 5 & 1
        n = 5 + (not single) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
        last = False
        while not last:
            if not self.need(n + 3):
                raise ValueError("truncated frame")
            head = int.from_bytes(self.buffer[self.at + n:self.at + n + 3], "little")
            last, how = head & 1, head >> 1 & 3
            if how == 3:
                raise ValueError("reserved block type")
            n += 3 + (1 if how == 1 else head >> 3)  # a run-length block holds one byte
        return n + 4 * (kind >> 2 & 1)


def load_dictionary(frame: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading skippable frame, which may be compressed itself."""
    raw = frame[8:]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw)


def _decode(decompressor: zstandard.ZstdDecompressor, frame: bytes, dictionary: int) -> bytes:
    told = zstandard.get_frame_parameters(frame)
    if told.dict_id and told.dict_id != dictionary:
        raise ValueError(f"needs dictionary {told.dict_id}")
    known = told.content_size not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
    if known and told.content_size > MAX_RECORD_BYTES:
        raise ValueError(f"record of {told.content_size} bytes")
    if known:
        return decompressor.decompress(frame)
    with decompressor.stream_reader(frame) as reader:
        raw = reader.read(MAX_RECORD_BYTES + 1)
    if len(raw) > MAX_RECORD_BYTES:
        raise ValueError(f"record of over {MAX_RECORD_BYTES} bytes")
    return raw


def read_archive(stream) -> Iterator[dict]:
    """Records of one open archive in order; faults are rows with ``error``."""
    decompressor, dictionary, number, frames = zstandard.ZstdDecompressor(), 0, 0, _Frames(stream)
    try:
        for offset, magic, frame in frames:
            if magic != FRAME_MAGIC:
                if offset == 0 and magic == DICTIONARY_MAGIC:
                    loaded = load_dictionary(frame)
                    decompressor, dictionary = zstandard.ZstdDecompressor(dict_data=loaded), loaded.dict_id()
                continue
            row = {"frame": number, "offset": offset, "length": len(frame)}
            number += 1
            try:
                fields, block = parse_record(_decode(decompressor, frame, dictionary))
                row |= {"fields": fields, "payload": payload_of(fields, block)}
            except (ValueError, zstandard.ZstdError) as e:
                row["error"] = str(e)
            yield row
    except (ValueError, zstandard.ZstdError) as e:  # nothing after this place can be told apart
        yield {"frame": number, "offset": frames.offset, "length": 0, "error": str(e)}


_SCHEMA = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string()),
                     ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                     ("page_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
                     ("fields", pa.map_(pa.string(), pa.string()))])
_DDL = ("path string, frame long, offset long, length long, error string, record_type string, record_id string, refers_to string, target_uri string, "
        "page_id string, payload_digest string, payload_bytes long, payload binary, fields map<string, string>")


def _row(path: str, found: dict, whole: bool) -> dict:
    fields, payload = found.get("fields") or {}, found.get("payload")
    kind, _, told = fields.get("WARC-Payload-Digest", "").partition(":")
    digest = hashlib.sha256(payload).hexdigest() if payload is not None else told.lower() if kind == "sha256" else None
    return {"path": path, "frame": found["frame"], "offset": found["offset"], "length": found["length"], "error": found.get("error"),
            "record_type": fields.get("WARC-Type"), "record_id": fields.get("WARC-Record-ID"), "refers_to": fields.get("WARC-Refers-To"),
            "target_uri": fields.get("WARC-Target-URI"), "page_id": fields.get(PAGE_FIELD), "payload_digest": digest,
            "payload_bytes": None if payload is None else len(payload), "payload": payload if whole else None,
            "fields": list(fields.items()) if whole else None}


def read_archives(archives: DataFrame, whole: bool = True) -> DataFrame:
    """Every record of the archives that the column ``path`` names (URIs), with its
    place, fields and payload; ``whole=False`` leaves fields and payload out.  One
    archive is one stream of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_stream(name, compression=None) as stream:
                    for found in read_archive(stream):
                        rows.append(_row(path, found, whole))
                        size += 500 + (len(found.get("payload") or b"") if whole else 0)
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
    spread = archives.select("path").repartitionByRange(max(1, min(archives.count(), 100_000)), "path")  # an archive a task
    return spread.mapInArrow(run, _DDL)


def resolved(records: DataFrame) -> DataFrame:
    """Response and revisit records; revisits get ``refers_to_page`` and the bytes of
    their response's payload.  A revisit without a response of its digest gets an error."""
    rows = records.where("record_type in ('response', 'revisit')")
    targets = (rows.where("record_type = 'response' and record_id is not null").groupBy(F.col("record_id").alias("refers_to"))
               .agg(F.min("page_id").alias("refers_to_page"), F.min("payload_bytes").alias("full_bytes"), F.min("payload_digest").alias("full_digest")))
    rows = joined_to_unique(rows, targets, "refers_to")
    lost = (F.col("record_type") == "revisit") & ~F.col("full_digest").eqNullSafe(F.col("payload_digest"))
    return rows.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).withColumn(
        "error", F.when(lost, F.lit("its response is not in the archives")).otherwise(F.col("error"))).drop("full_bytes", "full_digest")

