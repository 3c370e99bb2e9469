"""WARC archives as tables of chunks.

A record is a run of rows (record, chunk number, bytes), so that neither the writer nor the reader ever holds a whole
payload in Python: the writer compresses chunk after chunk into the archive, the reader yields chunk after chunk, each
with the length and the SHA-1 of the payload so far. Records with equal payloads point to one of them as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import string
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .common import settle

#: Bytes in a chunk, compressed bytes after which the writer begins another archive, and bytes that the reader yields at a time.
CHUNK_BYTES, FILE_BYTES, BATCH_BYTES = 1 << 18, 1 << 28, 1 << 22
#: Payloads of fewer bytes are written out even if they repeat.
LEAST_REVISIT = 1000
#: Fixed values of the format: the profile of revisits, and the prefix of the record names made from keys.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN, NO_KEY = "urn:page:", "urn:no-page"

RECORD_FIELDS = "record_id string, record_type string, target_uri string, refers_to string"
CHUNK_SCHEMA = RECORD_FIELDS + ", chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean, intact boolean"

SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.payload_bytes >= 1000 AND p.payload_digest = o.payload_digest
"""


def revisits(df: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(k, h, original): the rows whose payload of at least ``least`` bytes also stands at a larger key, and the largest such key.

    Only digests are shuffled. Keys that are null follow any other key of their payload.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    large = settle(df.select(F.col(f"`{key}`").alias("k"), body.alias("body")).where(F.octet_length("body") >= least)
                   .select("k", F.unhex(F.sha1("body")).alias("h")))
    originals = large.groupBy("h").agg(F.max("k").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    return settle(large.join(originals.select("h", "original"), "h").where("not k <=> original").select("k", "h", "original").distinct())


def chunk_rows(df: DataFrame, key: str, url: str, payload: str, least: int = LEAST_REVISIT, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``df``: record and target names, digest and length of the whole payload, chunk number
    and bytes. A revisit has one empty chunk. The chunks of a record follow one another in their partition."""
    def name(c: str):
        return F.when(F.col(c).isNull(), NO_KEY).otherwise(F.concat(F.lit(URN), F.url_encode(F.col(c).cast("string"))))

    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    pages = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("target_uri"), body.alias("body")).withColumn("digest", F.sha1("body"))
    found = revisits(df, key, payload, least)
    # Copies grow with the pages, so they meet them by a shuffle at every size.
    joined = pages.join(found.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.unhex("digest") == F.col("h")), "left")
    rows = joined.select(
        name("key").alias("record_id"), "target_uri", F.when(F.col("original").isNotNull(), name("original")).alias("refers_to"), "digest",
        F.octet_length("body").cast("long").alias("n_bytes"), F.when(F.col("original").isNull(), F.col("body")).otherwise(F.lit(b"")).alias("body"))
    parts = F.expr(f"transform(sequence(0, int((octet_length(body) - 1) div {chunk})), i -> substring(body, i * {chunk} + 1, {chunk}))")
    return rows.select("record_id", "target_uri", "refers_to", "digest", "n_bytes", F.posexplode(parts).alias("chunk_no", "data"))


def record_head(record: str, target: str | None, refers: str | None, digest: str, n_bytes: int, date: str) -> bytes:
    """The head of a record and the HTTP head that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {date}"]
    if target is not None:
        lines.append(f"WARC-Target-URI: {quote(target, safe=string.punctuation)}")
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if refers else n_bytes)}"]
    return "\r\n".join([*lines, "", http]).encode()


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT,
                   chunk: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row and return the settled list of archives (file, records, bytes).

    Each record is a gzip member of its own. ``folder`` must be one that all executors share; an archive that a lost
    or repeated task left there is not in the list and thus never read. A null payload is an empty one; texts are
    written in UTF-8, binary payloads as they are; of equal payloads of ``least`` bytes or more only that with the
    largest key is written out. Repeated keys give a record for each row (equal ones with the largest key are all
    written out), a null key the record name ``urn:no-page``. Other columns are not read. An empty table gives no archive.
    """
    end = b"\r\n\r\n"

    def run(batches):
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out = packer = name = None
        written = records = 0

        def put(data) -> None:
            nonlocal written
            packed = packer.compress(data)
            out.write(packed)
            written += len(packed)

        def finish_record() -> None:
            nonlocal written
            put(end)
            packed = packer.flush()
            out.write(packed)
            written += len(packed)

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "refers_to", "digest", "n_bytes", "chunk_no")))
            data = batch.column("data")
            for k, (record, target, refers, digest, n_bytes, number) in enumerate(heads):
                if number == 0:
                    if packer is not None:
                        finish_record()
                    if out is not None and written >= file_bytes:
                        yield listed()
                        out = None
                    if out is None:
                        name, written, records = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    records += 1
                    put(record_head(record, target, refers, digest, n_bytes, date))
                put(data[k].as_buffer())
        if packer is not None:
            finish_record()
            yield listed()

    return settle(chunk_rows(df, key, url, payload, least, chunk).mapInArrow(run, "file string, records long, bytes long"))


class Unpacked:
    """The bytes of an archive, plain or of gzip members, read piece by piece."""

    def __init__(self, stream, block: int = 1 << 16):
        self.stream, self.block, self.held, self.packed = stream, block, bytearray(), b""
        self.unpacker = None
        self.plain: bool | None = None

    def more(self) -> bool:
        """Hold a further piece; False at the end."""
        while True:
            raw = self.packed or self.stream.read(self.block)
            self.packed = b""
            if not raw:
                if self.unpacker is not None and not self.plain:
                    raise ValueError("the archive ends inside a gzip member")
                return False
            if self.plain is None:
                self.plain = raw[:2] != b"\x1f\x8b"
            if self.plain:
                self.held += raw
                return True
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            piece = self.unpacker.decompress(raw, self.block * 4)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, None
            if piece:
                self.held += piece
                return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end."""
        at, start = self.held.find(b"\n"), 0
        while at < 0:
            start = len(self.held)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends inside a line")
                return None
            at = self.held.find(b"\n", start)
        out = bytes(self.held[:at]).rstrip(b"\r")
        del self.held[: at + 1]
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes."""
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(lines) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _head(source: Unpacked) -> tuple[list[bytes], int]:
    """Lines up to an empty one, and the bytes that they took with two bytes for each line end."""
    lines, n = [], 0
    while line := source.line():
        lines.append(line)
        n += len(line) + 2
    if line is None:
        raise ValueError("the archive ends inside a head")
    return lines, n + 2


def read_records(source: Unpacked, chunk: int = CHUNK_BYTES):
    """The rows of CHUNK_SCHEMA of an archive's response, resource and revisit records, in their order."""
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = _fields(_head(source)[0])
        kind, rest, length = fields.get("warc-type"), int(fields["content-length"]), None
        if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http") and rest:
            lines, n = _head(source)
            rest -= n
            length = int(_fields(lines[1:]).get("content-length", -1))
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        declared = base64.b32decode(declared.upper()).hex() if len(declared) == 32 else declared.lower() or None
        own = (fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None)
        wanted = kind in ("response", "resource", "revisit")
        if kind == "revisit":
            yield (*own, 0, b"", length, declared, True, None)
        digest, seen, number = hashlib.sha1(), 0, 0
        while rest or not number:
            data = source.take(min(rest, chunk))
            rest -= len(data)
            seen += len(data)
            digest.update(data)
            if wanted and kind != "revisit":
                so_far = digest.copy().hexdigest()
                yield (*own, number, data, seen, so_far, not rest, None if rest else declared in (None, so_far))
            number += 1


def read_chunks(archives: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of archives (file, ...), an archive a task, in slices of bounded size.

    One row for each chunk of a record: its names, ``chunk_no`` from 0, ``data``, and ``payload_bytes`` and ``payload_digest``
    (lower-case hexadecimal SHA-1) of the payload up to there; ``last`` marks the row that has them for the whole payload
    and says whether the declared digest agrees (``intact``). A revisit is one row without data that carries the length and
    digest that its head declares. HTTP heads of responses are taken off; other kinds of records are passed over. A
    file that ends inside a record is an error. No archive gives no row.
    """
    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in read_records(Unpacked(stream), chunk):
                        rows.append(row)
                        held += len(row[5]) + 200
                        if held >= BATCH_BYTES:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    kinds = [pa.string()] * 4 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.select("file").repartition(max(1, archives.count())).mapInArrow(run, CHUNK_SCHEMA)


def records(archives: DataFrame, key: str = "page_id", kind: str = "long") -> DataFrame:
    """One row a record of archives by :func:`write_archives`: the key, payload_bytes, payload_digest, record_type,
    refers_to (the key of the record that has the payload, or null), target_uri and intact."""
    def named(c: str):
        return F.when(F.col(c).startswith(URN), F.url_decode(F.substring(c, len(URN) + 1, 1 << 30))).cast(kind)

    return read_chunks(archives).where("last").select(
        named("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"), "target_uri", "intact")
