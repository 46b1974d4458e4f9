"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk_no, data), none longer than CHUNK bytes, and is written
and read chunk by chunk with incremental digests, so no step holds a whole record outside the row
that it came in. Archives are gzip files with one member per record, in the shared folder; a task
that is run again writes a new file, and only files that the manifest names are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, scratch, small

CHUNK = 1 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "page_id long, url string, rec long, chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"
RECORDS = "archive string, record_no long, record_type string, page_id long, refers_to long, uri string, declared_digest string, chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"


def _digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value, not copied; null as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    for x in column:
        held = x.as_buffer()
        yield memoryview(held) if held is not None else memoryview(b"")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests = [], []
        for view in _views(b.column("html")):
            sha = hashlib.sha1()
            for at in range(0, len(view), CHUNK):
                sha.update(view[at : at + CHUNK])
            sizes.append(len(view))
            digests.append(_digest(sha))
        yield pa.record_batch([b.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["page_id", "payload_bytes", "payload_digest"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("rec", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
    for b in batches:
        out: list[tuple] = []
        held = 0
        for i, view in enumerate(_views(b.column("html"))):
            sha = hashlib.sha1()
            for at in range(0, len(view), CHUNK):
                sha.update(view[at : at + CHUNK])
            digest, n = _digest(sha), max(1, -(-len(view) // CHUNK))
            page, url = b.column("page_id")[i].as_py(), b.column("url")[i].as_py()
            for k in range(n):
                data = bytes(view[k * CHUNK : (k + 1) * CHUNK])
                out.append((page, url, (part << 40) + done, k, k == n - 1, len(view), digest, data))
                held += len(data)
                if held >= 8 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, held = [], 0
            done += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _name(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, digest)}>"


def _fields(pairs: list[tuple[str, str | int]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


class _Archive:
    """A gzip file of records, each a member of its own."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.out, self.records, self.size = files.open_output_stream(f"{path}/{self.uri.rsplit('/', 1)[1]}", compression=None), 0, 0
        info = b"software: scoreloom\r\nformat: WARC File Format 1.1\r\n"
        self.start()
        self.write(_fields([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
        self.end()

    def start(self) -> None:
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.packer.compress(data))

    def end(self) -> None:
        self._put(self.packer.flush())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.size


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, closed = None, []
        for b in batches:
            names = b.schema.names
            for page, url, _, chunk_no, last, size, digest, data, refers in zip(*(b.column(names.index(x)).to_pylist() for x in ("page_id", "url", "rec", "chunk_no", "last", "payload_bytes", "payload_digest", "data", "refers_to"))):
                if archive is None:
                    archive = _Archive(folder)
                if chunk_no == 0 or refers is not None:
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    head = [("WARC-Type", "revisit" if refers is not None else "response"), ("WARC-Date", DATE), ("WARC-Record-ID", _name(page, digest)), ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:x-page:{page}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                    if refers is not None:
                        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers, digest))]
                    archive.start()
                    archive.write(_fields([*head, ("Content-Length", len(http) + (size if refers is None else 0))]) + http)
                if refers is None:
                    archive.write(data)
                if last:
                    archive.write(b"\r\n\r\n")
                    archive.end()
                    archive.records += 1
                    if archive.size >= ARCHIVE_BYTES:
                        closed.append(archive.close())
                        archive = None
        if archive is not None:
            closed.append(archive.close())
        if closed:
            yield pa.record_batch([pa.array(c) for c in zip(*closed)], ["archive", "records", "bytes"])

    return write


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as rows of at most CHUNK payload bytes each, with the size and digest of the whole payload."""
    bare = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return bare.mapInArrow(_chunked, CHUNKS)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write WARC archives; return their manifest: archive, records, bytes.

    Of records with equal payloads of at least least_bytes, that with the smallest page id is the
    response and the others are revisits of it; rows that repeat the smallest id are all responses, and
    so are rows without an id. A null payload counts as empty. A missing URL becomes a URN of the page id. An empty
    table gives no archive. Other columns are ignored.
    """
    sized = pick(pages, page_id=id_col, html=html_col).mapInArrow(_sized, f"page_id {dict(pages.dtypes)[id_col]}, payload_bytes long, payload_digest string")
    firsts = cut(sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").cast("long").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("of"), "first_id"))
    firsts = small(firsts)
    chunks = chunk_table(pages, id_col, url_col, html_col)
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    roles = chunks.join(firsts, chunks.payload_digest == firsts["of"], "left").withColumn("refers_to", refers).drop("of", "first_id")
    roles = roles.where("refers_to IS NULL OR last").withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")))
    return cut(roles.sortWithinPartitions("rec", "chunk_no").mapInArrow(_writer(folder), "archive string, records long, bytes long"))


class _Stream:
    """Bytes of a gzip file of many members, read a part at a time."""

    def __init__(self, source):
        self.source, self.held, self.unpacker, self.over = source, bytearray(), zlib.decompressobj(31), False

    def _fill(self) -> None:
        raw = self.unpacker.unused_data if self.unpacker.eof else b""
        if self.unpacker.eof:
            self.unpacker = zlib.decompressobj(31)
        raw = self.unpacker.unconsumed_tail or raw or self.source.read(1 << 16)
        if not raw:
            self.over = True
            return
        self.held += self.unpacker.decompress(raw, 1 << 18)

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark; empty at the end of the file."""
        while (at := self.held.find(mark)) < 0 and not self.over:
            self._fill()
        out = bytes(self.held[: at + len(mark)]) if at >= 0 else b""
        del self.held[: len(out)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and not self.over:
            self._fill()
        out = bytes(self.held[:n])
        del self.held[:n]
        if len(out) < n:
            raise ValueError("the archive ends within a record")
        return out


def _page(name: str | None) -> int | None:
    return int(name[len("<urn:x-page:") : -1]) if name and name.startswith("<urn:x-page:") else None


def _records(uri: str, with_data: bool) -> Iterator[tuple]:
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as source:
        stream, number = _Stream(source), 0
        while head := stream.until(b"\r\n\r\n"):
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
            left, kind = int(fields["Content-Length"]), fields["WARC-Type"]
            if kind in ("response", "revisit"):
                left -= len(stream.until(b"\r\n\r\n"))
            sha, size, k = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(left, CHUNK))
                left -= len(data)
                size += len(data)
                sha.update(data)
                if kind in ("response", "revisit"):
                    whole = kind == "response" and not left
                    yield uri, number, kind, _page(fields["WARC-Record-ID"]), _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), k, not left, size if kind == "response" else None, _digest(sha) if whole else None, data if with_data else None
                k += 1
                if not left:
                    break
            stream.take(4)
            number += kind in ("response", "revisit")


def _reader(with_data: bool):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("archive").to_pylist():
                out, held = [], 0
                for row in _records(uri, with_data):
                    out.append(row)
                    held += len(row[-1] or b"")
                    if held >= 8 * CHUNK or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return read


def read_archives(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that a manifest names: a row per record and chunk.

    payload_bytes runs along the chunks; payload_digest is that of the bytes read and stands in the last chunk of a
    response. A revisit is one chunk without payload. with_data=False leaves the bytes out once they are digested.
    """
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(_reader(with_data), RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; of a revisit, those of the response it refers to."""
    ends = cut(records.where("last").select("page_id", "payload_bytes", "payload_digest", "declared_digest", "record_type", "refers_to"))
    whole = ends.where("record_type = 'response'")
    named = whole.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("sha")).agg(F.max("payload_bytes").alias("size"))
    revisits = ends.where("record_type = 'revisit'").select("page_id", "declared_digest", "record_type", "refers_to")
    found = revisits.join(named, (revisits.refers_to == named["of"]) & (revisits.declared_digest == named["sha"]), "left")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(found.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to"))


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back and resolve the revisits."""
    return resolved(read_archives(write_archives(pages, folder or scratch(pages.sparkSession, "warc")), with_data=False))
