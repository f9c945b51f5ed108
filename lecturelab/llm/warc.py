"""WARC archives as a table of chunks.

Writing: pages with equal payloads of at least `MIN_REVISIT` bytes are one response and revisits of it. Each task streams
its records into one archive in the shared folder, every record a gzip member, and reports the archive's name; only
reported archives are read, so a lost or repeated task leaves nothing behind that counts.

Reading: each archive is streamed in blocks. A record comes out as rows of at most `chunk_bytes` payload bytes, numbered
from 0, each with the bytes and the digest of the payload up to its end; so a record of any size takes one chunk of
memory, and its last row holds the whole payload's length and digest.

Archives go through pyarrow's file systems, which reach local, HDFS and object-store folders by their addresses.

Edge cases: null html is an empty payload, one chunk of no bytes; payloads below the limit are always responses; a null
url is left out of the record, a null id too, and of pages without an id none refers to another; rows that repeat a
page and its payload are responses both if the first of them is; payloads may hold anything, blank lines and record
headers included, since only lengths part records; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import materialise, scratch_path

MIN_REVISIT = 100
CHUNK_BYTES = 1 << 18
_READ = 1 << 18
_BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

CHUNKS = (
    "archive string, record_no long, record_id string, record_type string, page_id long, url string, refers_to long, "
    "declared_digest string, declared_bytes long, chunk_no long, payload binary, payload_bytes long, payload_digest string, last boolean")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """Up to and with the blank line; `size` is the payload's."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    length = len(HTTP) + (0 if revisit else size)
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass")


def marked(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id`, `url`, `html`, `digest`, `size`, `refers_to` (null: a response)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    whole = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    ids = whole.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only payloads that come more than once have anything to refer to; a hot one is split by the join
    copies = ids.where("n > 1").select(F.col("digest").alias("_d"), "first")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return whole.join(copies, F.col("digest") == F.col("_d"), "left").select("page_id", "url", "html", "digest", "size", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One archive per task under `folder`; a stored table of `archive` and `n_records`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            payloads = batch.column("html").cast(pa.binary())
            rest = batch.select(["page_id", "url", "digest", "size", "refers_to"]).to_pylist()
            for i, r in enumerate(rest):
                if sink is None:
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path, compression=None)  # records are packed one by one
                revisit = r["refers_to"] is not None
                packed = zlib.compressobj(1, wbits=31)
                sink.write(packed.compress(record_header(r["page_id"], r["url"], r["digest"], r["size"], r["refers_to"], revisit) + HTTP))
                if not revisit:
                    data = memoryview(payloads[i].as_buffer())
                    for at in range(0, len(data), _READ):
                        sink.write(packed.compress(data[at: at + _READ]))
                sink.write(packed.compress(b"\r\n\r\n") + packed.flush())
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})

    return materialise(records.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(write, "archive string, n_records long"), "archives")


class _Members:
    """Bytes of a file of gzip members (or of a plain file), a bounded part at a time."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.held, self.unpack, self.raw, self.plain = stream, b"", None, b"", None

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(_READ)
                if not self.raw:
                    return False
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                self.held, self.raw = self.held + self.raw, b""
                return True
            self.unpack = self.unpack or zlib.decompressobj(wbits=31)
            out = self.unpack.decompress(self.raw, _READ)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.unpack = None
            if out:
                self.held += out
                return True

    def some(self, n: int) -> bytes:
        """Between 1 and n bytes; none at the end."""
        if not self.held and not self._more():
            return b""
        out, self.held = self.held[:n], self.held[n:]
        return out

    def line(self) -> bytes | None:
        """Up to the next line end; None at the end of the file."""
        while (at := self.held.find(b"\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a header")
                return None
        out, self.held = self.held[: at + 1], self.held[at + 1:]
        return out.rstrip(b"\r\n")


def chunks(stream: pa.NativeFile, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of an archive, in order."""
    source, number = _Members(stream), 0
    while True:
        line = source.line()
        while line == b"":
            line = source.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while line := source.line():
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := source.line()) is not None:
                left -= len(line) + 2
                if not line:
                    break
        page, refers = head.get("x-page"), head.get("x-refers-to-page")
        row = {
            "record_no": number, "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
            "page_id": None if page is None else int(page), "url": head.get("warc-target-uri"), "refers_to": None if refers is None else int(refers),
            "declared_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "declared_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None}
        digest, seen, k = hashlib.sha256(), 0, 0
        while True:
            parts, room = [], min(chunk_bytes, left)
            while room:
                part = source.some(room)
                if not part:
                    raise ValueError("archive ends inside a record")
                digest.update(part)
                parts.append(part)
                room -= len(part)
            data = b"".join(parts)
            left, seen = left - len(data), seen + len(data)
            yield row | {"chunk_no": k, "payload": data, "payload_bytes": seen, "payload_digest": digest.hexdigest(), "last": left == 0}
            k += 1
            if left == 0:
                break
        number += 1


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives named in `archive`."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(CHUNKS)]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    shape = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in StructType.fromDDL(CHUNKS)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                system, path = _open(archive)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in chunks(stream, chunk_bytes):
                        rows.append({"archive": archive, **row})
                        size += len(row["payload"]) + 1000
                        if size >= _BATCH:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    return archives.select("archive").mapInArrow(read, CHUNKS).select(*names)


def records(table: DataFrame) -> DataFrame:
    """One row per record: a response's own length and digest from its last chunk, a revisit's as declared."""
    again = F.col("record_type") == "revisit"
    return table.where("last").select(
        "page_id", F.when(again, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to", "url", (F.col("chunk_no") + 1).alias("n_chunks"),
        (again | (F.col("payload_digest") == F.col("declared_digest"))).alias("intact"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back."""
    archives = write_archives(marked(pages, key, url, html), scratch_path(pages.sparkSession, "warc"))
    # one archive to a task
    spread = archives.repartition(max(1, archives.count()), "archive")
    return records(read_chunks(spread))


def oracle() -> str:
    """What a round trip gives back, as SQL for DuckDB."""
    return f"""
with sized as (select page_id, url, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
firsts as (select digest, min(page_id) as first from sized where n >= {MIN_REVISIT} group by 1),
placed as (select s.*, case when page_id > first then first end as refers_to from sized s left join firsts using (digest))
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, url,
    case when refers_to is null then greatest(1, ceil(n / {CHUNK_BYTES}.0)) else 1 end::bigint as n_chunks, true as intact from placed"""
