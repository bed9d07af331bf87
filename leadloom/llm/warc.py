"""WARC archives: writing, de-duplication by revisit records, and a sequential reader.

``archives`` turns rows of pages into archives of about ``ARCHIVE_BYTES``, each a run of records with one gzip
member per record. ``read_archives`` reads them back: incremental decompression member by member,
content-length framing, and verification of block and payload digests. ``records`` is the reader itself and
takes any iterable of byte chunks, so it also reads archive files.

Null html counts as an empty payload, a null url gives a record without a target, a null id an empty record
name. Of rows that repeat both the largest id of their group and its payload, all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed
from leadloom.sizing import bounded_broadcast

ARCHIVE_BYTES = 1 << 20
#: Shorter payloads are never replaced by a revisit.
LEAST_REVISIT_BYTES = 1000
GZIP = 31
CHUNK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
SHOWN = "".join(chr(c) for c in range(33, 127))


class Record(NamedTuple):
    headers: dict[str, str]
    payload_bytes: int
    payload_sha1: bytes
    payload: bytes | None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(name: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit (without the payload) if it refers to another record."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(sha1)}", f"WARC-Block-Digest: {_digest(hashlib.sha1(block).digest())}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SHOWN)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress("\r\n".join(lines).encode() + END + block + END) + packer.flush()


class _Member:
    """The decompressed bytes of one gzip member, taken as they come."""

    def __init__(self, first: bytes, chunks: Iterator[bytes]) -> None:
        self.inflate, self.chunks = zlib.decompressobj(GZIP), chunks
        self.packed, self.buffer = first, bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        packed = self.inflate.unconsumed_tail or self.packed or next(self.chunks, b"")
        if packed is self.packed:
            self.packed = b""
        if not packed:
            raise ValueError("the archive ends within a record")
        self.buffer += self.inflate.decompress(packed, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                raise ValueError("a header block does not end")
        head = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise ValueError("a record is shorter than its content length")
            part = bytes(self.buffer[:size])
            del self.buffer[:len(part)]
            size -= len(part)
            if part:
                yield part

    def rest(self) -> tuple[bytes, bytes]:
        """What is left of the member, and the packed bytes after it."""
        while self._more():
            pass
        return bytes(self.buffer), self.inflate.unused_data + self.packed


def records(chunks: Iterable[bytes], keep_payload: bool = True) -> Iterator[Record]:
    """Every record of an archive in order; raises ValueError on broken framing or a wrong digest."""
    chunks = iter(chunks)
    packed = b""
    while packed or (packed := next(chunks, b"")):
        member = _Member(packed, chunks)
        version, *lines = member.until(END).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield _body(member, headers, keep_payload)
        tail, packed = member.rest()
        if tail != END:
            raise ValueError("a record is longer than its content length")


def _body(member: _Member, headers: dict[str, str], keep_payload: bool) -> Record:
    block_sha, payload_sha = hashlib.sha1(), hashlib.sha1()
    kept, size, http, pending = [], 0, None, b""
    for part in member.take(int(headers["content-length"])):
        block_sha.update(part)
        if http is None:
            pending += part
            head, found, part = pending.partition(END)
            if not found:
                continue
            http = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])
        payload_sha.update(part)
        size += len(part)
        if keep_payload:
            kept.append(part)
    if headers.get("warc-block-digest", _digest(block_sha.digest())) != _digest(block_sha.digest()):
        raise ValueError(f"wrong block digest in {headers.get('warc-record-id')}")
    told = headers.get("warc-payload-digest")
    if headers["warc-type"] == "revisit":  # its own payload is absent; its head tells of the one it refers to
        return Record(headers, int(http[b"content-length"]), base64.b32decode(told.partition(":")[2]), None)
    if told is not None and told != _digest(payload_sha.digest()):
        raise ValueError(f"wrong payload digest in {headers.get('warc-record-id')}")
    return Record(headers, size, payload_sha.digest(), b"".join(kept) if keep_payload else None)


def with_revisits(
    df: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = LEAST_REVISIT_BYTES
) -> DataFrame:
    """The wanted columns and ``_refers_to``: the id of the response whose payload a row repeats, else null.

    The digest groups are reduced before the pages are joined to them, and only groups of several rows remain.
    """
    keyed = df.withColumn("_bytes", F.octet_length(F.coalesce(F.col(html_col), F.lit(""))))
    keyed = keyed.withColumn("_sha1", F.sha1(F.coalesce(F.col(html_col), F.lit(""))))
    groups = (
        keyed.filter(F.col("_bytes") >= least_bytes).groupBy("_sha1", "_bytes")
        .agg(F.max(id_col).alias("_keeper"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    joined = keyed.join(bounded_broadcast(checkpointed(groups)), ["_sha1", "_bytes"], "left")
    repeat = F.col("_keeper").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_keeper"))
    return joined.withColumn("_refers_to", F.when(repeat, F.col("_keeper"))).drop("_keeper", "_sha1", "_bytes")


def archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per archive: (records, content). Rows may carry ``_refers_to`` from ``with_revisits``."""
    refers = F.col("_refers_to") if "_refers_to" in df.columns else F.lit(None)
    rows = df.select(
        F.col(id_col).cast("string"), F.col(url_col), F.col(html_col).cast("binary"), refers.cast("string").alias("_r")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, keeper = (c[k].as_py() for c in batch.columns)
                held.append(record(_name(page), url, html or b"", None if keeper is None else _name(keeper)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(held)
                    held, size = [], 0
        if held:
            yield _archive(held)

    return rows.mapInArrow(run, "records int, content binary")


def _name(page: str | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _archive(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["records", "content"]
    )


def read_archives(df: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Every record of a frame of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    and the payload if wanted (null for a revisit)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                chunks = (data.slice(a, min(CHUNK, data.size - a)).to_pybytes() for a in range(0, data.size, CHUNK))
                rows = [
                    (
                        _page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.payload_bytes,
                        r.payload_sha1.hex(), r.kind, _page(r.headers.get("warc-refers-to")), r.payload,
                    )
                    for r in records(chunks, keep_payload)
                ]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns[:len(names)], names=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return df.select("content").mapInArrow(run, schema + ", payload binary" * keep_payload)


def _page(name: str | None) -> str | None:
    return (name or "").strip("<>").removeprefix("urn:page:") or None


def written_and_read(df: DataFrame) -> DataFrame:
    """Write a record per page, keep the archives in the shared folder, read them back."""
    return read_archives(checkpointed(archives(with_revisits(df.select("page_id", "url", "html")))))
