"""WARC archives as tables of record chunks (operator 1).

A page becomes rows of (record, chunk number, bytes), so that neither writer nor reader ever
holds a whole record: the writer streams a partition's chunks through a running SHA-1 and a
running gzip member, the reader streams members back into chunk rows that carry the digest
so far. Of records with equal payloads of REVISIT_FROM bytes or more the one with the
largest page_id is the response; the others are written as revisits without payload.

Defined results: a null html is an empty payload, a null url becomes urn:page:<id>; rows
with a null page_id are responses and are never referred to; repeated rows of one page_id
and payload share their record type; an empty table gives archives without records; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .files import open_read, open_write

CHUNK = 1 << 20
REVISIT_FROM = 1000
#: Readers take up an archive at blocks of about so many compressed bytes.
BLOCK = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
BLOCKS = "file string, start long, stop long, records long"
ROWS = "page_id long, record_type string, refers_to long, payload_bytes long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def record_chunks(pages: DataFrame, chunk_bytes: int = CHUNK, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """One row for each chunk of each record, chunks of a record in turn; revisits have one
    empty chunk. Equal payloads are found by digest and length on slim rows; each payload is
    moved once, by page_id, so a payload that many pages share lands in no single task."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    slim = own.where(F.col("n") >= revisit_from).select("page_id", "digest", "n")
    twins = slim.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = slim.join(twins, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    records = own.join(later, ["page_id", "digest"], "left")
    chunks = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes))).cast("int")
    rows = records.withColumn("chunks", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page_id", "url", "digest", "n", "refers_to", "chunks", "chunk_no", data.alias("data"))


def _head(page_id: int | None, spare: str, url: str | None, digest: str, n: int, refers_to: int | None) -> bytes:
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:page:null:{spare}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}"]
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n if refers_to is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"  # only attempts that commit their blocks are ever read
        blocks: list[tuple[str, int, int, int]] = []
        out, at, begun, records, spare = None, 0, 0, 0, 0
        sha, member, left = hashlib.sha1(), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = open_write(name)
                if row["chunk_no"] == 0:
                    spare += 1
                    member, sha, left = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1(), row["chunks"]
                    at += out.write(member.compress(_head(row["page_id"], f"{task.partitionId()}-{spare}", row["url"], row["digest"], row["n"], row["refers_to"])))
                sha.update(row["data"])
                at += out.write(member.compress(row["data"]))
                left -= 1
                if row["chunk_no"] == row["chunks"] - 1:
                    if left or row["refers_to"] is None and sha.hexdigest() != row["digest"]:
                        raise ValueError(f"chunks of page {row['page_id']} are not whole or not in turn")
                    at += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
                    if at - begun >= BLOCK:
                        blocks.append((name, begun, at, records))
                        begun, records = at, 0
        if out is not None:
            out.close()
        if records:
            blocks.append((name, begun, at, records))
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.string()), *(pa.array([b[i] for b in blocks], pa.int64()) for i in (1, 2, 3))], ["file", "start", "stop", "records"])

    return run


def write_archives(pages: DataFrame, path: str, **how) -> DataFrame:
    """Writes path/part-*.warc.gz and returns their blocks (BLOCKS), a table in the shared
    folder. An archive of a task that failed or was repeated has no block and is not read."""
    blocks, _ = written(record_chunks(pages, **how).mapInArrow(_writer(path), BLOCKS), "warc-blocks")
    return blocks


class _Inflated:
    """The decompressed bytes of gzip members in [start, stop) of a file, a bit at a time."""

    STEP = 1 << 18

    def __init__(self, file, start: int, stop: int):
        self.file, self.left, self.buffer, self.raw = file, stop - start, bytearray(), b""
        file.seek(start)
        self.member = zlib.decompressobj(31)

    def fill(self) -> bool:
        """At most STEP more bytes of content; False at the end."""
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.raw:
                if not self.left:
                    return False
                self.raw = self.file.read(min(self.STEP, self.left))
                self.left -= len(self.raw)
            got = self.member.decompress(self.raw, self.STEP)
            self.raw = self.member.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        at = 0
        while (i := self.buffer.find(b"\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 1)
            if not self.fill():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise EOFError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _headers(source: _Inflated) -> dict[str, str]:
    out = {}
    while line := source.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _page(name: str) -> int | None:
    tail = name.strip("<>").removeprefix("urn:page:")
    return None if tail.startswith("null") else int(tail)


def _records(source: _Inflated, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """ROWS of one block."""
    while (first := source.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {first[:40]!r}")
        head = _headers(source)
        size, kind = int(head["content-length"]), head["warc-type"]
        if kind not in ("response", "revisit"):
            for at in range(0, size, chunk_bytes):
                source.take(min(chunk_bytes, size - at))
            continue
        page, refers = _page(head["warc-record-id"]), _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        status = source.line()
        http = _headers(source)
        n = int(http["content-length"])
        if kind == "revisit":
            yield page, kind, refers, n, 0, b"" if with_data else None, n, digest, True
            continue
        sha, chunk = hashlib.sha1(), 0
        if not status.startswith(b"HTTP/"):
            raise ValueError(f"page {page} holds no HTTP response")
        while True:
            data = source.take(min(chunk_bytes, n - chunk * chunk_bytes))
            sha.update(data)
            seen = chunk * chunk_bytes + len(data)
            if seen == n and sha.hexdigest() != digest:
                raise ValueError(f"the payload of page {page} does not match its digest")
            yield page, kind, None, n, chunk, data if with_data else None, seen, sha.hexdigest(), seen == n
            chunk += 1
            if seen == n:
                break


def read_archives(blocks: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """ROWS of all records in the blocks. bytes_so_far and digest_so_far cover the payload up
    to and with the row's chunk; the last chunk's are those of the whole payload, which for
    revisits come from the record's headers."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for block in batch.to_pylist():
                with open_read(block["file"]) as file:
                    rows, held, records = [], 0, 0
                    for row in _records(_Inflated(file, block["start"], block["stop"]), chunk_bytes, with_data):
                        rows.append(row)
                        records += row[-1]
                        held += len(row[5] or b"") + 100
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if records != block["records"]:
                        raise ValueError(f"{block['file']} has {records} records in a block of {block['records']}")
                    yield batch_of(rows)

    return blocks.repartition(max(1, blocks.count())).mapInArrow(run, ROWS)
