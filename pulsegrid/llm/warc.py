"""WARC archives: a gzip member per record, and a sequential reader.

The reader inflates a file bit by bit, frames each record by its content length and verifies the digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, blocks, chunks, keyed, put_bytes, scratch, written

#: Bytes of records after which a new archive begins, and bytes that the reader inflates at a time.
ARCHIVE_BYTES, STEP = 32 << 20, 64 << 10
#: Stands for a null page id, below all others.
NO_PAGE = -(1 << 63)
#: The profile of revisit records, and the date of all records: archives of the same pages are the same bytes.
PROFILE, DATE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class WarcError(ValueError):
    """An archive that breaks the format: framing, a lacking header or a digest that doesn't hold."""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers.items()] + [f"Content-Length: {len(block)}".encode()]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def record_id(page_id: int | None, key: int) -> str:
    """The id of a page's record; no other record has it, as row keys differ."""
    return f"<urn:x-page:{'null' if page_id in (None, NO_PAGE) else page_id}:{key}>"


def page_of(name: str) -> tuple[int | None, int]:
    """The page id and row key of a record id."""
    *_, page, key = name.strip("<>").split(":")
    return None if page == "null" else int(page), int(key)


def page_record(page_id: int | None, key: int, url: str | None, payload: bytes, refers: tuple[int | None, int] | None, digest: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP headers only and the id of the response's record.

    Line breaks in a url are percent-escaped; a null url is the page's own name, as a record has to have a target.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, name = http if refers is not None else http + payload, record_id(page_id, key)
    target = name.strip("<>") if url is None else "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)
    headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response"}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1(block)}"}
    if refers is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*refers)}
    return member(headers, block)


def read_records(stream, step: int = STEP) -> Iterator[Record]:
    """The records of an archive, one gzip member after another; a member is inflated in steps and freed before the next."""
    raw, ended = b"", False
    while True:
        while not raw and not ended:
            raw = stream.read(step)
            ended = not raw
        if not raw:
            return
        inflate, head, body, length = zlib.decompressobj(31), bytearray(), bytearray(), None
        headers: dict[str, str] = {}
        while not inflate.eof:
            if not raw:
                raw = stream.read(step)
                if not raw:
                    raise WarcError("the archive ends inside a record")
            try:
                got = inflate.decompress(raw, step)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if length is None:
                head += got
                if (end := head.find(b"\r\n\r\n")) < 0:
                    continue
                version, *lines = head[:end].decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/1."):
                    raise WarcError(f"not a record: {version[:40]}")
                headers = dict(line.split(": ", 1) for line in lines)
                if not headers.get("Content-Length", "").isdigit():
                    raise WarcError("a record without a content length")
                length, got = int(headers["Content-Length"]), bytes(head[end + 4 :])
            body += got
        if length is None or len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise WarcError("a record whose length isn't its content length")
        block = bytes(memoryview(body)[:length])
        if headers.get("WARC-Block-Digest", "") not in ("", f"sha1:{sha1(block)}"):
            raise WarcError("a block whose digest doesn't hold")
        yield Record(headers, block)


def parsed(record: Record) -> tuple[int | None, int, int, str, str, int | None]:
    """(page_id, row key, payload bytes, payload digest, type, refers_to) of a page record; a response's payload is verified."""
    h = record.headers
    http, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or sha1(payload) != digest):
        raise WarcError("a payload whose digest doesn't hold")
    page, key = page_of(h["WARC-Record-ID"])
    return page, key, size, digest, h["WARC-Type"], page_of(h["WARC-Refers-To"])[0] if "WARC-Refers-To" in h else None


def digests(pages: DataFrame) -> DataFrame:
    """(digest, n, page, key, pages, keys) of each payload and stretch of pages, page and key those of its largest, so a frequent payload is a few rows."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1, 8 << 20):
                found: dict[str, list[tuple[int, int]]] = {}
                for page, html, key in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found.setdefault(sha1(html.encode("utf-8")), []).append((page, -key))
                best = [max(x) for x in found.values()]
                yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array([b[0] for b in best], pa.int64()), pa.array([-b[1] for b in best], pa.int64()), pa.array([[p for p, _ in x] for x in found.values()], pa.list_(pa.int64())), pa.array([[-k for _, k in x] for x in found.values()], pa.list_(pa.int64()))], names=["digest", "n", "page", "key", "pages", "keys"])

    return pages.select("page", "html", KEY).mapInArrow(run, "digest string, n long, page long, key long, pages array<long>, keys array<long>")


def write_warc(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page to archives in ``path``, sorted by page id; the stored manifest (file, n_records, n_bytes).

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page id (a null id is the smallest; of equal
    ids the first row) is the response; the others are revisits, which refer to its record's id. A null html is an empty payload; a
    null url becomes the page's own name. Where all ids of a group are null, its revisits refer to a record without a page id. An
    empty table gives no archive. Other columns are ignored. A page has to fit into a worker's memory, not a group of equal ones.
    """
    df = pages if KEY in pages.columns else keyed(pages)
    page = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_PAGE))
    df = df.select(page.alias("page"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), KEY, F.col(f"`{url_col}`").alias("url"))
    groups = written(digests(df), "warc-digests")
    top = groups.groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("page", (-F.col("key")).alias("low"))).alias("top")).where("all > 1")
    links = groups.select("digest", "pages", "keys").join(top, "digest").select(F.explode(F.arrays_zip("pages", "keys")).alias("r"), "top")
    links = links.where(F.col("r.keys") != -F.col("top.low")).select(F.col("r.pages").alias("page"), F.lit(None).cast("string").alias("html"), F.col("r.keys").alias(KEY), F.lit(None).cast("string").alias("url"), F.col("top.page").alias("to"), (-F.col("top.low")).alias("to_key"))

    def run(batches: Iterator[pa.RecordBatch]):
        part, linked = TaskContext.get().partitionId(), {}
        for seq, block in enumerate(blocks(batches, 1, ARCHIVE_BYTES)):
            out, n = io.BytesIO(), 0
            for rows in block.to_batches(max_chunksize=500):
                for page, html, key, url, to, to_key in zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True):
                    if html is None:
                        linked = {key: (to, to_key)}  # its page is the next row
                        continue
                    payload = html.encode("utf-8")
                    out.write(page_record(page, key, url, payload, linked.get(key) if len(payload) >= least else None, sha1(payload)))
                    n += 1
            if n:
                file = f"{path}/pages-{part:06d}-{seq:05d}.warc.gz"
                put_bytes(file, out.getvalue())
                yield pa.record_batch([pa.array([file]), pa.array([n], pa.int64()), pa.array([out.tell()], pa.int64())], names=["file", "n_records", "n_bytes"])

    # A link comes to its page by the same sort, not by a join, so the html is shuffled once.
    rows = df.withColumn("to", F.lit(None).cast("long")).withColumn("to_key", F.lit(None).cast("long")).union(links)
    rows = rows.repartitionByRange("page").sortWithinPartitions("page", KEY, F.col("html").isNotNull())
    return written(rows.mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the archives that ``manifest`` lists."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(file)
                rows = []
                with store.open_input_stream(at, compression=None) as stream:
                    for record in read_records(stream):
                        rows.append(parsed(record))
                page, _, size, digest, kind, to = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(to, pa.int64())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    return read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), **columns))
