"""Zip archives as rows of members; nothing is extracted but what is safe."""

from __future__ import annotations

import io
import stat
import urllib.request
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive's members together, and of a member in times of its packed size, at most.
MOST_BYTES, MOST_RATIO = 8 << 30, 200
#: Beginnings of members that are left out.
SKIPPED = ("__MACOSX/",)


def safe_path(name: str) -> bool:
    """Whether a member's name stays below the folder that it is extracted to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and "\0" not in name and not name.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts


def members(data: bytes, most: int = MOST_BYTES, ratio: int = MOST_RATIO) -> Iterator[tuple[str, str, int, int, bytes | None]]:
    """(member, status, size, crc32, content) of each member; only one that is ok has content.

    Status: ok, directory, skipped, symlink, unsafe_path, too_large (for the archive's limit, or packed too well) or damaged (a checksum
    or size that doesn't hold). What isn't an archive is one row without a name.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield "", "damaged", 0, 0, None
        return
    total = 0
    with archive:
        for info in archive.infolist():
            total += info.file_size
            content = None
            if info.filename.startswith(SKIPPED):
                status = "skipped"
            elif not safe_path(info.filename):
                status = "unsafe_path"
            elif stat.S_ISLNK(info.external_attr >> 16):
                status = "symlink"
            elif info.is_dir():
                status = "directory"
            elif total > most or info.file_size > ratio * max(info.compress_size, 64):
                status = "too_large"
            else:
                try:
                    content = archive.read(info)
                    status = "ok" if len(content) == info.file_size else "damaged"
                except (zipfile.BadZipFile, EOFError, ValueError, NotImplementedError, RuntimeError, OSError):
                    status = "damaged"
            yield info.filename, status, info.file_size, info.CRC, content if status == "ok" else None


def read_archives(spark: SparkSession, path: str, most: int = MOST_BYTES, ratio: int = MOST_RATIO) -> DataFrame:
    """(path, member, status, size, crc32, content) of all zip files below a folder; an archive has to fit into a worker's memory, its members one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, status, size, crc, content in members(data, most, ratio):
                    yield pa.record_batch([pa.array([at]), pa.array([name]), pa.array([status]), pa.array([size], pa.int64()), pa.array([crc], pa.int64()), pa.array([content], pa.binary())], names=["path", "member", "status", "size", "crc32", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, status string, size long, crc32 long, content binary")


def _put(uri: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(uri)
    target = f"{base}/{name}"
    store.create_dir(target.rpartition("/")[0], recursive=True)
    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, target)


def extract(found: DataFrame, root: str) -> int:
    """Writes the members of ``found`` (of ``read_archives``) that are ok below ``root``; their number. Executors write; a repeated task writes the same."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                _put(root, r.member, bytes(r.content))
            yield pd.DataFrame({"n": [len(pdf)]})

    counts = found.where("status = 'ok'").select("member", "content").mapInPandas(run, "n long").groupBy().sum("n").first()[0]
    return counts or 0


def write_archives(df: DataFrame, name: str, texts: str, root: str) -> None:
    """A zip file per row, named by one column, with a member for each text of another, and one of each kind that must not be extracted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at, held in zip(pdf[name], pdf[texts], strict=True):
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                    for text in held:
                        z.writestr(zipfile.ZipInfo(f"{text}.txt"), text)
                    for odd in ("../up.txt", "/root.txt", "a/../../b.txt", "__MACOSX/x"):
                        z.writestr(zipfile.ZipInfo(odd), "x")
                    link = zipfile.ZipInfo("link")
                    link.external_attr = (stat.S_IFLNK | 0o777) << 16
                    z.writestr(link, "x")
                    z.writestr(zipfile.ZipInfo("dir/"), "")
                _put(root, f"{at}.zip", sink.getvalue())
            yield pd.DataFrame({"n": [len(pdf)]})

    df.select(name, texts).mapInPandas(run, "n long").groupBy().sum("n").first()


#: Bytes that are read from a remote archive, or copied, at a time.
RANGE = 1 << 20


class RangeFile(io.RawIOBase):
    """A remote file whose server answers range requests, as a file to read and seek in.

    ``fetched`` counts the bytes that came; ``failure`` is the last error of the connection, which zip readers take for a damaged archive.
    """

    def __init__(self, url: str, timeout: float = 60):
        super().__init__()
        self.url, self.timeout, self.at, self.fetched, self.failure = url, timeout, 0, 0, None
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            self.size = int(r.headers["Content-Length"])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        asked = urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{self.at + n - 1}"})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as r:
                if r.status != 206:
                    raise OSError(f"{self.url}: the server sends no ranges")
                data = r.read(n)
        except OSError as e:
            self.failure = e
            raise
        buffer[: len(data)] = data
        self.at, self.fetched = self.at + len(data), self.fetched + len(data)
        return len(data)


def _same(uri: str, info: zipfile.ZipInfo) -> bool:
    """Whether a file is there with a member's size and checksum."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    there = store.get_file_info(path)
    if there.type != fs.FileType.File or there.size != info.file_size:
        return False
    crc = 0
    with store.open_input_stream(path) as f:
        while block := f.read(RANGE):
            crc = zlib.crc32(block, crc)
    return crc == info.CRC


def fetch_member(url: str, member: str, target: str, most: int = MOST_BYTES, ratio: int = MOST_RATIO) -> tuple[str, int, int]:
    """(status, size, bytes fetched): copies one member of a remote zip to ``target`` by range requests, checked against the archive's directory.

    Status: fetched, present (the target has that content already), missing, symlink, directory, too_large, or damaged, which leaves no
    target. Other members' bytes aren't fetched; the member is copied in blocks and moved into place when it is whole.
    """
    from pyarrow import fs

    remote = RangeFile(url)
    try:
        with zipfile.ZipFile(io.BufferedReader(remote, RANGE)) as archive:
            info = archive.NameToInfo.get(member)
            if info is None:
                return "missing", 0, remote.fetched
            if stat.S_ISLNK(info.external_attr >> 16) or info.is_dir():
                return "directory" if info.is_dir() else "symlink", info.file_size, remote.fetched
            if info.file_size > most or info.file_size > ratio * max(info.compress_size, 64):
                return "too_large", info.file_size, remote.fetched
            if _same(target, info):
                return "present", info.file_size, remote.fetched
            store, path = fs.FileSystem.from_uri(target)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            part, n = f"{path}.{uuid.uuid4().hex[:8]}.part", 0
            try:
                with archive.open(info) as source, store.open_output_stream(part) as out:
                    while block := source.read(RANGE):
                        out.write(block)
                        n += len(block)
                if n != info.file_size:
                    raise EOFError(member)
            except BaseException:
                if store.get_file_info(part).type == fs.FileType.File:
                    store.delete_file(part)
                raise
            store.move(part, path)
            return "fetched", n, remote.fetched
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zlib.error):
        if remote.failure:
            raise remote.failure from None
        return "damaged", 0, remote.fetched


def fetch_members(wanted: DataFrame, most: int = MOST_BYTES, ratio: int = MOST_RATIO) -> DataFrame:
    """(url, member, target, status, size, fetched) of wanted members (url, member, target), each fetched by an executor; a repeated task finds what is present.

    Targets are given, so no name inside an archive decides where anything is written. A server that can't be reached fails the task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [fetch_member(r.url, r.member, r.target, most, ratio) for r in pdf.itertuples()]
            yield pdf.assign(status=[g[0] for g in got], size=[g[1] for g in got], fetched=[g[2] for g in got])

    rows = wanted.select(*(F.col(c).cast("string") for c in ("url", "member", "target"))).dropna()
    return rows.mapInPandas(run, "url string, member string, target string, status string, size long, fetched long")
