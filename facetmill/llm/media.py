"""Media columns: payloads stored losslessly as images in archives, read back through a Spark data source.

Writing: every task streams its rows into zip archives of bounded size and number of members (stored members; the image
compresses itself), under a temporary name that is renamed when it is complete. The manifest is a table that Spark
commits: only archives that a successful task reports are in it, so what a lost or repeated task left behind is never read.

Reading: the data source plans partitions as byte ranges over the archives' directories, from the manifest alone. The
reader of a range reads its stretch of the directory, then each member by its offset, checks its checksum and decodes it,
and repeats a member that fails in any of these by itself on a newly opened file. Payloads stream as a column in Arrow batches of bounded bytes; digests and
the feature are computed from that column.

The image is a PNG of 64 pixels of three 8-bit samples a row (192 bytes); the payload is padded with bytes 32 to full
rows, one at least. Null text is empty. Equal texts give equal images; repeated rows are stored once each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import urllib.parse
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_folder, saved, small_batches

ROW = 192
#: Members of an archive; the format without extensions counts up to 65,535.
MEMBERS = 60_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW if data else ROW)


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """A PNG whose samples are the payload (full rows)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_image(data: bytes) -> bytes:
    """The samples of a PNG of 8-bit RGB with unfiltered rows; every chunk's checksum is verified."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], 3 * shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not read")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean of each channel and, as hexadecimal digits, which of 64 equal stretches of samples are brighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    means = x.reshape(-1, 3).mean(axis=0)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    parts = np.add.reduceat(x.astype(np.int64), edges[:-1]) / np.diff(edges)
    bits = int("".join("1" if b else "0" for b in parts > x.mean()), 2)
    return ",".join(f"{m:.4f}" for m in means) + f";{bits:016x}"


def open_fs(url: str):
    """A pyarrow file system and a path in it, for local paths and any store pyarrow knows."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(url).path)
    return fs.FileSystem.from_uri(url)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 256_000_000, range_bytes: int = 16_000_000) -> DataFrame:
    """Store every text as an image; returns the manifest, a written table: archive, start, end of each range, and first and
    last, the bounds of its entries in the archive's directory.

    docs: key (string) and text. A range holds whole members; the job that reads the manifest has a task for each row.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        made, stream, archive, name = [], None, None, ""

        def finish():
            members = archive.infolist()
            archive.close()
            size = stream.tell()
            stream.close()
            store.move(f"{root}/{name}.tmp", f"{root}/{name}")
            at, start, entry = 0, archive.start_dir, archive.start_dir
            for i, m in enumerate(members):
                entry += 46 + len(m.filename.encode())
                last = i + 1 == len(members)
                end = size if last else members[i + 1].header_offset
                if last or end - at >= range_bytes:
                    made.append((name, at, end, start, entry))
                    at, start = end, entry

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = store.open_output_stream(f"{root}/{name}.tmp")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=False)
                data = (text or "").encode()
                member = zipfile.ZipInfo(f"{len(data)}/{urllib.parse.quote(json.dumps(key), safe='')}.png")
                archive.writestr(member, encode_image(padded(data)))
                if stream.tell() >= archive_bytes or len(archive.infolist()) >= MEMBERS:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64() if i else pa.string()) for i in range(5)], ["archive", "start", "end", "first", "last"])

    return saved(docs.select("key", "text").mapInArrow(run, "archive string, start long, end long, first long, last long"), "media-manifest")


@dataclass
class Range(InputPartition):
    archive: str
    first: int
    last: int


class MediaSource(DataSource):
    """Payloads of archives. Options: path (folder), manifest (folder of the table of write_archives), batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key string, n_bytes long, payload binary, media_bytes long, media_sha256 string, archive string, member_offset long"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.folder, self.manifest = options["path"], options["manifest"]
        self.most, self.retries = int(options.get("batchbytes", 4_000_000)), int(options.get("retries", 3))

    def partitions(self):
        from pyarrow import dataset

        store, path = open_fs(self.manifest)
        ranges = dataset.dataset(path, filesystem=store, format="parquet").to_table(["archive", "first", "last"])
        return [Range(*r) for r in zip(*(c.to_pylist() for c in ranges.columns))] or [Range("", 0, 0)]

    def read(self, part: Range):
        import pyarrow as pa

        if not part.archive:
            return
        store, root = open_fs(self.folder)
        path = f"{root}/{part.archive}"
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["key", "n_bytes", "payload", "media_bytes", "media_sha256", "archive", "member_offset"]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows, held = [], 0
        with Members(store, path, self.retries) as source:
            for offset, name, size, crc in source.entries(part.first, part.last):
                image, payload = source.get(offset, size, crc)
                n, key = name.removesuffix(".png").split("/", 1)
                rows.append((json.loads(urllib.parse.unquote(key)), int(n), payload, len(image), hashlib.sha256(image).hexdigest(), part.archive, offset))
                held += len(payload)
                if held >= self.most:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


class Members:
    """Members of an archive by offset; each is repeated by itself when its read, checksum or decoding fails."""

    def __init__(self, store, path: str, retries: int, decode=decode_image):
        self.store, self.path, self.retries, self.decode, self.file = store, path, retries, decode, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()

    def entries(self, first: int, last: int) -> list[tuple[int, str, int, int]]:
        """(offset, name, size, checksum) of the members whose directory entries lie in this stretch of the archive."""
        def read(f):
            data, at, out = f.read_at(last - first, first), 0, []
            while at < last - first:
                if data[at : at + 4] != b"PK\x01\x02":
                    raise OSError("no directory entry here")
                crc, _, size, name, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
                (offset,) = struct.unpack_from("<I", data, at + 42)
                out.append((offset, data[at + 46 : at + 46 + name].decode(), size, crc))
                at += 46 + name + extra + comment
            return out

        return self._tried(read)

    def get(self, offset: int, size: int, crc: int) -> tuple[bytes, bytes]:
        """The member and what it decodes to."""

        def read(f):
            head = f.read_at(30, offset)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member at this offset")
            name, extra = struct.unpack("<HH", head[26:30])
            data = f.read_at(size, offset + 30 + name + extra)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError("damaged member")
            return data, self.decode(data)

        return self._tried(read)

    def _tried(self, read):
        for attempt in range(self.retries + 1):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.path)
                return read(self.file)
            except (OSError, ValueError, struct.error, zlib.error):
                if self.file is not None:
                    self.file.close()
                    self.file = None
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError


def described(payloads: DataFrame) -> DataFrame:
    """The source's rows with digests and the feature of each payload in place of it; payload batches stream through Arrow."""
    small_batches(payloads.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = b.column(2).to_pylist()
            more = [pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()), pa.array([zlib.crc32(x[-16:]) for x in data], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more, b.column(3), b.column(4), pa.array([feature(x) for x in data], pa.string()), b.column(5), b.column(6)], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "archive", "member_offset"])

    return payloads.mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, archive string, member_offset long")


def media_columns(docs: DataFrame, folder: str | None = None, range_bytes: int = 16_000_000) -> DataFrame:
    """Store every text of docs as media in `folder` and read the columns back from what is stored."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "media")
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.base64("doc_id") if kind == "binary" else F.col("doc_id").cast("string")
    manifest = write_archives(docs.select(key.alias("key"), "text"), folder, range_bytes=range_bytes)
    spark.dataSource.register(MediaSource)
    out = described(spark.read.format("media_archive").option("path", folder).option("manifest", manifest._saved_at).load())
    own = F.unbase64("key") if kind == "binary" else F.col("key").cast(kind)
    return out.select(own.alias("doc_id"), *out.columns[1:])
