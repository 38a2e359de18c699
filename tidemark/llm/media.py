"""Media columns: payloads stored as 8-bit images in archives, read by a data source.

``write_archives`` stores each payload losslessly as an 8-bit greyscale PNG of
576 samples a row, many in one archive, in a shared folder. The data source
``media_archive`` plans byte ranges over the archives named by a manifest,
streams the members that begin in a range as Arrow batches, and retries each
member by itself at its own offset: a bad member costs no other.

Archive: members one after the other (``MEMBER`` header, the key as text, the stored
form), then the members' offsets as little-endian 64-bit integers, then ``FOOTER``.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch_dir, texts

ROW = 576
#: magic, key is there, bytes of the key, bytes before padding, bytes of the stored form, CRC-32 of both
MEMBER = struct.Struct("<4s?qqqI")
MAGIC = b"TMM1"
#: members, place of the offsets, magic
FOOTER = struct.Struct("<qq4s")
PNG = b"\x89PNG\r\n\x1a\n"
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20


def padded(payload: bytes) -> bytes:
    """``payload`` with bytes 255 up to a positive multiple of ``ROW``."""
    return payload + b"\xff" * (max(1, -(-len(payload) // ROW)) * ROW - len(payload))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, level: int = 1) -> bytes:
    """8-bit greyscale PNG, ``ROW`` samples wide; ``samples`` fill whole rows."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """Samples of an 8-bit greyscale PNG that isn't interlaced; ValueError if it is damaged."""
    if data[:8] != PNG:
        raise ValueError("no PNG")
    at, packed, width, height = 8, [], 0, 0
    while True:
        if at + 12 > len(data):
            raise ValueError("PNG ends early")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk is damaged")
        at += 12 + n
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("PNG isn't 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("PNG has other rows than it says")
    lines = lines.reshape(height, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    out = np.zeros((height + 1, width + 1), np.uint8)
    for y in range(height):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind in (0, 2):
            out[y + 1, 1:] = line + (up[1:] if kind == 2 else 0)
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, dtype=np.uint8)
        elif kind in (3, 4):
            now = out[y + 1]
            for x in range(1, width + 1):
                a, b, c = int(now[x - 1]), int(up[x]), int(up[x - 1])
                p = a + b - c
                guess = (a + b) >> 1 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (int(line[x - 1]) + guess) & 255
        else:
            raise ValueError("PNG has an unknown filter")
    return out[1:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, change from sample to sample and a mean of each 16th, as text."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    n = len(x)
    change = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) if n > 1 else 0
    bins = np.add.reduceat(x.astype(np.int64), np.arange(16) * (n // 16)) // np.diff([*(np.arange(16) * (n // 16)), n])
    deviation = max(0, square * n - total * total) ** 0.5 / n
    return f"mean={total / n:.4f};dev={deviation:.4f};change={change / max(1, n - 1):.4f};bins={','.join(map(str, bins.tolist()))}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or an absolute path."""
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class _Archive:
    """An archive being written."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.tma"
        fs, path = filesystem(self.name)
        self.out, self.size, self.at = fs.open_output_stream(path, compression=None), 0, []

    def add(self, key: str | None, n: int, media: bytes) -> None:
        name = (key or "").encode()
        self.at.append(self.size)
        self.out.write(MEMBER.pack(MAGIC, key is not None, len(name), n, len(media), zlib.crc32(media, zlib.crc32(name))))
        self.out.write(name + media)
        self.size += MEMBER.size + len(name) + len(media)

    def close(self) -> tuple[str, int, int]:
        self.out.write(struct.pack(f"<{len(self.at)}q", *self.at) + FOOTER.pack(len(self.at), self.size, MAGIC))
        self.out.close()
        return self.name, len(self.at), self.size


def write_archives(rows: DataFrame, key: str, text: str, folder: str | None = None) -> str:
    """Store each row's text as a media member; the folder's URI is returned.

    Every row is stored, with repeated and null keys too; a null text is empty. Each
    attempt of a task writes files of new names, and only those of the attempts that
    Spark counts get into the manifest (a Parquet table in the folder), so a lost
    executor leaves no member twice. A table without rows gives an empty manifest. Keys are
    stored as text and read back as what they were (of any type that a cast to text and
    back restores). Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    folder = folder or f"{scratch_dir(spark)}/media-{uuid.uuid4().hex}"
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def store(batches):
        archive, done = None, []
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                archive = archive or _Archive(folder)
                archive.add(k, len(payload), encode_png(padded(payload)))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "members", "bytes"])

    stored = rows.select(rows[key].cast("string").alias("k"), rows[text].alias("t")).mapInArrow(store, "archive string, members long, bytes long")
    stored.withColumn("key", F.lit(None).cast(rows.schema[key].dataType)).write.parquet(f"{folder}/manifest")  # its type is the keys'
    return folder


class Range(InputPartition):
    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("manifest", json).load()``.

    Options: ``archives`` (lines ``bytes<tab>URI``), ``rangebytes`` (8 MB), ``retries``
    (3 for each member), ``batchbytes`` (4 MB). Rows: key (as text), n_bytes (before padding),
    media (stored form), payload (its samples), error (null, or why the member could not
    be read: then media and payload are null).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("key", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.archives = [(int(n), uri) for n, _, uri in (x.partition("\t") for x in options.get("archives", "").splitlines())]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.retries = int(options.get("retries", 3))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))

    def partitions(self) -> list[Range]:
        """Ranges by sizes alone: no archive is opened here."""
        return [Range(uri, low, min(n, low + self.range_bytes)) for n, uri in self.archives for low in range(0, n, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        schema = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])
        held: list[tuple] = []
        size = 0
        for row in self.members(partition) if partition.archive else ():
            held.append(row)
            size += len(row[2] or b"") + len(row[3] or b"")
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)

    def members(self, partition: Range):
        """The members that begin in the range, in order."""
        fs, path = filesystem(partition.archive)
        whole = fs.get_file_info(path).size
        file = fs.open_input_file(path)
        try:
            n, at, magic = FOOTER.unpack(file.read_at(FOOTER.size, whole - FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.archive} is no media archive")
            starts = np.frombuffer(file.read_at(8 * n, at), "<i8")
            i, j = np.searchsorted(starts, [partition.low, partition.high])
            for k, offset in enumerate(starts[i:j].tolist(), int(i)):
                end = int(starts[k + 1]) if k + 1 < n else at
                for attempt in range(self.retries + 1):
                    try:
                        yield self.member(file, offset, end)
                        break
                    except (OSError, ValueError, struct.error, zlib.error) as e:
                        if attempt == self.retries:
                            yield None, None, None, None, f"{partition.archive}@{offset}: {e}"
                            break
                        time.sleep(0.05 * 2**attempt)
                        try:
                            file.close()
                        finally:
                            file = fs.open_input_file(path)  # a new handle for this member's next attempt
        finally:
            file.close()

    @staticmethod
    def member(file, offset: int, end: int) -> tuple:
        data = file.read_at(end - offset, offset)
        magic, there, named, n, size, crc = MEMBER.unpack_from(data)
        name, media = data[MEMBER.size : MEMBER.size + named], data[MEMBER.size + named : MEMBER.size + named + size]
        if magic != MAGIC or len(media) != size or zlib.crc32(media, zlib.crc32(name)) != crc:
            raise ValueError("member is damaged")
        return name.decode() if there else None, n, media, decode_png(media), None


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of all archives in the folder's manifest, with keys of their own type; none for an empty one."""
    spark.dataSource.register(MediaArchive)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One line for each archive of up to 64 MB: 100 TB make two million lines, which the planner has to hold anyway.
    archives = "\n".join(f"{r['bytes']}\t{r['archive']}" for r in manifest.select("bytes", "archive").orderBy("archive").toLocalIterator())
    members = spark.read.format("media_archive").option("archives", archives).options(**options).load()
    return members.withColumn("key", F.col("key").cast(manifest.schema["key"].dataType))


def media_digests(members: DataFrame, key_name: str) -> DataFrame:
    """Digest of each member: from the stored bytes alone, as read back."""
    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "error": T.StringType()}
    schema = T.StructType([T.StructField(key_name, members.schema["key"].dataType), *(T.StructField(n, kind) for n, kind in kinds.items())])
    names = schema.names

    def digest(batches):
        for batch in batches:
            payloads, media = batch.column("payload").to_pylist(), batch.column("media").to_pylist()
            of = lambda f, xs: [None if x is None else f(x) for x in xs]
            columns = [
                batch.column("key"), batch.column("n_bytes"), pa.array(of(len, payloads), pa.int64()), pa.array(of(lambda x: hashlib.sha256(x).hexdigest(), payloads), pa.string()),
                pa.array(of(lambda x: zlib.crc32(x[-32:]), payloads), pa.int64()), pa.array(of(len, media), pa.int64()), pa.array(of(lambda x: hashlib.sha256(x).hexdigest(), media), pa.string()),
                pa.array(of(feature, payloads), pa.string()), batch.column("error"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return members.mapInArrow(digest, schema)
