"""Media columns: a Spark data source over directories of media archives.

`MediaArchive` (format "media_archive") writes rows (key, n_bytes, media) as
members of archive files, one file a task, each with a sidecar of member offsets,
and reads them back. Planning cuts every archive into byte ranges; a task looks up
the offsets in its range, streams the members in Arrow batches of bounded size,
and reads a member again, alone and by its offset, when its checksum does not
hold. A member that stays damaged fails the task with its archive and offset:
rows are never dropped.

The archives go through pyarrow's file systems, so a directory is a URI that all
executors reach. Each attempt of a task writes under a name of its own; the commit
lists the attempts that count, so tasks may fail, run twice or be lost. Each commit has
a list of its own: appended archives stand beside the earlier ones, and an overwriting
write deletes those once its own are listed.

A payload is kept as an 8-bit greyscale PNG, 64 samples a row, without row filters.

Nulls and ties: a null text is an empty payload, which is padded to 64 zero bytes; a null
doc_id is kept; repeated rows are members of their own. An empty table gives an
empty archive directory and an empty result. A very long text is one member. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_folder, table

WIDTH = 64
#: magic, has a key, key, unpadded bytes, member bytes, checksum
HEADER = "<4sBqqQI"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"MBR1"
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
SCHEMA = "key long, n_bytes long, media binary"
ARROW = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


# --- payloads as pictures


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as an 8-bit greyscale PNG of 64 columns."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples (rows, 64) of a picture of `to_png`."""
    if not media.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at, data, shape = len(PNG_MAGIC), [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum does not hold")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean and spread in thousandths, and a 64-bit average hash over an 8 by 8 grid of sums."""
    x = samples.astype(np.int64)
    total, square, n = int(x.sum()), int((x * x).sum()), x.size
    mean = 1000 * total // n
    variance = 1000 * (n * square - total * total) // (n * n)
    cuts = (np.arange(8) * len(x)) // 8
    columns = x.reshape(len(x), 8, 8).sum(axis=2)
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    ends = np.append(cuts[1:], len(x))
    rows = np.maximum(ends - cuts, 1)
    cells = (sums[ends] - sums[cuts]) * 1000 // (rows * 8)[:, None]
    bits = np.packbits((cells > mean).ravel())
    return f"{mean}:{variance}:{bits.tobytes().hex()}"


# --- the data source


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def _lists(files, path: str) -> list[str]:
    """The paths of the lists of archives in a directory."""
    from pyarrow import fs

    return sorted(f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("_archives-"))


def _listed(files, path: str) -> list[list]:
    """(name, bytes) of the archives in one list."""
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int
    members: int


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool = False):
        self.uri, self.overwrite = uri, overwrite
        files, path = _open(uri)
        files.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, path = _open(self.uri)
        name, offsets, at = f"part-{uuid.uuid4().hex}.media", [], 0
        with files.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ARROW.names]
                for key, n, media in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2]):
                    body = media.as_py()
                    offsets.append(at)
                    at += out.write(struct.pack(HEADER, MAGIC, key is not None, key or 0, n, len(body), zlib.crc32(body)))
                    at += out.write(body)
        if offsets:
            with files.open_output_stream(f"{path}/{name}.offsets") as out:
                out.write(np.array(offsets, "<i8").tobytes())
        else:
            files.delete_file(f"{path}/{name}")
        return _Written(name, at, len(offsets))

    def commit(self, messages: list[_Written | None]) -> None:
        """Each write has a list of its own, so writes add up; an overwriting one then takes the others away."""
        files, path = _open(self.uri)
        before = _lists(files, path) if self.overwrite else []
        done = [[m.name, m.size] for m in messages if m is not None and m.members]
        with files.open_output_stream(f"{path}/_archives-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(done)).encode())
        for name in before:
            gone = _listed(files, name)
            files.delete_file(name)
            for archive, _ in gone:
                files.delete_file(f"{path}/{archive}")
                files.delete_file(f"{path}/{archive}.offsets")

    def abort(self, messages: list[_Written | None]) -> None:
        files, path = _open(self.uri)
        for m in messages:
            if m is not None and m.members:
                for name in (m.name, f"{m.name}.offsets"):
                    files.delete_file(f"{path}/{name}")


class MediaReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int, tries: int):
        self.uri, self.range_bytes, self.tries = uri, range_bytes, tries

    def partitions(self) -> list[_Range]:
        files, path = _open(self.uri)
        archives = [x for name in _lists(files, path) for x in _listed(files, name)]
        return [_Range(name, at, min(size, at + self.range_bytes)) for name, size in archives for at in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def member(self, archive, offset: int, name: str) -> tuple[int | None, int, bytes]:
        """One member, read alone; several tries, each from its offset."""
        for k in range(self.tries):
            try:
                magic, has_key, key, n, size, crc = struct.unpack(HEADER, archive.read_at(HEADER_BYTES, offset))
                body = archive.read_at(size, offset + HEADER_BYTES)
                if magic == MAGIC and len(body) == size and zlib.crc32(body) == crc:
                    return (key if has_key else None), n, body
                problem: object = "its checksum does not hold"
            except (OSError, struct.error) as e:
                problem = e
            time.sleep(0.05 * k)
        raise OSError(f"{name}: the member at byte {offset} can't be read: {problem}")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, path = _open(self.uri)
        with files.open_input_stream(f"{path}/{partition.name}.offsets") as f:
            offsets = np.frombuffer(f.read(), "<i8")
        lo, hi = np.searchsorted(offsets, [partition.start, partition.end])
        with files.open_input_file(f"{path}/{partition.name}") as archive:
            rows, held = [], 0
            for offset in offsets[lo:hi].tolist():
                rows.append(self.member(archive, offset, partition.name))
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class MediaArchive(DataSource):
    """Options: path (a URI), range_bytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options["path"], overwrite)


# --- documents as media


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
        for at in range(0, len(raw), 500):
            some = raw[at : at + 500]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], pa.array([len(x) for x in some], pa.int64()), pa.array([to_png(padded(x)) for x in some], pa.binary())], schema=ARROW)


def write_documents(docs: DataFrame, uri: str) -> None:
    """docs (doc_id, text) as pictures in an archive directory."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_render, SCHEMA).write.format("media_archive").mode("append").save(uri)


def read_media(spark: SparkSession, uri: str, **options: object) -> DataFrame:
    """(key, n_bytes, media) of an archive directory."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(uri)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    for batch in batches:
        out = []
        for key, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            stored = media.as_py()
            samples = from_png(stored)
            payload = samples.tobytes()
            out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
        if out:
            types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names=names)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/media-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), uri)
    return read_media(spark, uri).mapInArrow(_digest, DIGESTS)
