"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

`write_pages` turns pages (page_id, url, html) into WARC/1.1 records:

1. Payloads are the html in UTF-8. Of records with equal payloads of at least
   `REVISIT_BYTES` bytes the one with the smallest page_id is a response; the others are
   revisits that refer to it and carry its HTTP header, not its payload.
2. Records are range-sorted by (host in reverse, rest of the URL), then page_id. The
   bounds of the ranges are quantiles of the rows with the smallest hashes, so they follow from the rows
   alone, not from how Spark happens to deal them. One task writes one range; a frequent
   URL is cut between ranges by page_id.
3. A task writes each record as a gzip member of its own, regenerates all headers and
   digests, and begins a new file when the compressed size would pass `roll_bytes`.
4. Each attempt of a task writes below a temporary name. The commit moves the files of the
   attempts that count into the folder of their set and then moves a manifest (names,
   sizes, records, digests) to its final name. A set is named by the digest of its
   manifest: the same rows give the same bytes and the same set, and writing them again
   changes nothing. Readers see only what a manifest lists.

`read_pages` plans one partition for each file, and checks sizes, block digests and payload digests.
Files go through pyarrow's file systems, so a directory is a URI that all executors reach.

Nulls and ties: a null html is an empty payload; a null page_id is written without its
header, read back as null, and is the last choice for a response; a null URL becomes
`urn:page:` and the id; rows that are equal in every column are one response and revisits
of it (the first in order; if smaller, all are responses). A very long html is one record in one
member. An empty table gives an archive without files and an empty result. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import discard, shared_folder, small_or_shuffled, stored, table
from .media import _open

#: Smaller payloads are never revisits.
REVISIT_BYTES = 100
#: Payload bytes a range is planned for, and the most ranges.
RANGE_BYTES, MAX_RANGES = 8 << 20, 8192
#: Rows of the sample for each range.
SAMPLE = 16
ROLL_BYTES = 64 << 20
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
READ_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
LEVEL = 6
COLUMNS = ["page_id", "url", "html", "digest", "n_bytes", "part", "first", "refers_to"]
FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, file string, offset long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records


def record_id(*about: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(about).encode()).digest()[:16])}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    """The URL with what a header can't hold percent-encoded."""
    if url is None:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(rb"[^!-~]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def http_header(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    """One WARC record; the digest and the length of its block are made here."""
    every = [("WARC-Type", kind), ("WARC-Date", date), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in every).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member without a time, so that equal records have equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, names in lower case, and the block of a record; its length and digest must hold."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    n = int(headers["content-length"])
    block = rest[:n]
    if not version.startswith("WARC/") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("its length does not hold")
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("its block's digest does not hold")
    return headers, block


# --- the data source


@dataclass
class _Written(WriterCommitMessage):
    #: (temporary path, name, compressed bytes, records, SHA-256)
    files: list[tuple[str, str, int, int, str]]


@dataclass
class _File(InputPartition):
    path: str
    size: int


class _Rolled:
    """The open file of a range: members go in until the next one would pass the limit."""

    def __init__(self, files, folder: str, part: int, roll_bytes: int, date: str):
        self.files, self.folder, self.part, self.roll_bytes, self.date = files, folder, part, roll_bytes, date
        self.done: list[tuple[str, str, int, int, str]] = []
        self.out = None

    def add(self, data: bytes) -> None:
        if self.out is not None and self.size + len(data) > self.roll_bytes:
            self.close()
        if self.out is None:
            self.name, self.size, self.records, self.sha = f"records-{self.part:05d}-{len(self.done):05d}.warc.gz", 0, 0, hashlib.sha256()
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            about = [("WARC-Record-ID", record_id("info", self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(member(record("warcinfo", about, b"format: WARC File Format 1.1\r\n", self.date)))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.name, self.size, self.records, self.sha.hexdigest()))
            self.out = None


class WarcWriter(DataSourceArrowWriter):
    """Rows of COLUMNS, in order within a task."""

    def __init__(self, uri: str, roll_bytes: int, date: str, overwrite: bool):
        self.uri, self.roll_bytes, self.date, self.overwrite = uri, roll_bytes, date, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"
        files, path = _open(uri)
        files.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, path = _open(self.uri)
        folder = f"{path}/{self.temporary}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        rolled, done, last, nth = None, [], None, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in COLUMNS]
            for k in range(batch.num_rows):
                page_id, url, html, digest, n_bytes, part, first, refers_to = (c[k].as_py() for c in columns)
                if rolled is None or rolled.part != part:
                    if rolled is not None:
                        rolled.close()
                        done += rolled.done
                    rolled, last, nth = _Rolled(files, folder, part, self.roll_bytes, self.date), None, 0
                # Rows equal to the first of their payload stand next to it.
                twin = first and last == (page_id, url, digest)
                last, nth = (page_id, url, digest), nth + 1
                head = http_header(n_bytes)
                about = [("WARC-Target-URI", target_uri(url, page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                about += [("X-Page-Id", str(page_id))] * (page_id is not None)
                if first is None or (first and not twin):
                    own = record_id("payload", digest) if first else record_id("record", part, nth, digest)
                    raw = record("response", [("WARC-Record-ID", own), *about], head + (html or "").encode(), self.date)
                else:
                    about += [("WARC-Refers-To", record_id("payload", digest)), ("WARC-Profile", REVISIT_PROFILE), *[("X-Refers-To-Page-Id", str(refers_to))] * (refers_to is not None)]
                    raw = record("revisit", [("WARC-Record-ID", record_id("record", part, nth, digest)), *about], head, self.date)
                rolled.add(member(raw))
        if rolled is not None:
            rolled.close()
            done += rolled.done
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = _open(self.uri)
        found = sorted((x for m in messages if m is not None for x in m.files), key=lambda x: x[1])
        manifest = json.dumps({"files": [{"name": n, "bytes": size, "records": records, "sha256": sha} for _, n, size, records, sha in found]}, indent=1).encode()
        name = f"set-{hashlib.sha256(manifest).hexdigest()[:32]}"
        before = _manifests(files, path)
        files.create_dir(f"{path}/{self.temporary}", recursive=True)
        if f"{name}.json" not in before:
            files.create_dir(f"{path}/{name}", recursive=True)
            for at, n, *_ in found:
                files.move(at, f"{path}/{name}/{n}")
            with files.open_output_stream(f"{path}/{self.temporary}/{name}.json") as out:
                out.write(manifest)
            files.move(f"{path}/{self.temporary}/{name}.json", f"{path}/{name}.json")
        if self.overwrite:
            for other in before:
                if other != f"{name}.json":
                    files.delete_file(f"{path}/{other}")
                    files.delete_dir(f"{path}/{other.removesuffix('.json')}")
        files.delete_dir(f"{path}/{self.temporary}")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        files, path = _open(self.uri)
        if files.get_file_info(f"{path}/{self.temporary}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.temporary}")


def _manifests(files, path: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(path)) if re.fullmatch(r"set-\w+\.json", f.base_name))


class WarcReader(DataSourceReader):
    def __init__(self, uri: str, payload: bool):
        self.uri, self.payload = uri, payload

    def partitions(self) -> list[_File]:
        files, path = _open(self.uri)
        found = []
        for name in _manifests(files, path):
            with files.open_input_stream(f"{path}/{name}") as f:
                found += [_File(f"{name.removesuffix('.json')}/{x['name']}", x["bytes"]) for x in json.loads(f.read())["files"]]
        return found or [_File("", 0)]

    def members(self, partition: _File) -> Iterator[tuple[int, bytes]]:
        """(offset, record) of the members of a file."""
        files, path = _open(self.uri)
        at, seen, unpacker, parts = 0, 0, zlib.decompressobj(31), []
        with files.open_input_stream(f"{path}/{partition.path}", compression=None) as f:
            while data := f.read(READ_BYTES):
                seen += len(data)
                while data:
                    parts.append(unpacker.decompress(data))
                    data = unpacker.unused_data
                    if unpacker.eof:
                        yield at, b"".join(parts)
                        at, unpacker, parts = seen - len(data), zlib.decompressobj(31), []
        if at != partition.size or seen != partition.size:
            raise OSError(f"{partition.path}: it ends at byte {seen}, within a member or not where its manifest says")

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, held = [], 0
        for offset, raw in self.members(partition):
            try:
                row = self.row(raw)
            except (ValueError, KeyError) as e:
                raise OSError(f"{partition.path}: the record at byte {offset} can't be read: {e}") from e
            if row:
                rows.append((*row[:-1], partition.path, offset, row[-1])[: None if self.payload else -1])
                held += 200 + (len(row[-1] or b"") if self.payload else 0)
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def row(raw: bytes) -> tuple | None:
        """What a response or a revisit says; the payload last."""
        headers, block = parsed(raw)
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            return None
        head, _, payload = block.partition(b"\r\n\r\n")
        n_bytes, digest = int(re.search(rb"(?i)\ncontent-length: (\d+)", head)[1]), headers["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("its payload's digest does not hold")
        number = lambda name: int(headers[name]) if name in headers else None
        return number("x-page-id"), headers["warc-target-uri"], kind, n_bytes, digest, number("x-refers-to-page-id"), headers["warc-record-id"], payload if kind == "response" else None

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names, kinds = zip(*(x.split() for x in _fields(self.payload).split(", ")))
        return pa.RecordBatch.from_arrays([pa.array(list(x), types[t]) for x, t in zip(zip(*rows), kinds)], names=list(names))


def _fields(payload: bool) -> str:
    return FIELDS + (", payload binary" if payload else "")


class WarcArchive(DataSource):
    """Options: path (a URI), roll_bytes, date, payload (false: read without the payloads, which are checked all the same)."""

    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def _payload(self) -> bool:
        return self.options.get("payload", "true").lower() != "false"

    def schema(self) -> str:
        return _fields(self._payload())

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._payload())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)), self.options.get("date", DATE), overwrite)


# --- pages as archives


def sort_key(url: Column) -> Column:
    """The labels of the host in reverse, then the rest: pages of one site stand together."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def heads_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, key, digest, n_bytes) of pages."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", sort_key(F.col("url")).alias("key"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))


def _place(key: str, page_id: int | None) -> tuple[str, int]:
    return key, -(1 << 63) if page_id is None else page_id


def range_bounds(heads: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ranges - 1 bounds, quantiles of SAMPLE * ranges rows: those of the smallest hashes, the same however the rows are dealt."""
    lowest = heads.select("key", "page_id", F.xxhash64("key", "page_id", "digest").alias("_h")).orderBy("_h", "key", "page_id").limit(SAMPLE * ranges)
    sample = sorted(_place(r["key"], r["page_id"]) for r in lowest.collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def first_pages(heads: DataFrame) -> DataFrame:
    """(digest, _id, _url): the page that is the response of each payload that several rows share; rows of fixed width."""
    own = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.md5(F.coalesce("url", F.lit("")).cast("binary")).alias("url"))
    shared = heads.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("_rows"), F.min(own).alias("_f")).where("_rows > 1")
    return shared.select("digest", F.col("_f.page_id").alias("_id"), F.col("_f.url").alias("_url"))


def records_of(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """COLUMNS of the records, dealt into ranges and sorted; first: null if the payload is nobody else's."""
    total = heads.agg(F.sum("n_bytes")).first()[0] or 0
    bounds = range_bounds(heads, min(MAX_RANGES, max(1, math.ceil(total / RANGE_BYTES))))

    @F.arrow_udf("int")
    def part(key: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, _place(k, p)) for k, p in zip(key.to_pylist(), page_id.to_pylist())], pa.int32())

    # Sent to all tasks while so few that they take some 12 MB; then pages are dealt out once, by range.
    firsts = stored(first_pages(heads), "warc-firsts")
    joined = heads_of(pages).join(small_or_shuffled(firsts, 100_000), "digest", "left")
    mine = F.col("page_id").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce("url", F.lit("")).cast("binary")) == F.col("_url"))
    whole = joined.withColumn("first", F.when(F.col("_url").isNotNull(), mine)).withColumn("refers_to", F.col("_id")).withColumn("part", part("key", "page_id"))
    return whole.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "page_id", "url", "digest").select(*COLUMNS)


def write_pages(pages: DataFrame, uri: str, mode: str = "append", **options: object) -> None:
    """pages (page_id, url, html) as a set of WARC files in the directory `uri`."""
    pages.sparkSession.dataSource.register(WarcArchive)
    heads = stored(heads_of(pages).drop("html"), "warc-heads")
    records_of(pages, heads).write.format("warc_archive").options(**options).mode(mode).save(uri)
    discard(heads)


def read_pages(spark: SparkSession, uri: str, **options: object) -> DataFrame:
    """The responses and revisits of the sets in a directory, one row a record."""
    spark.dataSource.register(WarcArchive)
    return spark.read.format("warc_archive").options(**options).load(uri)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), uri)
    return read_pages(spark, uri, payload="false").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM p
"""
