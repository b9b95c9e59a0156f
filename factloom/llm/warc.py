"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole WARC records, and at its end a
skippable frame with the seek table (the public Zstandard seekable format). The manifest, a Parquet
table, maps record identifiers to bundle, frame and offset within the frame. Only bundles in the
manifest belong to the archive: each attempt of a task writes files of its own names, so what a lost
or repeated attempt leaves is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, scratch_path, written

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MANIFEST = "id long, type string, bundle string, frame int, offset long, length long"
RECORDS = "id long, type string, refers_to long, digest string, payload_bytes long, payload binary, uri string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str):
    """(file system, path) of an address that pyarrow can write: file, hdfs, s3, gs and so on."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(id_: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>",
        f"WARC-Target-URI: {quote(uri or '', safe=chr(37) + ':/?#[]@!$&()*+,;=~')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, offset: int = 0) -> tuple[dict, int]:
    """The record at an offset of a decompressed frame, and where the next one begins."""
    end = frame.index(b"\r\n\r\n", offset)
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in frame[offset:end].decode().split("\r\n")[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    http_end = frame.index(b"\r\n\r\n", begin, stop) + 4
    length = int(frame[begin:http_end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    full = head["WARC-Type"] == "response"
    payload = frame[http_end:stop] if full else None
    if full and len(payload) != length:
        raise ValueError("a record's payload is cut")
    return {
        "id": number(head["WARC-Record-ID"]), "type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")),
        "digest": hashlib.sha256(payload).hexdigest() if full else head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": length, "payload": payload, "uri": head["WARC-Target-URI"],
    }, stop + 4


class BundleWriter:
    """Collects records, closes a frame at ``frame_bytes`` and a bundle at ``bundle_bytes``."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.press = zstandard.ZstdCompressor(level=level)
        self.out = None

    def _open(self) -> None:
        self.uri = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = store(self.uri)
        self.out, self.sizes, self.entries, self.part, self.held, self.done = fs.open_output_stream(path, compression=None), [], [], [], 0, 0

    def _frame(self) -> None:
        if self.part:
            raw = b"".join(self.part)
            packed = self.press.compress(raw)
            self.out.write(packed)
            self.sizes.append((len(packed), len(raw)))
            self.done += len(packed)
            self.part, self.held = [], 0

    def add(self, id_: int | None, kind: str, raw: bytes) -> list[tuple]:
        """Takes a record; returns the manifest's rows of a bundle that is full now, else none."""
        if self.out is None:
            self._open()
        self.entries.append((id_, kind, self.uri, len(self.sizes), self.held, len(raw)))
        self.part.append(raw)
        self.held += len(raw)
        if self.held >= self.frame_bytes:
            self._frame()
        return self.close() if self.done >= self.bundle_bytes else []

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.out = None
        return self.entries


class BundleReader:
    """Frames of a bundle by number, through the seek table at its end."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * count, size - 9 - 8 * count)))
        self.raw, self.at = [b for _, b in sizes], [0]
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)
        self.press = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.press.decompress(self.file.read_at(self.at[k + 1] - self.at[k], self.at[k]))


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Of (id, digest, payload_bytes), (digest, refers_to): the smallest id of each payload of at least ``least_bytes``.

    One row a payload, counted up before the shuffle: a payload that a third of all pages share is a row a task.
    """
    return pages.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 100,
    frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z", most_broadcast: int = 200_000,
) -> str:
    """Writes one record a row and the manifest; returns the folder.

    Of records with equal payloads of ``least_bytes`` or more, that with the smallest id is a response and
    the others revisit it; rows that share this smallest id are all responses, a null id never is the one
    revisited. Smaller payloads are all responses. A null payload is empty, a null address an empty one;
    other columns are left out. A lost executor's bundles are written anew under other names.

    Payloads that repeat, one row each (a digest and an id), are broadcast if counted to be at most
    ``most_broadcast``, so that payloads stay where they are read; beyond, payloads are shuffled by digest.
    """
    ready(pages.sparkSession)
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeats = written(revisits(rows, least_bytes), "warc-repeats")
    # beyond the bound, Spark splits the partition of a common payload (skew join)
    small = F.broadcast(repeats) if repeats.count() <= most_broadcast else repeats.hint("shuffle_hash")
    told = rows.join(small, "digest", "left").select(
        "id", "uri", F.col("payload").cast("binary").alias("payload"), "digest",
        F.when((F.col("payload_bytes") >= least_bytes) & (F.col("id").isNull() | (F.col("first") < F.col("id"))), F.col("first")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(f"{folder}/bundles", frame_bytes, bundle_bytes, level)
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                id_, uri, payload, digest, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                if full := writer.add(id_, "response" if refers_to is None else "revisit", record(id_, uri, payload, digest, refers_to, date)):
                    yield pack(full)
        if full := writer.close():
            yield pack(full)

    fs.create_dir(f"{path}/bundles", recursive=True)
    told.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _read(frames: DataFrame, whole: bool, payloads: bool) -> DataFrame:
    """Records of (bundle, frames) or, if not ``whole``, of (bundle, frame, offset) rows."""
    schema = RECORDS if payloads else RECORDS.replace(" payload binary,", "")
    fields = [x.split() for x in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != last:
                    last, reader = row["bundle"], BundleReader(row["bundle"])
                for k in row["frames"] if whole else [row["frame"]]:
                    raw, found, at = reader.frame(k), [], 0 if whole else row["offset"]
                    while at < len(raw):
                        one, at = parse(raw, at)
                        found.append({n: one[n] for n, _ in fields})
                        if not whole:
                            break
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    ready(frames.sparkSession)
    return frames.mapInArrow(run, schema)


def read(spark: SparkSession, folder: str, payloads: bool = True, frames_a_row: int = 16, tasks: int | None = None) -> DataFrame:
    """All records of an archive. Digests and lengths of responses are those of the payload as read back.

    Frames are dealt in groups of ``frames_a_row`` of one bundle, round robin to ``tasks`` tasks (twice the cores, or the
    shuffle's partitions if more): these rows are short, but each stands for megabytes of work.
    """
    runs = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("bundle", "frame", F.floor(F.col("frame") / frames_a_row).alias("k")).distinct()
    groups = runs.groupBy("bundle", "k").agg(F.array_sort(F.collect_list("frame")).alias("frames"))  # at most frames_a_row numbers
    tasks = tasks or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _read(groups.repartition(tasks), True, payloads)


def lookup(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some identifiers: only their frames are read, at the manifest's offsets."""
    wanted = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").join(wanted, "id", "left_semi")
    return _read(rows.sort("bundle", "frame", "offset").select("bundle", "frame", "offset"), False, True)


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and returns its records as read back."""
    return read(spark, write(pages, scratch_path(spark, "warc"), **options), payloads=False)
