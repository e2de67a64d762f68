"""Media columns: content-addressed images in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import new_folder, shared_dir, small_batches, stored

#: Samples in one row of an image; payloads are padded to whole rows.
WIDTH = 576
PAD = b"\xff"
PNG = b"\x89PNG\r\n\x1a\n"
#: Signature and the header chunk: what a header-only read takes.
HEADER_BYTES = len(PNG) + 25
BLOCK = 512
#: A shard is closed once it holds so many bytes; a task that reads back takes about so many.
SHARD_BYTES = 256 << 20
READ_BYTES = 32 << 20
CATALOG = "digest string, shard string, offset long, length long, n_bytes long"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of the text, padded with 255 to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A grey-scale PNG of 8-bit samples, WIDTH to a row; lossless, and the same for equal payloads."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of a stored image."""
    if head[: len(PNG)] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode(media: bytes) -> bytes:
    """The samples of an image written by :func:`encode`."""
    width, height, _ = read_header(media)
    at, data = len(PNG), b""
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and rows, then a 64-bit average hash of the samples' means over 64 equal runs."""
    samples = np.frombuffer(payload, np.uint8)
    means = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64) / np.diff([*(np.arange(64) * len(samples) // 64), len(samples)])
    bits = "".join("1" if m > samples.mean() else "0" for m in means)
    return f"{samples.mean():.4f}:{samples.std():.4f}:{len(samples) // WIDTH}:{int(bits, 2):016x}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Shard:
    """One tar file being written. Member names are digests, so equal payloads are stored once in it."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        files, path = _open(self.uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = files.open_output_stream(path)
        self.size = 0
        self.places: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.places:
            media = encode(payload)
            member = tarfile.TarInfo(f"{digest}.png")
            member.size = len(media)
            head = member.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + bytes(-len(media) % BLOCK))
            self.places[digest] = (self.size + len(head), len(media))
            self.size += len(head) + len(media) + -len(media) % BLOCK
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * BLOCK))
        self.out.close()


def write_shards(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every text of ``docs(doc_id, text, ...)`` and return the catalog ``(doc_id, digest, shard, offset, length, n_bytes)``.

    Each task writes tar files of its own in the shared folder, under names no other attempt uses, so a
    task that is run again never touches what another wrote; the catalog names the files of the attempt
    that ended well. A payload is stored once in a shard; the same digest in several shards may be read
    from any. The catalog is written before it is returned, so shards are not written again.
    A null text counts as empty and is stored as one row of padding; repeated rows each have their row;
    extra columns are not read; an empty table gives an empty catalog.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if shard is None or shard.size >= shard_bytes:
                    if shard:
                        shard.close()
                    shard = _Shard(folder)
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((digest, shard.uri, *shard.add(digest, payload), len((text or "").encode("utf-8", "surrogatepass"))))
            if rows:
                columns = [batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "shard", "offset", "length", "n_bytes"])
        if shard:
            shard.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {CATALOG}"), "media-catalog")


class _Reader:
    """Range reads of one shard at a time."""

    def __init__(self) -> None:
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            files, path = _open(uri)
            self.uri, self.file = uri, files.open_input_file(path)
        return self.file.read_at(length, offset)


def header_columns(shard: Column, offset: Column) -> Column:
    """A struct ``(width, height, depth)`` from a read of each object's header alone."""

    @F.pandas_udf("width int, height int, depth int")
    def run(shards: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        reader = _Reader()
        return pd.DataFrame([read_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(shards, offsets, strict=True)], columns=["width", "height", "depth"])

    return run(shard, offset)


def payload_columns(shard: Column, offset: Column, length: Column) -> Column:
    """A struct ``(payload_bytes, payload_sha256, tail_crc32, media_sha256, feature)`` from the stored bytes, read back.

    An object that follows itself, as in a run of copies, is read once.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")
    def run(shards: pd.Series, offsets: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        reader, known, rows = _Reader(), {}, []
        for at in zip(shards, offsets, lengths, strict=True):
            if at not in known:
                media = reader.read(*at)
                payload = decode(media)
                known[at] = (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    hashlib.sha256(media).hexdigest(),
                    feature_of(payload),
                )
            rows.append(known[at])
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    return run(shard, offset, length)


def in_ranges(rows: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The catalog dealt to tasks by place, each about ``read_bytes`` of payload and sorted, so that reads go forward.

    The id is part of the order, so rows that share one object can go to several tasks.
    """
    total = rows.agg(F.sum("length")).first()[0] or 0
    order = ["shard", "offset", "doc_id"]
    return rows.repartitionByRange(max(1, -(-total // read_bytes)), *order).sortWithinPartitions(*order)


def with_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The catalog of ``docs`` with metadata from the headers and features from the payloads.

    Rows ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)``,
    and then ``digest``, ``shard``, ``offset``, ``width``, ``height`` and ``depth``.
    """
    shared_dir(docs.sparkSession)
    rows = in_ranges(write_shards(docs, folder))
    found = rows.select("*", header_columns(F.col("shard"), F.col("offset")).alias("head"), payload_columns(F.col("shard"), F.col("offset"), F.col("length")).alias("body"))
    body = [F.col(f"body.{c}") for c in ("payload_bytes", "payload_sha256", "tail_crc32")]
    media = [F.col("length").alias("media_bytes"), F.col("body.media_sha256"), F.col("body.feature")]
    return found.select("doc_id", "n_bytes", *body, *media, "digest", "shard", "offset", "head.*")
