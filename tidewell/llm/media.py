"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64,
are stored as a grey PNG of 8-bit samples, 64 to a row. Tasks append the files
to tar shards in the shared folder, one member for each distinct payload of a
shard, and rows carry digest, shard, offset and length. A shard is written under
a name of its task's attempt and only closed shards are named in rows, so a
lost executor leaves at most an unnamed file. Metadata columns need a range read
of the first 33 bytes; payloads and features a range read of the member.

Null text is empty: 64 zero bytes. Equal texts have equal values in every column
that does not say where a member lies.
A text is stored and read back whole, however long: its payload and its member must
fit a task. Rows that repeat a doc_id have a row each; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import cut, identified, restored, shared_dir

WIDTH = 64
#: Bytes after which a task starts its next shard.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a sample and colour kind, from the first bytes alone."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    width, height, *_ = png_header(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return lines[:, 1:].tobytes()


class _Shard:
    """A tar file that is being written; members are at known offsets."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.tar"
        self.path = f"{folder.rstrip('/')}/{name}"
        self.system, path = fs.FileSystem.from_uri(self.path)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.size, self.held = self.system.open_output_stream(path), 0, {}

    def add(self, payload: bytes) -> tuple[str, int, int]:
        key = hashlib.sha256(payload).digest()
        if key not in self.held:
            media = to_png(payload)
            digest = hashlib.sha256(media).hexdigest()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.file.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.file.write(media + bytes(-len(media) % 512))
            self.held[key] = (digest, self.size + 512, len(media))
            self.size += 512 + len(media) + -len(media) % 512
        return self.held[key]

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def stored(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of docs(doc_id, text); payloads are written once, here."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches):
        shard, rows = None, []

        def closed():
            shard.close()
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                shard = shard or _Shard(folder)
                raw = (text or "").encode()
                digest, offset, length = shard.add(padded(raw))
                rows.append((doc, len(raw), digest, shard.path, offset, length))
                if shard.size >= SHARD_BYTES:
                    yield closed()
                    shard, rows = None, []
        if shard:
            yield closed()

    rows = identified(docs, "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return cut(rows.withColumn("doc_id", restored()))


class _Reader:
    """Range reads; the last few shards stay open."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            system, path = fs.FileSystem.from_uri(shard)
            self.open[shard] = system.open_input_file(path)
        return self.open[shard].read_at(length, offset)


def with_metadata(rows: DataFrame) -> DataFrame:
    """Adds width, height, bits and colour to rows(shard, offset, length, ...) from the members' headers."""
    names = ("width", "height", "bits", "colour")

    def run(batches):
        reader = _Reader()
        for batch in batches:
            where = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")))
            found = [png_header(reader.read(s, o, min(HEADER_BYTES, n))) for s, o, n in where]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return rows.mapInArrow(run, schema)


def feature(payload: bytes) -> str:
    """Rows, mean in thousandths, and the counts of the samples' upper four bits."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples >> 4, minlength=16)
    return f"{len(samples) // WIDTH}:{int(samples.sum(dtype=np.int64)) * 1000 // len(samples)}:" + ",".join(map(str, counts))


def with_features(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the members hold: width and height by a range read of the header, the rest read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def run(batches):
        reader = _Reader()
        for batch in batches:
            out = []
            for doc, n, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "shard", "offset", "length"))):
                width, height, *_ = png_header(reader.read(shard, offset, min(HEADER_BYTES, length)))
                media = reader.read(shard, offset, length)
                payload = from_png(media)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), width, height))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")
    return out.withColumn("doc_id", restored())
