"""Media columns: texts stored as baseline JPEG files, read back as dimensions and thumbnail hashes (``jpeg.py``).

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the image's quantised coefficients. Null
and empty texts are 192 spaces; equal texts give equal files; rows that repeat an id are stored each; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import jpeg

BATCH_BYTES = 1 << 20


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % jpeg.UNIT if raw else jpeg.UNIT)


def _groups(batch: pa.RecordBatch, column: int):
    """Slices of about BATCH_BYTES with the column's values as bytes."""
    values = [v.encode() if isinstance(v, str) else v or b"" for v in batch.column(column).to_pylist()]
    a = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > BATCH_BYTES:
            yield batch.slice(a, i - a), values[a:i]
            a, size = i, 0
        size += len(v)
    if values:
        yield batch.slice(a), values[a:]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a JPEG file."""

    def run(batches):
        for batch in batches:
            for part, raw in _groups(batch, 1):
                files = jpeg.encode([padded(r) for r in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Of files (doc_id, n_bytes, media): the payload read back and its digests, dimensions and thumbnail hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"

    def run(batches):
        for batch in batches:
            for part, files in _groups(batch, 2):
                rows = []
                for raw, (image, blocks) in zip(files, jpeg.decode(files)):
                    back = jpeg.payload(image, blocks)
                    mark = jpeg.average_hash(jpeg.thumbnail(image, blocks))
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{image.width}x{image.height}:{mark}", image.width, image.height, mark))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
