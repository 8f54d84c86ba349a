"""Media columns: documents as progressive JPEGs, their pixels and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean

from lodestone.llm import jpeg

#: A payload is a positive multiple of this; it is filled up with FILL.
UNIT, FILL = 576, b"\xff"
BATCH_BYTES = 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + FILL * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > BATCH_BYTES or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def store(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled up, as a progressive JPEG. Null texts are empty. Repeated rows and null ids stay."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, value in zip(batch.column(0), batch.column(1)):
                    raw = (value.as_py() or "").encode()
                    yield doc_id.as_py(), len(raw), jpeg.encode_payload(padded(raw))

        yield from _batches(rows(), pa.schema([("doc_id", _arrow(key)), ("n_bytes", pa.int64()), ("media", pa.binary())]), lambda r: len(r[2]))

    return docs.select("doc_id", (F.col("text") if text is None else text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {key}, n_bytes long, media binary")


def _arrow(kind: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "date": pa.date32()}
    if kind.startswith("decimal"):
        return pa.decimal128(*(int(x) for x in kind[8:-1].split(",")))
    return simple[kind]


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, width, height, rgb): full-resolution tensors, height x width x 3 bytes. Nulls and what isn't a progressive JPEG give null width, height and rgb."""
    key = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, value in zip(batch.column(0), batch.column(1)):
                    try:
                        rgb = jpeg.decode(value.as_py() or b"").rgb()
                        yield doc_id.as_py(), rgb.shape[1], rgb.shape[0], rgb.tobytes()
                    except jpeg.BadImage:
                        yield doc_id.as_py(), None, None, None

        yield from _batches(rows(), pa.schema([("doc_id", _arrow(key)), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())]), lambda r: len(r[3] or b""))

    return media.select("doc_id", "media").mapInArrow(lean(run), f"doc_id {key}, width int, height int, rgb binary")


def feature(rgb: np.ndarray) -> str:
    """Size, channel means in hundredths and a 64-bit average hash of an 8 x 8 grid of green."""
    height, width, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    means = (100 * sums // (height * width)).tolist()
    rows, cols = np.arange(8) * height // 8, np.arange(8) * width // 8
    grid = np.add.reduceat(np.add.reduceat(rgb[:, :, 1].astype(np.int64), rows, 0), cols, 1)
    share = np.outer(np.diff(np.append(rows, height)), np.diff(np.append(cols, width)))
    high = grid * (height * width) > sums[1] * share
    return f"{width}x{height}:{means[0]}:{means[1]}:{means[2]}:{np.packbits(high.ravel()).tobytes().hex()}"


_READ = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
_READ_SQL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def tensors(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, per row of (doc_id, n_bytes, media), and the full-resolution tensor: width, height, rgb."""
    key = media.schema["doc_id"].dataType.simpleString()
    fields = [*_READ, ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n, value in zip(*(batch.column(k) for k in range(3))):
                    raw = value.as_py()
                    image = jpeg.decode(raw)
                    payload, rgb = jpeg.stored_payload(image), image.rgb()
                    yield doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), rgb.shape[1], rgb.shape[0], rgb.tobytes()

        yield from _batches(rows(), pa.schema([("doc_id", _arrow(key)), *fields]), lambda r: len(r[-1]))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), f"doc_id {key}, {_READ_SQL}, width int, height int, rgb binary")


def featured(stored: DataFrame) -> DataFrame:
    """Rows of tensors() with the feature of their tensor in its place."""
    key = stored.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", *(n for n, _ in _READ)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, width, height, rgb = batch.columns
            found = [feature(np.frombuffer(x.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), 3)) for w, h, x in zip(width, height, rgb)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=[*kept, "feature"])

    return stored.select(*kept, "width", "height", "rgb").mapInArrow(lean(run), f"doc_id {key}, {_READ_SQL}, feature string")


def describe(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, per row of (doc_id, n_bytes, media): sizes, checksums and the feature of the tensor."""
    return featured(tensors(media))
