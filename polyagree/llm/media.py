"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, tiles as NPY, difference hashes.

Any bytes can be kept losslessly as 8-bit samples of a PPM image; reading decodes the stored bytes, not the originals.

Memory: what a task holds of images is a few blocks of BATCH rows in the readers of stored tables, row groups of GROUP bytes in their
writers, and one image in Python, whose samples are hashed where they are.

Cases: null bytes count as empty; what is no image of a known kind raises ValueError; repeated rows are stored each, equal
bytes give equal images; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ACROSS, CHANNELS = 64, 3
TILE = (8, 9)  # rows, columns: a difference hash of 64 bits
#: Rows that a reader of stored tables takes at once, and bytes of a row group of images.
BATCH, GROUP = 512, 16 << 20


def encode_ppm(samples: np.ndarray) -> bytes:
    """Binary PPM (P6) of an array rows x columns x 3 of bytes."""
    rows, columns, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (columns, rows) + samples.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x channels, bytes (two-byte samples are scaled to bytes)."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("neither Netpbm nor BMP")
    kind, at, numbers = int(data[1:2]), 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header without its numbers")
        numbers.append(int(data[at:end]))
        at = end
    columns, rows, most = (*numbers, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    count = rows * columns * channels
    if kind == 4:
        packed = np.frombuffer(data, np.uint8, rows * ((columns + 7) // 8), at + 1).reshape(rows, -1)
        return (255 * (1 - np.unpackbits(packed, axis=1)[:, :columns]))[:, :, None].astype(np.uint8)
    if kind < 4:
        body = data[at:].split()
        body = [bytes([c]) for c in b"".join(body)] if kind == 1 else body
        values = np.array([int(x) for x in body[:count]], np.int64)
        values = 1 - values if kind == 1 else values
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(values) != count:
        raise ValueError("a Netpbm image that ends early")
    return (values if most == 255 else (values.astype(np.int64) * 255 + most // 2) // max(most, 1)).astype(np.uint8, copy=False).reshape(rows, columns, channels)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("a BMP that ends in its header")
    begin, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    columns, rows, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (8, 24, 32) or packed:
        raise ValueError("a BMP of a kind that is not read")
    stride = (columns * bits // 8 + 3) // 4 * 4
    if columns < 1 or len(data) < begin + stride * abs(rows):
        raise ValueError("a BMP that ends early")
    lines = np.frombuffer(data, np.uint8, stride * abs(rows), begin).reshape(abs(rows), stride)[:, : columns * bits // 8]
    lines = lines[::-1] if rows > 0 else lines
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, begin - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
        return palette[lines]
    return lines.reshape(abs(rows), columns, bits // 8)[:, :, 2::-1]


def _averages(values: np.ndarray, n: int) -> np.ndarray:
    """Mean over n equal stretches of the first axis, from its integral; stretches may end within a cell."""
    size = len(values)
    integral = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    at = np.arange(n + 1) * (size / n)
    low = np.minimum(at.astype(np.int64), size - 1)
    upto = integral[low] + (at - low).reshape(-1, *[1] * (values.ndim - 1)) * values[low]
    return np.diff(upto, axis=0) / (size / n)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the areas of a grid, by integrals along both axes, a few thousand lines at a time."""
    lines = [_averages(np.ascontiguousarray(image[i : i + 4096].mean(axis=2).T), columns).T for i in range(0, len(image), 4096)]
    return _averages(np.concatenate(lines), rows)


def difference_hash(tile: np.ndarray) -> int:
    tile = np.round(tile, 6)  # what sums leave of equal areas is no difference
    bits = tile[:, 1:] > tile[:, :-1]
    return int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def _stored(batches):
    import pyarrow as pa

    unit = ACROSS * CHANNELS
    for b in batches:
        raw, at = shared.buffer_of(b.column(1))
        media = []
        for i in range(b.num_rows):
            n = int(at[i + 1] - at[i])
            samples = np.full(max(1, -(-n // unit)) * unit, 32, np.uint8)
            samples[:n] = raw[at[i] : at[i + 1]]
            media.append(encode_ppm(samples.reshape(-1, ACROSS, CHANNELS)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def bounded(spark) -> None:
    """Let readers of wide rows take fewer at once; a session's own setting stays."""
    shared.prepare(spark)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key) == "4096":
        spark.conf.set(key, BATCH)


def store(rows: DataFrame, data: str = "text") -> DataFrame:
    """Write doc_id, n_bytes and the image that holds each row's bytes, padded by spaces, as a table; read it again."""
    bounded(rows.sparkSession)
    made = rows.select(F.col("doc_id").cast("long"), shared.text_bytes(data).alias("data")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")
    return shared.staged(made, "media", group=GROUP)


def _described(batches):
    import pyarrow as pa

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "feature")
    for b in batches:
        out: dict[str, list] = {n: [] for n in names}
        for media in b.column(2):
            data = media.as_buffer().to_pybytes()
            image = decode(data)
            payload = memoryview(np.ascontiguousarray(image)).cast("B")
            tile = area_resize(image, *TILE)
            for n, x in zip(names, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), npy(np.rint(tile).astype(np.uint8)), f"{difference_hash(tile):016x}")):
                out[n].append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(out[n], k) for n, k in zip(names, kinds))], ["doc_id", "n_bytes", *names])


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tile (NPY) and feature (hex) of stored images."""
    shared.prepare(stored.sparkSession)
    return stored.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string")


def store_tiles(stored: DataFrame) -> DataFrame:
    """Write what describe() says of stored images, NPY tiles and hashes with it, as a table beside them; read it again."""
    return shared.staged(describe(stored), "tiles")
