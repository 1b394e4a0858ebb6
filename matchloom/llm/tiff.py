"""Media columns in TIFF: one row per page, decoded without an imaging library.

``read_pages`` walks the chain of image directories of a TIFF file (either byte order, up to 16 bits a sample), decodes
strips or tiles stored raw, as PackBits, LZW or deflate, undoes the horizontal predictor and yields one page at a time.
``write_tiff`` is its counterpart for 8-bit grey pages; every compression it writes is read back exactly.

``text_media`` stores any byte string losslessly: padded with 255 to rows of 576 samples, all rows but the last as
a page of deflate strips, the last row as a 24 x 24 page of PackBits tiles with predictor 2.

Defined cases: null and empty texts make one row of padding; a chain of directories that loops, or a strip that ends
early, raises ``ValueError``; equal texts give equal files; repeated rows keep their rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, read_table, spread

# Fixed values of the format: tag numbers and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

ROW = 576


@dataclass(frozen=True)
class Page:
    """One decoded page; samples has the shape (height, width, samples per pixel)."""

    number: int
    width: int
    height: int
    compression: int
    samples: np.ndarray


def packbits_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    i = 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes as repeats, everything else as literals of at most 128."""
    if not data:
        return b""
    values = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    out = bytearray()
    literal = 0

    def flush(upto: int) -> None:
        for k in range(literal, upto, 128):
            piece = data[k : min(upto, k + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end - start < 3:
            continue
        flush(start)
        for k in range(start, end, 128):
            n = min(end - k, 128)
            out += bytes([257 - n if n > 1 else 0, data[start]])
        literal = end
    flush(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """The format's LZW: most significant bit first, 9 to 12 bits, 256 clears, 257 ends, early change of width."""
    out = bytearray()
    table: list[bytes] = []
    width, buffer, have = 9, 0, 0
    last = b""
    for byte in data:
        buffer = buffer << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = buffer >> have
        buffer &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            entry = bytes([code])
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif last and code - 258 == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code outside the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 259 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    buffer = have = 0
    width = 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal buffer, have
        buffer = buffer << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(buffer >> have & 255)
        buffer &= (1 << have) - 1

    put(256)
    word = b""
    for value in data:
        longer = word + bytes([value])
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = 258 + len(table)
        word = longer[-1:]
        if 258 + len(table) >= 4094:
            put(256)
            table, width = {}, 9
        elif len(table) + 258 >= 1 << width:
            width += 1
    if word:
        put(table[word] if len(word) > 1 else word[0])
        if len(table) + 259 >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(buffer << 8 - have & 255)
    return bytes(out)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        plain = data
    elif compression == PACKBITS:
        plain = packbits_decode(data, size)
    elif compression == LZW:
        plain = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        plain = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(plain) < size:
        raise ValueError("a strip or tile ends early")
    return plain[:size]


def _directory(data: bytes, order: str, offset: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, offset)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        at = offset + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, at)
        size = _TYPE_SIZES.get(kind, 1) * count
        start = at + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, start))
    return tags, struct.unpack_from(order + "I", data, offset + 2 + 12 * n)[0]


def _block(data: bytes, order: str, tags: dict[int, list[int]], at: int, size: int, rows: int, columns: int, per_pixel: int, bits: int) -> np.ndarray:
    compression = tags.get(COMPRESSION, [RAW])[0]
    plain = _decode(data[at : at + size], compression, rows * columns * per_pixel * bits // 8)
    samples = np.frombuffer(plain, dtype=np.uint8 if bits == 8 else np.dtype(np.uint16).newbyteorder(order)).reshape(rows, columns, per_pixel)
    if tags.get(PREDICTOR, [1])[0] == 2:
        samples = np.cumsum(samples, axis=1, dtype=samples.dtype.newbyteorder("="))
    return samples


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (offset,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while offset:
        if offset in seen:
            raise ValueError("the directories form a loop")
        seen.add(offset)
        tags, offset = _directory(data, order, offset)
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        per_pixel = tags.get(SAMPLES, [1])[0]
        bits = tags.get(BITS, [1])[0]
        if bits not in (8, 16):
            raise ValueError(f"{bits} bits a sample are not supported")
        out = np.zeros((height, width, per_pixel), dtype=np.uint8 if bits == 8 else np.uint16)
        if TILE_OFFSETS in tags:
            tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
            across = -(-width // tw)
            for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS])):
                y, x = k // across * th, k % across * tw
                tile = _block(data, order, tags, at, size, th, tw, per_pixel, bits)
                out[y : y + th, x : x + tw] = tile[: height - y, : width - x]
        else:
            step = min(height, tags.get(ROWS_PER_STRIP, [height])[0])
            for k, (at, size) in enumerate(zip(tags[STRIP_OFFSETS], tags[STRIP_COUNTS])):
                rows = min(step, height - k * step)
                out[k * step : k * step + rows] = _block(data, order, tags, at, size, rows, width, per_pixel, bits)
        yield Page(len(seen) - 1, width, height, tags.get(COMPRESSION, [RAW])[0], out)


def _encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), dtype=np.uint8))
    plain = block.tobytes()
    return {RAW: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](plain)


def write_tiff(pages: list[tuple[np.ndarray, dict[str, int]]], order: str = "<") -> bytes:
    """Grey 8-bit pages; options of a page: compression, predictor, and either rows (a strip) or tile (its side)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, options in pages:
        height, width = image.shape
        compression, predictor = options.get("compression", RAW), options.get("predictor", 1)
        tile = options.get("tile")
        blocks = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), dtype=np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            step = options.get("rows", height)
            blocks = [image[y : y + step] for y in range(0, height, step)]
        offsets, sizes = [], []
        for block in blocks:
            data = _encode(block, compression, predictor)
            out += b"\0" * (len(out) % 2)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: sizes} if tile else {ROWS_PER_STRIP: [step], STRIP_OFFSETS: offsets, STRIP_COUNTS: sizes}
        entries = b""
        for tag in sorted(tags):
            values = tags[tag]
            if len(values) > 1:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
                entries += struct.pack(order + "HHII", tag, 4, len(values), place)
            else:
                entries += struct.pack(order + "HHII", tag, 4, 1, values[0])
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def text_media(text: str | None) -> tuple[int, bytes]:
    """Length in bytes of a text and the file that stores it."""
    data = (text or "").encode("utf-8", "replace")
    rows = max(1, -(-len(data) // ROW))
    samples = np.full(rows * ROW, 255, dtype=np.uint8)
    samples[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    pages: list[tuple[np.ndarray, dict[str, int]]] = []
    if rows > 1:
        pages.append((samples[:-ROW].reshape(rows - 1, ROW), {"compression": DEFLATE, "rows": 64}))
    pages.append((samples[-ROW:].reshape(24, 24), {"compression": PACKBITS, "predictor": 2, "tile": 16}))
    return len(data), write_tiff(pages)


def page_rows(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per page of a binary column ``media``: id, page, width, height, compression, pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                for page in read_pages(data.as_py()):
                    yield pa.RecordBatch.from_pylist(
                        [{"id": key.as_py(), "page": page.number, "width": page.width, "height": page.height, "compression": page.compression, "pixels": page.samples.tobytes()}],
                        pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary())]),
                    )

    from ..session import ensure_importable

    ensure_importable(media.sparkSession)
    return media.select(F.col(id_column).alias("id"), "media").where(F.col("media").isNotNull()).mapInArrow(run, "id long, page int, width int, height int, compression int, pixels binary")


def page_feature(pixels: np.ndarray) -> str:
    """Mean and spread of the samples, and the shares of 16 grey levels in 255ths (hex)."""
    histogram = np.bincount(pixels, minlength=256)
    levels = np.arange(256)
    n = int(histogram.sum())
    mean = float((histogram * levels).sum()) / n
    spread = (float((histogram * levels**2).sum()) / n - mean * mean) ** 0.5
    shares = histogram.reshape(16, 16).sum(axis=1) * 255 // n
    return f"{mean:.3f}/{spread:.3f}/{bytes(shares.tolist()).hex()}"


def op8_tiff(spark, sf_dir: str) -> DataFrame:
    """Each document stored as a TIFF file, read back page by page, and described."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for text in batch.column(1):
            size, media = text_media(text.as_py())
            pages = list(read_pages(media))
            pixels = np.concatenate([p.samples.reshape(-1) for p in pages])
            payload = pixels.tobytes()
            values = (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), page_feature(pixels), len(pages))
            for column, value in zip(columns, values):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return map_batches(docs, schema, run)
