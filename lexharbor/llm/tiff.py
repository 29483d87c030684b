"""TIFF columns: texts stored as grey-scale pages, and pages decoded from stored files.

Reads both byte orders, strips and tiles, no compression, LZW, deflate and PackBits, horizontal
differencing, 8 and 16 bits a sample and several samples a pixel, together or in planes; one row for each page.
What a file claims is checked before it is believed; a broken one gives a row that says why.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import utf8

#: The numbers that the format gives its fields and compressions.
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG, STRIP_OFFSETS, SAMPLES_TAG = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR_TAG, PREDICTOR_TAG, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 278, 279, 284, 317, 322, 323, 324, 325
SHORTS = {BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG, SAMPLES_TAG, PLANAR_TAG, PREDICTOR_TAG}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
SIZES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
#: Samples in a row of a page and rows in a page at most, and rows of a strip (of a tile: as many as samples).
WIDTH, PAGE_ROWS, STRIP = 64, 4096, 512
#: Bytes of decoded pixels that a page may have.
PAGE_BYTES = 1 << 28
PAGES = "doc_id long, page int, width int, height int, compression int, predictor int, tiled boolean, bits int, samples int, pixels binary, error string"
#: Sixteenths of the texts that are stored with each codec.
SHARES = [LZW] * 3 + [PACKBITS] * 3 + [NONE] * 2 + [DEFLATE] * 8


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    for m in re.finditer(rb"(.)\1{2,127}", data, re.S):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, done = [], 0, 0
    while i < len(data) and done < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + n + 2])
            i += n + 2
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
            i += 1 if n == 128 else 2
        done += len(out[-1]) if out else 0
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Most significant bits first; 256 clears the table, 257 ends; codes widen one early."""
    table: dict[int, int] = {}  # by code of the word so far and next byte
    new, width, codes, held, n = 258, 9, bytearray(), 256, 9
    word = -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = word << 8 | byte
        if longer in table:
            word = table[longer]
            continue
        held, n = held << width | word, n + width
        table[longer] = new
        new += 1
        if new + 1 > 1 << width:
            width += 1
        if new == 4094:
            held, n = held << width | 256, n + width
            table, new, width = {}, 258, 9
        if n >= 1024:
            cut = n % 8
            codes += (held >> cut).to_bytes(n // 8, "big")
            held, n = held & ((1 << cut) - 1), cut
        word = byte
    if word >= 0:
        held, n = held << width | word, n + width
        if new + 2 > 1 << width and width < 12:
            width += 1
    held, n = held << width | 257, n + width
    bits = -n % 8
    return bytes(codes + (held << bits).to_bytes((n + bits) // 8, "big"))


def unlzw(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, n, last, done = list(base), [], 9, 0, 0, None, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257 or done >= size:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("a code beyond the table")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        out.append(word)
        done += len(word)
        last = word
    return b"".join(out)


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, size))


CODECS = {NONE: (bytes, lambda x, _: bytes(x)), LZW: (lzw, unlzw), DEFLATE: (lambda x: zlib.compress(x, 1), _inflate), OLD_DEFLATE: (lambda x: zlib.compress(x, 1), _inflate), PACKBITS: (packbits, unpackbits)}


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tiled: bool = False) -> bytes:
    """A little-endian file of pages 64 samples wide; the payload's size is a positive multiple of 64. The format has a predictor with LZW and deflate only."""
    if predictor != 1 and compression not in (LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError("a predictor needs LZW or deflate")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        offsets, counts, step = [], [], WIDTH if tiled else STRIP
        for y in range(0, len(page), step):
            part = page[y : y + step]
            if tiled and len(part) < step:
                part = np.concatenate((part, np.zeros((step - len(part), WIDTH), dtype=np.uint8)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), dtype=np.uint8))
            data = CODECS[compression][0](part.tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH_TAG, [WIDTH]), (HEIGHT_TAG, [len(page)]), (BITS_TAG, [8]), (COMPRESSION_TAG, [compression]), (PHOTOMETRIC_TAG, [1]), (SAMPLES_TAG, [1]), (PLANAR_TAG, [1])]
        fields += [(PREDICTOR_TAG, [predictor])] if predictor != 1 else []
        fields += [(TILE_WIDTH, [WIDTH]), (TILE_HEIGHT, [WIDTH]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tiled else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [STRIP]), (STRIP_COUNTS, counts)]
        entries = b""
        for tag, values in sorted(fields):
            packed = struct.pack("<H2x", *values) if tag in SHORTS else struct.pack(f"<{len(values)}I", *values)
            if len(packed) > 4:
                where = len(out)
                out += packed
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, 3 if tag in SHORTS else 4, len(values)) + packed
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory, in the order of their chain; a chain that turns back ends."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n, fields = struct.unpack_from(order + "H", data, at)[0], {0: [order == "<"]}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in SIZES:
                size, where = count * struct.calcsize(order + SIZES[kind]), at + 10 + 12 * i
                if size > len(data):
                    raise ValueError(f"field {tag} is longer than the file")
                fields[tag] = list(struct.unpack_from(f"{order}{count}{SIZES[kind]}", data, where if size <= 4 else struct.unpack_from(order + "I", data, where)[0]))
        yield fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, list[int]]) -> tuple:
    one = lambda tag, default: (f.get(tag) or [default])[0]
    width, height, bits, samples = one(WIDTH_TAG, 0), one(HEIGHT_TAG, 0), one(BITS_TAG, 1), one(SAMPLES_TAG, 1)
    compression, predictor, tiled, planes = one(COMPRESSION_TAG, NONE), one(PREDICTOR_TAG, 1), TILE_OFFSETS in f, one(PLANAR_TAG, 1) == 2
    if set(f.get(BITS_TAG, [bits])) != {bits} or bits not in (8, 16):
        raise ValueError(f"{f.get(BITS_TAG)} bits a sample")
    if compression not in CODECS or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor}")
    if not width * height * samples or width * height * samples * bits // 8 > PAGE_BYTES:
        raise ValueError(f"{width} by {height} pixels of {samples} samples")
    kind = np.dtype("u1" if bits == 8 else "<u2" if f[0][0] else ">u2")
    wide, tall = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not 0 < wide * tall * samples * bits // 8 <= PAGE_BYTES:
        raise ValueError(f"pieces of {wide} by {tall} pixels")
    offsets, counts = f.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), f.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    across, deep = -(-width // wide), samples if planes else 1
    each, depth = across * -(-height // tall), 1 if planes else samples
    if len(offsets) != each * deep or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} pieces instead of {each * deep}")
    out = np.zeros((height, width, samples), dtype=kind)
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i % each // across * tall, i % each % across * wide
        rows = tall if tiled else min(tall, height - y)
        part = np.frombuffer(CODECS[compression][1](data[offset : offset + count], rows * wide * depth * kind.itemsize), dtype=kind, count=rows * wide * depth).reshape(rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + wide, i // each if planes else slice(None)] = part[: height - y, : width - x, 0 if planes else slice(None)]
    return width, height, compression, predictor, tiled, bits, samples, (out if bits == 8 else out.astype(">u2")).tobytes()


def pages(data: bytes) -> Iterator[tuple]:
    """page, width, height, compression, predictor, tiled, bits, samples, pixels (row by row, big-endian if 16 bits).

    ValueError, struct.error, zlib.error or IndexError where the file is broken.
    """
    for number, f in enumerate(directories(data)):
        yield number, *_page(data, f)


def _stored(texts: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, bytes]]:
    for batch in texts:
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            payload = text + b"\0" * (64 if not text else -len(text) % 64)
            choice = zlib.crc32(payload)
            codec = SHARES[choice % 16]
            yield doc, len(text), encode(payload, codec, 1 + (codec in (LZW, DEFLATE) and choice >> 5 & 1), choice >> 4 & 1 == 1)


def text_to_tiff(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as UTF-8 with zero bytes up to a positive multiple of 64, in one file.

    Compression and layout depend on the text alone. Repeated rows give repeated files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, n, media in _stored(batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([n], pa.int64()), pa.array([media], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame) -> DataFrame:
    """One row per page of files (doc_id, media); a null file has no pages.

    A page that can't be read gives a row with its number and the reason in ``error``, all else null, and is the
    file's last. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page", "width", "height", "compression", "predictor", "tiled", "bits", "samples", "pixels", "error"]
        kinds = [pa.bool_() if n == "tiled" else pa.binary() if n == "pixels" else pa.string() if n == "error" else pa.int32() for n in names]
        for batch in batches:
            for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                made, at = pages(media if media is not None else b""), 0
                while media is not None:
                    try:
                        row = (*next(made), None)
                    except StopIteration:
                        break
                    except (ValueError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as wrong:
                        row = (at, *[None] * 8, str(wrong) or type(wrong).__name__)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *(pa.array([x], k) for x, k in zip(row, kinds, strict=True))], ["doc_id", *names])
                    at += 1
                    if row[-1] is not None:
                        break

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, PAGES)


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text stored and read back as above within one task: sizes, hashes and features, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for doc, n, media in _stored(batches):
            sha, size, tail, total, squares, high, count, form = hashlib.sha256(), 0, b"", 0, 0, 0, 0, (0, 0, False)
            for p in pages(media):
                sha.update(p[8])
                a = np.frombuffer(p[8], dtype=np.uint8)
                size, tail, count, form = size + len(a), p[8][-64:], count + 1, (p[3], p[4], p[5])
                histogram = np.bincount(a, minlength=256).astype(object)
                total += int((histogram * np.arange(256)).sum())
                squares += int((histogram * np.arange(256) ** 2).sum())
                high = max(high, int(a.max()))
            feature = f"pages={count};compression={form[0]};predictor={form[1]};tiled={int(form[2])};sum={total};squares={squares};max={high}"
            rows.append((doc, n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            if len(rows) == 1000:
                yield made()
                rows.clear()
        if rows:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
