"""Operator 2: TIFF media columns.

`read_pages` walks the chain of image directories of a file, in either byte order, decodes strips or tiles stored
plainly or with PackBits, LZW or deflate, undoes horizontal differencing, and gives one page per directory. `write`
makes such files from 8-bit grey pages. `decode_tiff` emits one row per page of a binary column.

A null or broken file gives one row with page -1 and the reason in `error` (null: 'null'); an empty file is broken.
Repeated rows are decoded each for itself, and the caller's other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, table

# Fixed values of the TIFF 6.0 format: tags and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_KINDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}

#: Width of a page of text, and rows of a page at most.
TEXT_WIDTH, PAGE_ROWS = 192, 256


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(raw: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n and len(out) < size:
        k = raw[i]
        if k < 128:
            out += raw[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += raw[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, all else as literals."""
    if not raw:
        return b""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1], [True]]))
    length = np.diff(edges)
    out, done = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = raw[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for at, n in zip(edges[:-1][length > 2].tolist(), length[length > 2].tolist()):
        literal(done, at)
        for i in range(at, at + n, 128):
            k = min(128, at + n - i)
            if k == 1:
                out += bytes([0, raw[at]])
            else:
                out += bytes([257 - k, raw[at]])
        done = at + n
    literal(done, len(raw))
    return bytes(out)


def _lzw_widths(n: int) -> np.ndarray:
    """Bit widths of the first n codes after a clear code, as the encoder's table grows."""
    entries = 258 + np.arange(n)
    return np.select([entries < 512, entries < 1024, entries < 2048], [9, 10, 11], 12)


#: Codes between two clear codes, so that the table never passes 4094 entries.
_LZW_RUN = 3836


def pack_lzw(raw: bytes) -> bytes:
    codes, widths = [256], [9]
    singles = {bytes([i]): i for i in range(256)}
    known, now, start = dict(singles), b"", 1
    for b in map(raw.__getitem__, map(slice, range(len(raw)), range(1, len(raw) + 1))):
        grown = now + b
        if grown in known:
            now = grown
            continue
        codes.append(known[now])
        known[grown] = len(known) + 2
        now = b
        if len(codes) - start == _LZW_RUN:
            codes.append(256)
            start, known = len(codes), dict(singles)
    if now:
        codes.append(known[now])
    codes.append(257)
    codes = np.array(codes, np.int64)
    clears = np.flatnonzero(codes == 256)
    widths = np.empty(len(codes), np.int64)
    widths[0] = 9
    for a, b in zip(clears, [*clears[1:], len(codes) - 1]):
        widths[a + 1 : b + 1] = _lzw_widths(b - a)
    ends = np.cumsum(widths)
    bits = np.zeros((int(ends[-1]) + 7) // 8 * 8, np.uint8)
    for w in (9, 10, 11, 12):
        at = np.flatnonzero(widths == w)
        if len(at):
            where = (ends[at] - w)[:, None] + np.arange(w)
            bits[where] = (codes[at][:, None] >> np.arange(w - 1, -1, -1)) & 1
    return np.packbits(bits).tobytes()


def unpack_lzw(raw: bytes, size: int) -> bytes:
    out, done, total = [], 0, len(raw) * 8
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    entries, last, at, width, acc, have, i = list(singles), b"", 0, 9, 0, 0, 0
    limit = 511
    while done < size:
        while have < width:
            if i >= len(raw):
                return b"".join(out)
            acc = (acc & 0xFFFF) << 8 | raw[i]
            i += 1
            have += 8
        have -= width
        code = acc >> have & ((1 << width) - 1)
        if code == 256:
            entries, last, width, limit = list(singles), b"", 9, 511
            continue
        if code == 257:
            break
        if last:
            n = len(entries)
            if code < n:
                word = entries[code]
            elif code == n:
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of order")
            entries.append(last + word[:1])
            if n + 1 >= limit and width < 12:
                width += 1
                limit = (1 << width) - 1
        else:
            word = entries[code]
        out.append(word)
        done += len(word)
        last = word
    return b"".join(out)


def _unpack(raw: bytes, scheme: int, size: int) -> bytes:
    if scheme == PLAIN:
        return raw
    if scheme == PACKBITS:
        return unpack_bits(raw, size)
    if scheme == LZW:
        return unpack_lzw(raw, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    raise ValueError(f"compression {scheme} is not supported")


def _pack(raw: bytes, scheme: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[scheme](raw)


def read_pages(raw: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", raw, 4), set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind in _KINDS:
                code, width = _KINDS[kind]
                where = at + 10 + 12 * i if count * width <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        yield _page(raw, tags)
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def _page(raw: bytes, tags: dict) -> Page:
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    scheme, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples in one plane are supported")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    if TILE_OFFSETS in tags:
        across, down, places = one(TILE_WIDTH), one(TILE_LENGTH), zip(tags[TILE_OFFSETS], tags[TILE_COUNTS])
    else:
        across, down, places = width, min(height, one(ROWS_PER_STRIP, height)), zip(tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    image, columns = np.zeros((height, width, samples), np.uint8), -(-width // across)
    for k, (at, n) in enumerate(places):
        y, x = k // columns * down, k % columns * across
        rows = down if TILE_OFFSETS in tags else min(down, height - y)
        part = _unpack(bytes(raw[at : at + n]), scheme, rows * across * samples)
        if len(part) < rows * across * samples:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(part, np.uint8, rows * across * samples).reshape(rows, across, samples)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return Page(width, height, samples, scheme, predictor, image.tobytes())


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: int = 0) -> bytes:
    """A little-endian file with a directory for each 8-bit grey page (height, width), in strips, or in square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width = page.shape
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places = []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], 1)
            packed = _pack(block.tobytes(), compression)
            places.append((len(out), len(packed)))
            out += packed + b"\0" * (len(packed) & 1)
        entries = [(WIDTH, (width,)), (LENGTH, (height,)), (BITS, (8,)), (COMPRESSION, (compression,)), (PHOTOMETRIC, (1,)), (SAMPLES, (1,)), (PREDICTOR, (predictor,))]
        spots, counts = zip(*places)
        entries += [(TILE_WIDTH, (tile,)), (TILE_LENGTH, (tile,)), (TILE_OFFSETS, spots), (TILE_COUNTS, counts)] if tile else [(ROWS_PER_STRIP, (rows_per_strip,)), (STRIP_OFFSETS, spots), (STRIP_COUNTS, counts)]
        fields = b""
        for tag, values in sorted(entries):
            value = struct.pack(f"<{len(values)}I", *values)
            if len(value) > 4:
                where = len(out)
                out += value
                value = struct.pack("<I", where)
            fields += struct.pack("<HHI", tag, 4, len(values)) + value
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode_tiff(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page: id, page (from 0), width, height, samples, compression, predictor, pixels, error."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows = []
            for key, raw in enumerate(b.column(1).to_pylist()):
                try:
                    if raw is None:
                        raise ValueError("null")
                    rows += [(key, i, *page, None) for i, page in enumerate(read_pages(raw))]
                except (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError) as e:
                    rows.append((key, -1, None, None, None, None, None, None, str(e)))
            columns = list(zip(*rows)) if rows else [()] * 9
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names)

    kind = dict(media.dtypes)[id_col]
    ids = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    names = ["id", "page", "width", "height", "samples", "compression", "predictor", "pixels", "error"]
    kinds = [*[pa.int32()] * 6, pa.binary(), pa.string()]
    return mapped(ids, run, f"id {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string").withColumnRenamed("id", id_col)


def text_media(text: str | None) -> tuple[int, bytes]:
    """The bytes of the text, and the file that stores them, padded with spaces to whole rows.

    The scheme follows the payload's checksum: strips or tiles, with and without differencing.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b" " * (TEXT_WIDTH - len(raw) % TEXT_WIDTH if raw and len(raw) % TEXT_WIDTH else 0 if raw else TEXT_WIDTH)
    image = np.frombuffer(payload, np.uint8).reshape(-1, TEXT_WIDTH)
    pages = [image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]
    how = zlib.crc32(payload) & 7
    compression = (DEFLATE, DEFLATE, DEFLATE, DEFLATE, PACKBITS, PACKBITS, PLAIN, LZW)[how]
    return len(raw), write(pages, compression, predictor=2 if how in (1, 3) else 1, tile=64 if how in (2, 3) else 0)


def feature(payload: np.ndarray) -> str:
    """Counts of letters, digits, spaces, other ASCII and other bytes, and the mean of the samples in thousandths."""
    counts = np.bincount(payload, minlength=256)
    letters, digits = int(counts[65:91].sum() + counts[97:123].sum()), int(counts[48:58].sum())
    other = int(counts[:128].sum()) - letters - digits - int(counts[32])
    return f"letters={letters};digits={digits};spaces={int(counts[32])};ascii={other};high={int(counts[128:].sum())};mean={int(counts @ np.arange(256)) * 1000 // len(payload)}"


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a file, reads its pages back and describes both."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for text in b.column(1).to_pylist():
                n, media = text_media(text)
                pages = list(read_pages(media))
                payload = b"".join(p.pixels for p in pages)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(pages)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
