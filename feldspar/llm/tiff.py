"""TIFF media columns: walk the image directories of a file, decode its strips or tiles (none, PackBits,
LZW, deflate), undo predictors, and emit one row per page; and a writer for the same forms.

Reads both byte orders, classic files, chunky and planar samples of any depth (rows of bytes in the file's
byte order), strips and tiles, fill order 1, horizontal differencing (predictor 2) on samples of 8, 16, 32 and 64
bits and floating-point differencing (predictor 3) on samples of 16, 24, 32 and 64.  Sub-directories and
thumbnails are not pages.

Rules: null or empty media give no rows.  A page that is damaged or of another form gives a row whose error
column says what is wrong (samples null there), and the walk goes on; it ends with such a row where a directory itself
can't be read.  Nothing raises.  A directory that was visited already ends the walk.  Equal media give equal rows.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, map_rows, pick, spread

#: Fixed values of the format: tag numbers, bytes of each field type, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1, 8: 2, 9: 4}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
#: Bytes that a compressed byte gives at most, over all schemes.
EXPANDS = 4096
#: How op1 stores a payload: pixels of a row, bytes of a strip, sides of a tile.
ROW, STRIP_BYTES, TILE = 64, 8192, 64


# ---- codecs -------------------------------------------------------------------------------------


_RUNS = re.compile(rb"(.)\1{2,}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as runs, the rest as literals, 128 at most each."""
    out, at = [], 0

    def literals(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUNS.finditer(data):
        literals(at, m.start())
        left, byte = m.end() - m.start(), m[1]
        while left > 1:
            n = min(128, left)
            out.append(bytes([257 - n]) + byte)
            left -= n
        at = m.end() - left
    literals(at, len(data))
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            if len(part) < n + 1:
                raise ValueError("PackBits literals end early")
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        have += len(part)
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, as the format's early change has it."""
    i = np.arange(n)
    return np.where(i < 254, 9, np.where(i < 766, 10, np.where(i < 1790, 11, 12)))


#: After so many codes the table is full and a clear code follows.
_FULL = 3837
_WIDTHS = _widths(_FULL + 300)
_ENDS = np.cumsum(_WIDTHS)


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = [CLEAR]
    first = {bytes([i]): i for i in range(256)}
    table, word, begun, segments = dict(first), b"", 1, []
    get = table.get
    code, new = -1, 258
    for b in data:
        longer = word + _BYTE[b]
        known = get(longer)
        if known is not None:
            word, code = longer, known
            continue
        codes.append(code)
        table[longer] = new
        new += 1
        word, code = _BYTE[b], b
        if new == 258 + _FULL - 1:
            segments.append(codes)
            table, codes, new = dict(first), [CLEAR], 258
            get = table.get
    if word:
        codes.append(code)
    segments.append([*codes, END])
    return _pack(segments)


_BYTE = [bytes([i]) for i in range(256)]


def _pack(segments: list[list[int]]) -> bytes:
    """Codes as bits, most significant first.  A segment's own codes start with width 9; the clear code that
    opens the next has the width that the table then asks for."""
    values, widths = [], []
    before = 9
    for codes in segments:
        n = np.array(codes, np.int64)
        w = np.concatenate([[before], _WIDTHS[: len(codes) - 1]])
        values.append(n)
        widths.append(w)
        before = int(_WIDTHS[len(codes) - 1])
    n, w = np.concatenate(values), np.concatenate(widths)
    ends = np.cumsum(w)
    bits = np.zeros(int(ends[-1]) + (-int(ends[-1])) % 8, np.uint8)
    for k in range(12):
        on = w > k
        bits[(ends - 1 - k)[on]] = (n[on] >> k) & 1
    return np.packbits(bits).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are unpacked a table's life at a time; each then copies earlier output: the string of a table
    entry is that of the code it was made at, and one byte more."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, bit = len(data) * 8, 0
    out = bytearray()
    while bit + 9 <= total and len(out) < size:
        # codes from here, as if the table had just been cleared
        n = int(np.searchsorted(_ENDS, total - bit, "right"))
        ends = _ENDS[:n] + bit
        starts = ends - _WIDTHS[:n]
        byte = starts >> 3
        window = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
        codes = (window >> (24 - (starts & 7) - _WIDTHS[:n])) & ((1 << _WIDTHS[:n]) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        begins: list[int] = []
        lengths: list[int] = []
        for code in codes[:stop].tolist():
            at = len(out)
            if code < 256:
                out.append(code)
                lengths.append(1)
            else:
                k = code - 258
                if k >= len(begins):
                    raise ValueError("LZW code outside its table")
                a, m = begins[k], lengths[k] + 1
                if a + m <= at:
                    out += out[a : a + m]
                else:  # the string of the entry just made ends with its own first byte
                    out += out[a:at]
                    out.append(out[a])
                lengths.append(m)
            begins.append(at)
        if stop == n or codes[stop] == END:
            break
        bit = int(ends[stop])
    return bytes(out)


def unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return packbits_decode(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, size))  # no more than the block should hold
    raise ValueError(f"compression {scheme} is not supported")


def pack(data: bytes, scheme: int) -> bytes:
    return {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[scheme](data)


# ---- reader -------------------------------------------------------------------------------------


def _next(data: bytes, at: int, order: str) -> int:
    """The offset of the directory after the one at that offset."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    return struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _fields(data: bytes, at: int, order: str) -> dict[int, list[int]]:
    """Whole-number fields of the directory at that offset."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(n):
        tag, type_, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        each = TYPE_BYTES.get(type_)
        if each is None:
            continue
        place = at + 10 + 12 * i
        if each * count > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + each * count > len(data):
            raise ValueError(f"field {tag} lies outside the file")
        fields[tag] = np.frombuffer(data, f"{order}u{each}", count, place).tolist()
    return fields


def _undo(block: np.ndarray, predictor: int, w: int, each: int, bits: int, order: str) -> np.ndarray:
    """Rows of bytes without their predictor, in the file's byte order."""
    rows, size = len(block), bits // 8
    if predictor == 2:
        kind = f"{order}u{size}"
        sums = np.cumsum(block.view(kind).reshape(rows, w, each), axis=1, dtype=f"u{size}")
        return sums.astype(kind).reshape(rows, -1).view(np.uint8)
    if predictor == 3:  # bytes of a row are differences; the samples' first bytes stand before all second ones
        planes = np.cumsum(block.reshape(rows, w * size, each), axis=1, dtype=np.uint8).reshape(rows, size, w * each)
        return (planes if order == ">" else planes[:, ::-1]).transpose(0, 2, 1).reshape(rows, -1)
    return block


def _image(data: bytes, f: dict[int, list[int]], order: str) -> tuple[int, int, int, int, int, bytes]:
    """width, height, samples, compression, predictor and the samples of one directory."""
    width, height = f[WIDTH][0], f[HEIGHT][0]
    samples, scheme = f.get(SAMPLES, [1])[0], f.get(COMPRESSION, [NONE])[0]
    predictor, planar = f.get(PREDICTOR, [1])[0], f.get(PLANAR, [1])[0]
    bits = f.get(BITS, [1])[0]
    planes = samples if planar == 2 else 1
    each = 1 if planar == 2 else samples  # samples of a pixel in one block
    tiled = TILE_OFFSETS in f
    w = f[TILE_WIDTH][0] if tiled else width
    h = f[TILE_HEIGHT][0] if tiled else min(height, f.get(ROWS_PER_STRIP, [height])[0])
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[OFFSETS], f[COUNTS])
    row = (w * each * bits + 7) // 8
    if bits not in {1: [bits], 2: [8, 16, 32, 64], 3: [16, 24, 32, 64]}.get(predictor, []):
        raise ValueError(f"predictor {predictor} with {bits} bits is not supported")
    loose = tiled and bits % 8 > 0  # put together bit by bit
    across, down = (-(-width // w), -(-height // h)) if height and width else (0, 0)
    if len(offsets) < across * down * planes:
        raise ValueError("blocks are missing")
    if (blocks := across * down * planes) * h * row > EXPANDS * (sum(counts[:blocks]) + 1):
        raise ValueError("the blocks are too short for the page")
    out = np.zeros((planes, height, width * each * bits if loose else (width * each * bits + 7) // 8), np.uint8)
    for k in range(blocks):
        plane, r, c = k // (across * down), k // across % down, k % across
        rows = h if tiled else min(h, height - r * h)
        if offsets[k] + counts[k] > len(data):
            raise ValueError("a block lies outside the file")
        got = unpack(data[offsets[k] : offsets[k] + counts[k]], scheme, rows * row)
        if len(got) < rows * row:
            raise ValueError("a block ends early")
        block = np.frombuffer(got, np.uint8, rows * row).reshape(rows, row)
        block = _undo(block, predictor, w, each, bits, order)
        rows = min(rows, height - r * h)
        if tiled:
            if loose:
                block = np.unpackbits(block, axis=1, count=w * each * bits)
            x = c * block.shape[1]
            out[plane, r * h : r * h + rows, x : x + block.shape[1]] = block[:rows, : out.shape[2] - x]
        else:
            out[plane, r * h : r * h + rows] = block[:rows]
    return width, height, samples, scheme, predictor, (np.packbits(out, axis=2) if loose else out).tobytes()


_WRONG = (ValueError, KeyError, IndexError, ArithmeticError, struct.error, zlib.error, MemoryError)


def _failed(page: int, e: Exception) -> tuple:
    return page, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def read_pages(data: bytes) -> list[tuple]:
    """(page, width, height, samples, compression, predictor, sample bytes, error) for each page."""
    pages: list[tuple] = []
    if not data:
        return pages
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen = set()
        while at and at not in seen:
            seen.add(at)
            here, at = at, _next(data, at, order)
            try:
                pages.append((len(pages), *_image(data, _fields(data, here, order), order), None))
            except _WRONG as e:
                pages.append(_failed(len(pages), e))
    except _WRONG as e:
        pages.append(_failed(len(pages), e))
    return pages


# ---- writer -------------------------------------------------------------------------------------


def write_pages(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<", planar: int = 1, strip_bytes: int = STRIP_BYTES) -> bytes:
    """A file with one directory for each image (height x width, or height x width x samples, 8 bits)."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        planes = [image[:, :, [s]] for s in range(samples)] if planar == 2 else [image]
        w, h = (TILE, TILE) if tiled else (width, max(1, strip_bytes // max(1, width * samples)))
        offsets, counts = [], []
        for plane in planes:
            for y in range(0, height, h):
                for x in range(0, width, w):
                    block = plane[y : y + h, x : x + w]
                    if tiled and block.shape[:2] != (h, w):
                        block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                    packed = pack(np.ascontiguousarray(block).tobytes(), scheme)
                    offsets.append(len(out))
                    counts.append(len(packed))
                    out += packed
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [planar]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tiled else [(OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (COUNTS, 4, counts)]
        entries = []
        for tag, type_, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{'H' if type_ == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, place = struct.pack(f"{order}I", len(out)), raw
                out += place
            entries.append(struct.pack(f"{order}HHI", tag, type_, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---- Spark --------------------------------------------------------------------------------------


def tiff_pages(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of every file: the key columns, media_bytes, media_sha256, page (from 0), width, height, samples_per_pixel, compression,
    predictor, samples (binary, rows from the top, planes one after the other) and error."""
    import hashlib

    def row(m, *k):
        if m:
            own = (*k, len(m), hashlib.sha256(m).hexdigest())
            for p in read_pages(m):
                yield own + p

    df = pick(df, media, *keys)
    schema = ", ".join(f"`{k}` {kind(df, k)}" for k in keys) + ", media_bytes long, media_sha256 string, page int, width long, height long, samples_per_pixel int, compression int, predictor int, samples binary, error string"
    return map_rows(df, schema, lambda: row, many=True)


def text_to_tiff(text: str | None) -> bytes:
    """The text's bytes, padded by 0 to a positive multiple of 64, as one page of 64 pixels a row.  The
    checksum of the payload chooses among the schemes, strips or tiles, and with or without predictor."""
    data = (text or "").encode("utf-8")
    data += b"\0" * (-len(data) % ROW if data else ROW)
    choice = zlib.crc32(data)
    scheme = (NONE, PACKBITS, LZW, DEFLATE)[choice % 4]
    image = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return write_pages([image], scheme, 1 + (choice >> 4) % 2, bool((choice >> 8) % 2), "<>"[(choice >> 12) % 2])


def store_as_tiff(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored file of every text."""
    df = pick(df, doc_id, text)
    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, n_bytes long, media binary", lambda: lambda i, t: (i, len((t or "").encode()), text_to_tiff(t)))


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    pages = tiff_pages(store_as_tiff(docs), keys=("doc_id", "n_bytes"))  # one page each
    payload = F.col("samples")
    return pages.select(
        "doc_id", "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -ROW, ROW)).alias("tail_crc32"),
        "media_bytes", "media_sha256",
        F.concat_ws(":", "width", "height", "compression", "predictor", F.hex(F.crc32(payload))).alias("feature"),
    )


QUERIES = {"op1_tiff": op1_tiff}
ORACLE_SQL: dict[str, str] = {}
