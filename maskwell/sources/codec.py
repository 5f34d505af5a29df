"""PNG in numpy and zlib: RGB, 8 bits, no metadata. Writes with filter 0; reads all filters, grey, RGB, RGBA, palette.

Images of few different scanlines are written and read as runs of equal ones (encode_rows, decode_rows). A run is two IDAT
chunks: blocks with one scanline, which refer to nothing before them, and blocks that repeat the scanline before them,
whatever it holds. Any decoder reads such a file."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAX_BYTES, MAX_SIDE, MAX_PIXELS = 10 * 1024 * 1024, 8192, 16_000_000


class ImageError(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(rgb: np.ndarray, level: int = 1) -> bytes:
    h, w, _ = rgb.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = rgb.reshape(h, 3 * w)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


#: A last block without bytes; the start of a zlib stream.
_LAST, _FIRST = b"\x03\x00", b"\x78\x01"


@lru_cache(maxsize=8)
def _probe(n: int, seed: int) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes()


def _inflated(blocks: bytes, before: bytes | None = None) -> bytes | None:
    """What whole raw blocks hold that end with their last byte; None if they don't, or refer to more than `before`."""
    d = zlib.decompressobj(-15) if before is None else zlib.decompressobj(-15, zdict=before)
    try:
        out = d.decompress(blocks + _LAST)
    except zlib.error:
        return None
    return out if d.eof and not d.unused_data else None


@lru_cache(maxsize=512)
def _repeats(blocks: bytes, n: int) -> int:
    """How often blocks repeat the n bytes before them; 0 if they do anything else. Tried on random bytes, which no blocks hold
    by themselves or get by other references."""
    line = _probe(n, 1)
    out = _inflated(blocks, line) or b""
    return len(out) // n if out == line * (len(out) // n) else 0


@lru_cache(maxsize=512)
def _repeating(n: int, times: int) -> bytes | None:
    """The chunk that repeats the scanline of n bytes before it; None where the compressor does not give one."""
    if n > 32_000:  # out of a reference's reach
        return None
    line = _probe(n, 0)
    c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=b"\0" + line)  # it finds nothing at the first byte of its window
    blocks = c.compress(line * times) + c.flush(zlib.Z_FULL_FLUSH)
    return _chunk(b"IDAT", blocks) if _repeats(blocks, n) == times else None


def _sums(line: bytes) -> tuple[int, int]:
    """What a line adds to the two sums of an adler32."""
    one = zlib.adler32(line)
    return (one & 0xFFFF) - 1, (one >> 16) - len(line)


def _adler(n: int, sums: list[tuple[int, int]], times: list[int]) -> int:
    """adler32 of lines of n bytes, each as often as its number says."""
    a, b = 1, 0
    for (s, weighted), t in zip(sums, times):
        b = (b + t * (n * a + weighted) + n * s * (t * (t - 1) // 2)) % 65521
        a = (a + t * s) % 65521
    return b << 16 | a


def encode_rows(rows: np.ndarray, times: np.ndarray) -> bytes:
    """The image whose scanlines are the rows (RGB bytes), each as often as its number says."""
    k, n = rows.shape[0], rows.shape[1] + 1
    raw = np.zeros((k, n), np.uint8)
    raw[:, 1:] = rows
    raw, counts, sums = raw.tobytes(), times.tolist(), []
    c = zlib.compressobj(1, zlib.DEFLATED, -15, 4, zlib.Z_RLE)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1] // 3, sum(counts), 8, 2, 0, 0, 0)), _chunk(b"IDAT", _FIRST)]
    known: dict[bytes, tuple] = {}
    for i, t in enumerate(counts):
        line = raw[i * n : i * n + n]
        if (seen := known.get(line)) is None:
            seen = known[line] = _chunk(b"IDAT", c.compress(line) + c.flush(zlib.Z_FULL_FLUSH)), _sums(line)
        own, s = seen
        sums.append(s)
        parts.append(own)
        if t > 1:
            more = _repeating(n, t - 1)
            parts += [own] * (t - 1) if more is None else [more]
    parts += [_chunk(b"IDAT", _LAST + struct.pack(">I", _adler(n, sums, counts))), _chunk(b"IEND", b"")]
    return b"".join(parts)


def _runs(chunk: bytes, n: int) -> tuple[bytes | None, tuple[int, int] | None, int]:
    """(line, its sums, 1) of an IDAT chunk with one unfiltered scanline of n bytes, (None, None, times) of one that repeats the
    scanline before it."""
    blocks = chunk[8:-4]
    if chunk[4:8] != b"IDAT" or int.from_bytes(chunk[-4:]) != zlib.crc32(chunk[4:-4]):
        raise ImageError("damaged chunk")
    line = _inflated(blocks)
    if line is not None and len(line) == n and not line[0]:
        return line, _sums(line), 1
    if again := _repeats(blocks, n):
        return None, None, again
    raise ImageError("not written in runs")


def decode_rows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, times) of an image that is written as encode_rows() does, plain RGB without filters: its scanlines, equal neighbours
    as one. All bytes are read; chunks that are equal are checked and inflated once. ImageError for any other file."""
    first, last = _chunk(b"IDAT", _FIRST), _chunk(b"IEND", b"")
    at = len(SIGNATURE) + 25 + len(first)
    if data[:8] != SIGNATURE or data[at - len(first) : at] != first or data[-len(last) :] != last:
        raise ImageError("not written in runs")
    w, h, *form = struct.unpack_from(">IIBBBBB", data, 16)
    if data[8:33] != _chunk(b"IHDR", data[16:29]) or form != [8, 2, 0, 0, 0] or not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE) or w * h > MAX_PIXELS:
        raise ImageError("unsupported image")
    n, end = 3 * w + 1, len(data) - len(last) - 18  # the last IDAT holds an empty block and the checksum
    lines, sums, times = [], [], []
    known: dict[bytes, tuple] = {}
    while at < end:
        chunk = data[at : at + 12 + int.from_bytes(data[at : at + 4])]
        at += len(chunk)
        if (seen := known.get(chunk)) is None:
            seen = known[chunk] = _runs(chunk, n)
        line, s, t = seen
        if line is None and lines or lines and lines[-1] == line:
            times[-1] += t
        elif line is None:
            raise ImageError("damaged pixels")
        else:
            lines.append(line)
            sums.append(s)
            times.append(t)
    if at != end or sum(times) != h or data[end : end + 18] != _chunk(b"IDAT", _LAST + struct.pack(">I", _adler(n, sums, times))):
        raise ImageError("damaged pixels")
    return np.frombuffer(b"".join(lines), np.uint8).reshape(len(lines), n)[:, 1:], np.array(times, np.int64)


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ImageError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ImageError("damaged chunk")
        yield kind, body
        at += 12 + size


def header(data: bytes) -> tuple[int, int, int, int, bool]:
    """(width, height, bits, colour type, whether there is nothing but pixels)."""
    kinds = list(chunks(data))
    if not kinds or kinds[0][0] != b"IHDR" or kinds[-1][0] != b"IEND":
        raise ImageError("incomplete PNG")
    w, h, bits, colour, *_ = struct.unpack(">IIBBBBB", kinds[0][1])
    return w, h, bits, colour, all(k in (b"IHDR", b"IDAT", b"IEND", b"PLTE") for k, _ in kinds)


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    rows = raw.reshape(h, stride + 1)
    kinds, out = rows[:, 0], rows[:, 1:].astype(np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        line, kind = out[y], kinds[y]
        if kind == 2:
            line += above
        elif kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            for x in range(stride):
                a = int(line[x - step]) if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        elif kind:
            raise ImageError("unknown filter")
        above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """RGB pixels; alpha is laid on white."""
    w, h, bits, colour, _ = header(data)
    if bits != 8 or colour not in (0, 2, 3, 4, 6) or not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE) or w * h > MAX_PIXELS:
        raise ImageError("unsupported image")
    parts = list(chunks(data))
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8)
    if len(raw) != h * (w * step + 1):
        raise ImageError("damaged pixels")
    x = _unfilter(raw, h, w * step, step).reshape(h, w, step)
    if colour == 3:
        return np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)[x[:, :, 0]]
    if colour in (4, 6):
        alpha = x[:, :, -1:].astype(np.uint16)
        base = x[:, :, :-1].astype(np.uint16)
        x = ((base * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
    return np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
