"""Media columns: bytes stored in, and read back from, progressive JPEG files.

A payload becomes the luma coefficients of a 4:2:0 picture whose quantisers are all one.
Coefficients are JPEG's own integer unit, so storing is lossless, which pixels would not be:
byte b is coefficient b - 255 for b < 128 and b otherwise, of eight significant bits either
way.  The picture is 9k blocks wide, 64 payload bytes to a block in zigzag order; blocks
beyond the payload hold bytes 255, and a comment segment holds the payload's length.

The scans are: DC without its low bit; bands 1-5 and 6-63 of the luma AC coefficients without
their low bit (spectral selection); the low bits of both (successive approximation).

``decode`` reads any non-interleaved progressive file with Huffman coding and up to three
components: it accumulates all scans into coefficient arrays.  Where all coefficients of a
scan are coded alike it works on whole arrays; else it goes symbol by symbol.  ``to_rgb``
dequantises, inverse-transforms with numpy, repeats chroma to full resolution and converts.

Defined results: null counts as empty; an empty text is one all-255 unit; equal texts give
equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

UNIT = 576
SIDE = 8191  # blocks; JPEG sizes have 16 bits
_CODE_BITS = 4


def zigzag_order() -> np.ndarray:
    """Natural position (row * 8 + column) of each zigzag index, by walking the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag_order()
_COSINE = np.array([[(0.5**0.5 if u == 0 else 1.0) * 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: Maps a dequantised block in zigzag order to its 64 samples.
_INVERSE = np.einsum("xu,yv->uvxy", _COSINE, _COSINE).reshape(64, 64)[ZIGZAG].astype(np.float32)


@dataclass
class Component:
    h: int
    v: int
    blocks_wide: int
    blocks_high: int
    quant: np.ndarray
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), dtype=np.int16))


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    comment: bytes = b""


# ---------------------------------------------------------------- writing


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes, padded with ones."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, dtype=np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def to_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The low ``lengths`` bits of each value, highest first, one after the other."""
    most = int(lengths.max()) if len(lengths) else 0
    place = np.arange(most - 1, -1, -1)
    bits = ((values[:, None] >> place) & 1).astype(np.uint8)
    return bits[place[None, :] < lengths[:, None]]


def magnitude_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category of each value and its additional bits."""
    size = np.zeros(len(v), dtype=np.int64)
    rest = np.abs(v).astype(np.int64)
    while rest.any():
        size += rest > 0
        rest >>= 1
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.int64)


def fixed_table(kind: int, symbols: list[int]) -> bytes:
    """Huffman table 0 of a kind (0 DC, 1 AC) whose codes are all ``_CODE_BITS`` long, in order."""
    counts = [0] * 16
    counts[_CODE_BITS - 1] = len(symbols)
    return segment(0xC4, bytes([kind << 4, *counts, *symbols]))


def single_table(symbol: int) -> bytes:
    """AC table 0 with one symbol, of code 0."""
    return segment(0xC4, bytes([0x10, 1, *[0] * 15, symbol]))


def scan_header(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low]))


def dc_first(component: int, dc: np.ndarray, low: int) -> bytes:
    value = dc.astype(np.int64) >> low
    size, extra = magnitude_bits(np.diff(value, prepend=0))
    bits = to_bits(size << size | extra, _CODE_BITS + size)
    return fixed_table(0, list(range(12))) + scan_header(component, 0, 0, 0, low) + stuffed(bits)


def dc_refine(component: int, dc: np.ndarray, low: int) -> bytes:
    return scan_header(component, 0, 0, low + 1, low) + stuffed(((dc.astype(np.int64) >> low) & 1).astype(np.uint8))


def ac_first_dense(component: int, band: np.ndarray, first: int, last: int, low: int, size: int) -> bytes:
    """A band whose shifted coefficients all have ``size`` significant bits: one code bit 0, then those."""
    v = np.sign(band).astype(np.int64) * (np.abs(band).astype(np.int64) >> low)
    extra = np.where(v < 0, v + (1 << size) - 1, v).ravel()
    if size == 7:
        data = extra.astype(np.uint8).tobytes()  # bit 0 and seven bits make a byte, never 255
    else:
        data = stuffed(to_bits(extra, np.full(len(extra), size + 1)))
    return single_table(size) + scan_header(component, first, last, 0, low) + data


def ac_refine_dense(component: int, band: np.ndarray, first: int, last: int, low: int) -> bytes:
    """Low bits of a band without zeros: end-of-band runs, each followed by its correction bits."""
    bits, parts = ((np.abs(band).astype(np.int64) >> low) & 1).astype(np.uint8), []
    for at in range(0, len(band), 32767):
        piece = bits[at : at + 32767]
        r = len(piece).bit_length() - 1
        head = (r << r) | (len(piece) - (1 << r))
        parts += [to_bits(np.array([head]), np.array([_CODE_BITS + r])), piece.ravel()]
    return fixed_table(1, [r << 4 for r in range(15)]) + scan_header(component, first, last, low + 1, low) + stuffed(np.concatenate(parts))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file that holds a payload of a multiple of 576 bytes."""
    units = len(payload) // UNIT
    k = -(-units // SIDE)
    wide, high = 9 * k, -(-units // k)
    raw = np.full(wide * high * 64, 255, dtype=np.int16)
    raw[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    luma = np.where(raw < 128, raw - 255, raw).reshape(-1, 64)
    chroma = -(-wide // 2) * -(-high // 2)
    tint = zlib.crc32(payload)
    tones = [np.full(chroma, (tint >> shift & 0xFF) - 128, dtype=np.int16) for shift in (0, 8)]
    frame = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(payload))), segment(0xDB, bytes([0, *[1] * 64])), segment(0xC2, frame)]
    out += [dc_first(i + 1, dc, 1) for i, dc in enumerate([luma[:, 0], *tones])]
    out += [ac_first_dense(1, luma[:, a : b + 1], a, b, 1, 7) for a, b in ((1, 5), (6, 63))]
    out.append(ac_refine_dense(1, luma[:, 1:], 1, 63, 0))
    out += [dc_refine(i + 1, dc, 0) for i, dc in enumerate([luma[:, 0], *tones])]
    return b"".join(out) + b"\xff\xd9"


# ---------------------------------------------------------------- reading


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.by_code: dict[tuple[int, int], int] = {}
        self.single = (symbols[0], next(i + 1 for i, n in enumerate(counts) if n)) if len(symbols) == 1 else None
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.by_code[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        lengths = {length for length, _ in self.by_code}
        self.fixed = lengths.pop() if len(lengths) == 1 else None


class Bits:
    """Entropy-coded bits with a position."""

    def __init__(self, data: bytes):
        self.data = data + b"\xff" * 8
        self.total, self.at = 8 * len(data), 0
        self._bits = None

    def take(self, n: int) -> int:
        word = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "big")
        value = word >> (40 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        if table.fixed:
            return table.by_code[table.fixed, self.take(table.fixed)]
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.by_code:
                return table.by_code[length, code]
        raise ValueError("a code that the table does not have")

    def many(self, n: int) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, dtype=np.uint8))
        out = self._bits[self.at : self.at + n]
        self.at += n
        return out


def extended(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> Picture:
    """Accumulates all scans of a file into the coefficient arrays of its components."""
    at, tables, quants, picture, ids = 2, {}, {}, None, {}
    comment = b""
    while True:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0] if data[at + 1] != 0xD9 else 0
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xD9:
            return picture
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC2:
            _, height, width, count = struct.unpack(">BHHB", body[:6])
            specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            hmax, vmax = max(s[1] for s in specs), max(s[2] for s in specs)
            picture = Picture(width, height, [], comment)
            for i, (cid, h, v, q) in enumerate(specs):
                wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
                ids[cid] = i
                picture.components.append(Component(h, v, wide, high, quants[q], np.zeros((wide * high, 64), dtype=np.int16)))
        elif marker == 0xDA:
            if body[0] != 1:
                raise ValueError("interleaved scans are not read")
            part, table = picture.components[ids[body[1]]], body[2]
            first, last, high, low = body[3], body[4], body[5] >> 4, body[5] & 15
            end = re.compile(rb"\xff[^\x00]", re.S).search(data, at).start()
            bits = Bits(data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
            if first == 0:
                (read_dc_refine if high else read_dc_first)(part.coef, bits, tables.get((0, table >> 4)), low)
            else:
                (read_ac_refine if high else read_ac_first)(part.coef, bits, tables[1, table & 15], first, last, low)


def read_dc_first(coef: np.ndarray, bits: Bits, table: Huffman, low: int) -> None:
    previous, out = 0, []
    if table.fixed:  # the same as below, without calls
        data, pos, fixed = bits.data, bits.at, table.fixed
        size_of = [table.by_code.get((fixed, c), 0) for c in range(1 << fixed)]
        for _ in range(len(coef)):
            word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 5], "big") << (pos & 7) & 0xFFFFFFFFFF
            size = size_of[word >> (40 - fixed)]
            if size:
                value = word >> (40 - fixed - size) & ((1 << size) - 1)
                previous += value if value >> (size - 1) else value - (1 << size) + 1
            pos += fixed + size
            out.append(previous)
    else:
        for _ in range(len(coef)):
            size = bits.symbol(table)
            previous += extended(bits.take(size), size)
            out.append(previous)
    coef[:, 0] = np.array(out, dtype=np.int64) << low


def read_dc_refine(coef: np.ndarray, bits: Bits, table: Huffman | None, low: int) -> None:
    coef[:, 0] |= bits.many(len(coef)).astype(np.int16) << low


def read_ac_first(coef: np.ndarray, bits: Bits, table: Huffman, first: int, last: int, low: int) -> None:
    if table.single and table.single[0] >> 4 == 0 and table.single[0] & 15:
        size, length = table.single
        n = len(coef) * (last - first + 1)
        if size + length == 8 and bits.at == 0:
            value = np.frombuffer(bits.data, dtype=np.uint8, count=n).astype(np.int16) & ((1 << size) - 1)
        else:
            field_bits = bits.many(n * (size + length)).reshape(n, size + length)[:, length:]
            value = (field_bits.astype(np.int16) << np.arange(size - 1, -1, -1, dtype=np.int16)).sum(axis=1, dtype=np.int16)
        value = np.where(value >> (size - 1) == 1, value, value - (1 << size) + 1)
        coef[:, first : last + 1] = (value << low).reshape(len(coef), -1)
        return
    block = 0
    while block < len(coef):
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                coef[block, k] = extended(bits.take(size), size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                block += (1 << run) + bits.take(run) - 1
                break
        block += 1


def read_ac_refine(coef: np.ndarray, bits: Bits, table: Huffman, first: int, last: int, low: int) -> None:
    step, block = 1 << low, 0

    def correct(row: np.ndarray) -> None:
        """Correction bits for all non-zero coefficients of ``row``, in order."""
        live = row != 0
        add = bits.many(int(live.sum())).astype(np.int16) * np.int16(step)
        row[live] += np.where(row[live] > 0, add, -add)

    while block < len(coef):
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size == 0 and run < 15:
                n = (1 << run) + bits.take(run)
                correct(coef[block, k : last + 1])
                correct(coef[block + 1 : block + n, first : last + 1])
                block += n - 1
                break
            new = (step if bits.take(1) else -step) if size else 0
            while k <= last:
                if coef[block, k]:
                    if bits.take(1):
                        coef[block, k] += step if coef[block, k] > 0 else -step
                elif run == 0:
                    break
                else:
                    run -= 1
                k += 1
            if new and k <= last:
                coef[block, k] = new
            k += 1
        block += 1


def payload_of(picture: Picture) -> bytes:
    luma = picture.components[0].coef
    raw = np.where(luma < 0, luma + 255, luma).astype(np.uint8).tobytes()
    return raw[: struct.unpack(">Q", picture.comment)[0]]


def plane(part: Component) -> np.ndarray:
    """Samples 0 to 255 of a component, by the inverse transform of its blocks."""
    samples = (part.coef.astype(np.float32) * part.quant) @ _INVERSE
    samples += np.float32(128.5)
    np.clip(samples, 0, 255, out=samples)
    grid = samples.astype(np.uint8).reshape(part.blocks_high, part.blocks_wide, 8, 8)
    return grid.swapaxes(1, 2).reshape(8 * part.blocks_high, 8 * part.blocks_wide)


def to_rgb(picture: Picture) -> np.ndarray:
    """Full-resolution RGB, height x width x 3, in fixed-point arithmetic of 1/65536."""
    hmax, vmax = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        p = plane(c)
        if (c.v, c.h) != (vmax, hmax):
            p = p.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
        planes.append(p[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    level = np.arange(256, dtype=np.int32) - 128
    y, cb, cr = planes[0].astype(np.int16), planes[1], planes[2]
    red = ((91881 * level + 32768) >> 16).astype(np.int16)
    blue = ((116130 * level + 32768) >> 16).astype(np.int16)
    from_cb, from_cr = 22554 * level, 46802 * level
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    out[:, :, 0] = np.clip(y + red[cr], 0, 255)
    out[:, :, 1] = np.clip(y - ((from_cb[cb] + from_cr[cr] + 32768) >> 16).astype(np.int16), 0, 255)
    out[:, :, 2] = np.clip(y + blue[cb], 0, 255)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes with 255 appended up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel sums and channel extremes of a tensor."""
    flat = [np.ascontiguousarray(rgb[:, :, c]) for c in range(3)]
    sums, least, most = ([int(f(p)) for p in flat] for f in (lambda p: p.sum(dtype=np.int64), np.min, np.max))
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ";".join(f"{name}={','.join(map(str, v))}" for name, v in (("sum", sums), ("min", least), ("max", most)))


def store(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, then media (the file), height, width and rgb (the tensor's bytes, row by row)."""

    def call(texts: list[str | None]) -> dict[str, object]:
        out: dict[str, list] = {"media": [], "height": [], "width": [], "rgb": []}
        for t in texts:
            media = encode(padded(t)[1])
            rgb = to_rgb(decode(media))
            for name, value in zip(out, (media, rgb.shape[0], rgb.shape[1], rgb.tobytes())):
                out[name].append(value)
        return out

    return map_texts(df, keep, text, "media binary, height int, width int, rgb binary", lambda: call)


def digest_text(text: str | None) -> tuple:
    n, payload = padded(text)
    media = encode(payload)
    picture = decode(media)
    back = payload_of(picture)
    return (
        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature_of(to_rgb(picture)),
    )


def digests(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and digests of what was stored and read back."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in fields.split(", ")]

    def call(texts: list[str | None]) -> dict[str, object]:
        return dict(zip(names, zip(*map(digest_text, texts))))

    return map_texts(df, keep, text, fields, lambda: call)
