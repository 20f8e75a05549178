"""Progressive JPEG: exact round trips, and the general reader against the fast one."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from textmill.llm import media, queries


@pytest.mark.parametrize("text", [None, "", "a", "x" * 575, "y" * 576, "z" * 577, "é你\U0001f600 \x00", "long " * 30_000])
def test_round_trip(text):
    n, payload = media.padded(text)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[n:] == b"\xff" * (len(payload) - n)
    picture = media.decode(media.encode(payload))
    assert media.payload_of(picture) == payload
    rgb = media.to_rgb(picture)
    assert rgb.shape == (picture.height, picture.width, 3) and rgb.dtype == np.uint8


def test_all_bytes_round_trip():
    payload = bytes(range(256)) * 9
    assert media.payload_of(media.decode(media.encode(payload))) == payload


def test_wide_pictures(monkeypatch):
    monkeypatch.setattr(media, "SIDE", 5)
    payload = np.random.default_rng(0).integers(0, 256, 576 * 23, dtype=np.uint8).tobytes()
    picture = media.decode(media.encode(payload))
    assert picture.width == 5 * 72 and media.payload_of(picture) == payload


def test_structure_is_progressive():
    data = media.encode(media.padded("structure")[1])
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and b"\xff\xc2" in data
    at, scans = 2, []
    while data[at + 1] != 0xD9:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xDA:
            scans.append(tuple(data[at + 7 : at + 10]))
            at += 2 + size
            while not (data[at] == 0xFF and data[at + 1] != 0):
                at += 1
        else:
            at += 2 + size
    assert (1, 5, 0x01) in scans and (6, 63, 0x01) in scans and (1, 63, 0x10) in scans


def general_band(band, low, table_bits=8):
    """First pass of sparse coefficients by the textbook: runs, sizes and ends of blocks, codes of eight bits."""
    bits = []
    put = lambda v, n: bits.extend((v >> i) & 1 for i in range(n - 1, -1, -1))
    for row in band:
        run = 0
        for v in row:
            v = int(np.sign(v)) * (abs(int(v)) >> low)
            if v == 0:
                run += 1
                continue
            while run > 15:
                put(0xF0, table_bits)
                run -= 16
            size = abs(v).bit_length()
            put(run << 4 | size, table_bits)
            put(v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            put(0, table_bits)
    return media.stuffed(np.array(bits, dtype=np.uint8))


def test_general_reader():
    """Sparse coefficients with a refinement pass that finds new ones, read symbol by symbol."""
    random = np.random.default_rng(4)
    band = np.where(random.random((12, 63)) < 0.2, random.integers(-40, 41, (12, 63)), 0).astype(np.int16)
    symbols = bytes(range(255))
    table = media.Huffman(bytes([0] * 7 + [255] + [0] * 8), symbols)
    coef = np.zeros((12, 64), dtype=np.int16)
    media.read_ac_first(coef, media.Bits(general_band(band, 1).replace(b"\xff\x00", b"\xff")), table, 1, 63, 1)
    assert (coef[:, 1:] == np.sign(band) * (np.abs(band) >> 1 << 1)).all()
    bits = []
    put = lambda v, n: bits.extend((v >> i) & 1 for i in range(n - 1, -1, -1))
    for row in band:
        new = [k for k, v in enumerate(row) if abs(v) == 1]
        k = 0
        for at in new:
            zeros = [z for z in range(k, at) if abs(row[z]) < 2]
            while len(zeros) > 15:
                put(0xF0, 8)
                for z in range(k, zeros[15] + 1):
                    if abs(row[z]) > 1:
                        put(abs(int(row[z])) & 1, 1)
                k, zeros = zeros[15] + 1, zeros[16:]
            put(len(zeros) << 4 | 1, 8)
            put(int(row[at] > 0), 1)
            for z in range(k, at):
                if abs(row[z]) > 1:
                    put(abs(int(row[z])) & 1, 1)
            k = at + 1
        if k < 63:
            put(0, 8)
            for z in range(k, 63):
                if abs(row[z]) > 1:
                    put(abs(int(row[z])) & 1, 1)
    media.read_ac_refine(coef, media.Bits(media.stuffed(np.array(bits, dtype=np.uint8)).replace(b"\xff\x00", b"\xff")), table, 1, 63, 0)
    assert (coef[:, 1:] == band).all()


def test_fast_reader_equals_general(monkeypatch):
    data = media.encode(media.padded("both readers " * 60)[1])
    fast = media.decode(data)
    real = media.Huffman.__init__

    def slow(self, counts, symbols):
        real(self, counts, symbols)
        self.single = self.fixed = None

    monkeypatch.setattr(media.Huffman, "__init__", slow)
    general = media.decode(data)
    for a, b in zip(fast.components, general.components):
        assert (a.coef == b.coef).all()


def test_inverse_transform():
    part = media.Component(1, 1, 1, 1, np.ones(64, dtype=np.float32), np.zeros((1, 64), dtype=np.int16))
    part.coef[0, 0] = 80  # DC of 80 is 10 above the middle
    assert (media.plane(part) == 138).all()
    x, y = np.meshgrid(np.arange(8), np.arange(8))
    part.coef[0, :3] = (0, 100, 0)  # the first horizontal frequency
    want = 128 + 100 / 4 * np.sqrt(0.5) * np.cos((2 * x + 1) * np.pi / 16)
    assert np.abs(media.plane(part) - want).max() <= 0.51


def test_zigzag():
    order = media.zigzag_order()
    assert list(order[:10]) == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and list(order[-3:]) == [55, 62, 63] and sorted(order) == list(range(64))


def test_query(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.op9_media(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    by_text = {}
    for i, r in rows.items():
        n, payload = media.padded(texts[i])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] > len(payload)
        assert by_text.setdefault(texts[i], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_odd_rows(spark, odd, empty):
    assert media.digests(odd, ["doc_id", "n_chars"]).count() == odd.count()
    stored = media.store(odd, ["doc_id"]).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in stored)
    assert media.store(empty, ["doc_id"]).count() == 0
