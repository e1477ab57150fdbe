import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from tierloom.llm import jpeg


def payload_of(text):
    b = (text or "").encode()
    return b + b" " * (192 if not b else -len(b) % 192)


def test_round_trip_of_documents(frame, edge):
    found = jpeg.features(jpeg.store(frame(edge))).collect()
    want = sorted(
        (str(i), len((t or "").encode()), len(payload_of(t)), hashlib.sha256(payload_of(t)).hexdigest(), zlib.crc32(payload_of(t)[-16:])) for i, t in edge
    )
    assert sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert all(r.error is None and r.feature for r in found)
    assert jpeg.features(jpeg.store(frame([]))).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8191, 8192, 20_000])
def test_round_trip_of_any_bytes(n):
    p = os.urandom(192 * n)
    (m,) = jpeg.encode([p])
    assert jpeg.look([m])[0][3] == hashlib.sha256(p).hexdigest()


def test_long_payloads_take_several_pictures(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 3)
    monkeypatch.setattr(jpeg, "MOST_WIDE", 2)
    p = os.urandom(192 * 20)
    (m,) = jpeg.encode([p])
    assert m.count(b"\xff\xd8\xff\xfe") == 4
    assert jpeg.look([m])[0][3] == hashlib.sha256(p).hexdigest()


class Bits:
    def __init__(self):
        self.out, self.acc = bytearray(), ""

    def put(self, value, n):
        if n:
            self.acc += format(value, f"0{n}b")

    def flush(self):
        self.acc += "1" * (-len(self.acc) % 8)
        for i in range(0, len(self.acc), 8):
            b = int(self.acc[i : i + 8], 2)
            self.out.append(b)
            if b == 255:
                self.out.append(0)
        self.acc = ""


def written(width, height, sampling, restart, r):
    """A baseline file with random coefficients, and the luminance DC values of its blocks by row."""
    dc_bits, dc_symbols = {3: 6, 4: 1, 5: 1, 6: 1}, [0, 1, 2, 3, 4, 5, 6, 7, 8]
    ac_bits, ac_symbols = {2: 2, 4: 4, 6: 5}, [0x00, 0x01, 0x11, 0x02, 0x21, 0xF0, 0x03, 0x31, 0x12, 0x04, 0x41]
    dc, ac = jpeg.codes(dc_bits, dc_symbols), jpeg.codes(ac_bits, ac_symbols)
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if len(sampling) == 1:
        wide, high = -(-width // 8), -(-height // 8)
    h0, v0 = sampling[0] if len(sampling) > 1 else (1, 1)
    luma = np.zeros((high * v0, wide * h0), int)
    scan, bits, pred, n = bytearray(), Bits(), [0] * len(sampling), 0
    for my in range(high):
        for mx in range(wide):
            if restart and n and n % restart == 0:
                bits.flush()
                scan += bits.out + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                bits, pred = Bits(), [0] * len(sampling)
            for c, (h, v) in enumerate(sampling):
                for b in range(h * v if len(sampling) > 1 else 1):
                    value = r.randint(-120, 120)
                    if c == 0:
                        luma[my * v0 + b // h0, mx * h0 + b % h0] = value
                    d, pred[c] = value - pred[c], value
                    s = abs(d).bit_length()
                    bits.put(*dc[s])
                    bits.put(d if d >= 0 else d + (1 << s) - 1, s)
                    k = 1
                    while k < 64 and r.random() < 0.7:
                        sym = r.choice(ac_symbols[1:])
                        run, size = sym >> 4, sym & 15
                        if sym == 0xF0:
                            if k + 16 >= 63:
                                break
                            bits.put(*ac[sym])
                            k += 16
                            continue
                        if k + run > 63:
                            break
                        bits.put(*ac[sym])
                        bits.put(r.getrandbits(size), size)
                        k += run + 1
                    if k < 64:
                        bits.put(*ac[0])
            n += 1
    bits.flush()
    scan += bits.out
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(sampling), 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    sos = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(sampling), len(sampling)) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\x00\x3f\x00"
    dri = b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b""
    return b"\xff\xd8" + quant + sof + jpeg._dht(0, dc_bits, dc_symbols) + jpeg._dht(0x10, ac_bits, ac_symbols) + dri + sos + bytes(scan) + b"\xff\xd9", luma


@pytest.mark.parametrize(
    "width,height,sampling,restart", [(64, 40, [(1, 1)], 0), (61, 33, [(1, 1)], 5), (70, 50, [(2, 2), (1, 1), (1, 1)], 3), (40, 90, [(2, 1), (1, 1), (1, 1)], 0), (33, 33, [(1, 2), (1, 1), (1, 1)], 2)]
)
def test_any_baseline_file(width, height, sampling, restart):
    r = random.Random(width)
    data, luma = written(width, height, sampling, restart, r)
    (thumb,) = jpeg.thumbnails(jpeg.parse(data))
    assert (thumb == np.clip(luma + 128, 0, 255)).all()


def test_files_of_different_tables_together():
    r = random.Random(3)
    one, _ = written(64, 64, [(2, 2), (1, 1), (1, 1)], 4, r)
    (two,) = jpeg.encode([os.urandom(192)])
    both, alone = jpeg.look([one, two, one]), jpeg.look([one])
    assert both[0] == both[2] == alone[0] and both[1][8] is None


def test_broken_media_has_an_error():
    (good,) = jpeg.encode([b"a" * 192])
    found = jpeg.look([None, b"", b"GIF89a", good[:-2], good[:60], good.replace(b"\xff\xc0", b"\xff\xc2"), good])
    assert [f[8] is None for f in found] == [False] * 6 + [True]
    assert found[0][5] is None and found[2][5] == 6


def test_average_hash_of_small_pictures():
    assert jpeg.average_hash(np.array([[0, 255]], np.uint8)) == "0f" * 8
    assert len(jpeg.average_hash(np.zeros((3, 5), np.uint8))) == 16
