"""Media columns of baseline JPEG.

Writing: a payload becomes grey blocks. The DC quantiser is 8, so a block's DC coefficient is its mean less 128, and one byte is
one block: the DC-only thumbnail of the picture is the payload, byte for byte. Each 192 bytes are a restart interval.

Reading: markers are parsed, byte stuffing is undone and the scan's restart intervals are Huffman-decoded together, one
symbol of every interval a step, in numpy. Any baseline file can be read (several components, sampling, AC coefficients);
where a block is a DC symbol and an end of block, one table look-up decodes both. The luminance DC values times the quantiser
make the thumbnail, of which dimensions and an average hash are kept.

Null and empty texts store one interval of spaces. A payload too long for one picture (66 MB) continues in another that
follows it. Media that is null or no baseline JPEG gives null features and an error text. Equal bytes give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

UNIT, MOST_ROWS, MOST_WIDE = 192, 8191, 42
#: Intervals coded at once, and bytes of rows gathered before they are coded; both bound memory only.
SLICE, GATHER = 8192, 3 << 20

#: Code lengths of the DC categories written: 1 to 7 in three bits, 8 in four, 0 in five (no code is all ones).
_DC_BITS, _DC_SYMBOLS = {3: 7, 4: 1, 5: 1}, [1, 2, 3, 4, 5, 6, 7, 8, 0]


def codes(bits: dict[int, int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for s in symbols[at : at + bits.get(length, 0)]:
            out[s] = (code, length)
            code += 1
        at += bits.get(length, 0)
        code <<= 1
    return out


def _dht(kind: int, bits: dict[int, int], symbols: list[int]) -> bytes:
    body = bytes([kind, *(bits.get(i, 0) for i in range(1, 17)), *symbols])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_FIXED = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
_TABLES = _dht(0x00, _DC_BITS, _DC_SYMBOLS) + _dht(0x10, {1: 1}, [0]) + b"\xff\xdd" + struct.pack(">HH", 4, UNIT) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)


def _written() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255: its bits (category code, extra bits, end of block) and their number."""
    table = codes(_DC_BITS, _DC_SYMBOLS)
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = table[s]
        value[d + 255] = ((code << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
        length[d + 255] = n + s + 1
    return value, length


_VALUE, _LENGTH = _written()


def code_intervals(x: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """x: (n, UNIT) bytes -> the coded intervals, each followed by its marker FF mark, and where each ends."""
    n = len(x)
    d = np.empty(x.shape, np.int16)
    d[:, 0] = x[:, 0].astype(np.int16) + (255 - 128)
    np.subtract(x[:, 1:], x[:, :-1], out=d[:, 1:], dtype=np.int16, casting="unsafe")
    d[:, 1:] += 255
    length = _LENGTH[d]
    upto = length.cumsum(1)
    size = (upto[:, -1] + 7) >> 3
    base = size.cumsum() - size
    pos = (upto - length + (base * 8)[:, None]).ravel()
    word = (_VALUE[d].ravel().astype(np.int64) << (24 - (pos & 7) - length.ravel())).astype(np.float64)
    at, total = pos >> 3, int(size.sum())
    whole = np.bincount(at, word, total).astype(np.int64)  # sums of windows of 24 bits that do not overlap
    out = np.zeros(total + 2, np.int64)
    out[:total] = whole >> 16
    out[1 : total + 1] += whole >> 8 & 255
    out[2:] += whole & 255
    out = out[:total].astype(np.uint8)
    last = base + size - 1
    out[last] |= ((1 << (size * 8 - upto[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    wide = 1 + full.astype(np.int64)
    wide[last] += 2
    to = wide.cumsum()
    done = np.zeros(int(to[-1]), np.uint8)
    done[to - wide] = out
    done[to[last] - 2] = 255
    done[to[last] - 1] = marks
    return done.tobytes(), to[last]


def frames(payload: bytes) -> list[tuple[bytes, int, int]]:
    """The payload cut into pictures: header, first interval, number of intervals (spaces fill the last row)."""
    out, n = [], len(payload) // UNIT
    for a in range(0, n, MOST_ROWS * MOST_WIDE):
        m = min(n - a, MOST_ROWS * MOST_WIDE)
        wide = -(-m // MOST_ROWS)
        rows = -(-m // wide)
        head = b"\xff\xd8\xff\xfe" + struct.pack(">HQ", 10, m * UNIT) + _FIXED
        out.append((head + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, rows * 8, wide * UNIT * 8, 1, 1, 0x11, 0) + _TABLES, a, rows * wide))
    return out


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as JPEG."""
    heads, data, marks = [], [], []
    for i, p in enumerate(payloads):
        for head, first, n in frames(p):
            heads.append((i, head, n))
            data.append(p[first * UNIT : (first + n) * UNIT].ljust(n * UNIT))
            m = 0xD0 + np.arange(n, dtype=np.int64) % 8
            m[-1] = 0xD9
            marks.append(m)
    x, mark = np.frombuffer(b"".join(data), np.uint8).reshape(-1, UNIT), np.concatenate(marks)
    parts, ends, base = [], [], 0
    for a in range(0, len(x), SLICE):
        part, end = code_intervals(x[a : a + SLICE], mark[a : a + SLICE])
        parts.append(part)
        ends.append(end + base)
        base += len(part)
    whole, end, at, before = b"".join(parts), np.concatenate(ends), 0, 0
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, head, n in heads:
        at += n
        out[i] += [head, whole[before : int(end[at - 1])]]
        before = int(end[at - 1])
    return [b"".join(p) for p in out]


class Picture:
    """A parsed frame: size, sampling, tables and the scans' data."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.payload: int | None = None
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.scans: list[tuple[list[tuple[int, bytes, bytes]], np.ndarray, int]] = []


def parse(data: bytes) -> list[Picture]:
    """The pictures of a file. Raises ValueError where it is not baseline JPEG."""
    out: list[Picture] = []
    at, quant, huff, pic = 0, {}, {}, None
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("no marker where one is due")
        mark = data[at + 1]
        at += 2
        if mark == 0xFF:
            at -= 1
            continue
        if mark == 0xD8:
            pic, quant, huff = Picture(), {}, {}
            continue
        if mark == 0xD9 and pic:
            if not pic.scans:
                raise ValueError("no scan")
            out.append(pic)
            pic = None
            continue
        if pic is None or at + 2 > len(data):
            raise ValueError("not a JPEG file")
        (n,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + n]
        at += n
        if len(body) != n - 2:
            raise ValueError("cut short")
        if mark == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                huff[body[0]] = body[1:size]
                body = body[size:]
        elif mark == 0xDD:
            (pic.restart,) = struct.unpack(">H", body[:2])
        elif mark == 0xFE and len(body) == 8:
            (pic.payload,) = struct.unpack(">Q", body)
        elif mark == 0xC0:
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            pic.height, pic.width = struct.unpack_from(">HH", body, 1)
            pic.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if not (pic.height and pic.width and pic.parts):
                raise ValueError("no size")
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif mark == 0xDA:
            use = [(body[i], huff[body[i + 1] >> 4], huff[0x10 | body[i + 1] & 15]) for i in range(1, 1 + 2 * body[0], 2)]
            raw = np.frombuffer(data, np.uint8, offset=at)
            ff = np.flatnonzero(raw[:-1] == 255)
            after = raw[ff + 1]
            stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            if not len(stop):
                raise ValueError("cut short")
            pic.scans.append((use, raw[: stop[0]], quant.get(pic.parts[0][3], 1)))
            at += int(stop[0])
    if pic is not None or not out:
        raise ValueError("cut short")
    return out


#: Tables kept by a worker (1 MB each): files of one origin share theirs, and a worker that meets more makes them again.
KEPT = 16


@lru_cache(KEPT)
def _look_up(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: length of the code they begin with (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes({i + 1: table[i] for i in range(16)}, list(table[16:])).items():
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
    return length, symbol


@lru_cache(KEPT)
def _fused(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: bits of a whole block without AC coefficients (0: it is not one) and the DC difference."""
    bits = np.arange(1 << 16)
    n, s = _look_up(dc)
    extra = (bits >> np.clip(16 - n - s, 0, 16)) & ((1 << s) - 1)
    diff = np.where((s > 0) & (extra < (1 << np.maximum(s - 1, 0))), extra - (1 << s) + 1, extra)
    rest = (bits << (n + s)) & 0xFFFF
    an, asym = _look_up(ac)
    good = (n > 0) & (s <= 11) & (n + s < 16) & (an[rest] > 0) & (asym[rest] == 0) & (n + s + an[rest] <= 16)
    return np.where(good, n + s + an[rest], 0), diff.astype(np.int64)


def _windows(data: np.ndarray) -> np.ndarray:
    """24 bits from each byte on; past the end there are ones."""
    b = np.concatenate((data, np.full(4, 255, np.uint8))).astype(np.int32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


def decode_plain(window: np.ndarray, start: np.ndarray, blocks: np.ndarray, dc: bytes, ac: bytes) -> np.ndarray | None:
    """DC values (intervals, blocks) where each block is one look-up; None if some block is not."""
    bits, diff = _fused(dc, ac)
    order = np.argsort(-blocks, kind="stable")
    pos, live = start[order] * 8, blocks[order]
    out, pred = np.zeros((len(pos), int(live[0]) if len(live) else 0), np.int16), np.zeros(len(pos), np.int64)
    limit = len(window) - 1
    for j in range(out.shape[1]):
        k = int(np.searchsorted(-live, -j, "left"))
        p = pos[:k]
        peek = (window[np.minimum(p >> 3, limit)] >> (8 - (p & 7))) & 0xFFFF
        step = bits[peek]
        if not step.all():
            return None
        pos[:k] += step
        pred[:k] += diff[peek]
        out[:k, j] = pred[:k]
    back = np.empty_like(out)
    back[order] = out
    return back


def decode_any(window: np.ndarray, start: np.ndarray, blocks: np.ndarray, pattern: list[int], tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """DC values (intervals, blocks) of any baseline scan; pattern: the component of each block of an MCU."""
    length = np.stack([_look_up(t)[0] for pair in tables for t in pair])
    symbol = np.stack([_look_up(t)[1] for pair in tables for t in pair])
    part, limit = np.array(pattern), len(window) - 1
    pos, block, k = start * 8, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    out, pred = np.zeros((len(start), int(blocks.max(initial=0))), np.int16), np.zeros((len(start), len(tables)), np.int64)
    live = np.flatnonzero(blocks > 0)

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[np.minimum(p >> 3, limit)] >> (8 - (p & 7))) & 0xFFFF

    while len(live):
        c = part[block[live] % len(part)]
        first = k[live] == 0
        bits, table = peek(pos[live]), 2 * c + ~first
        n, s = length[table, bits], symbol[table, bits]
        if not n.all():
            raise ValueError("no such code")
        size = np.where(first, s, s & 15)
        extra = peek(pos[live] + n) >> (16 - size)
        d = live[first]
        v = extra[first]
        v = np.where((size[first] > 0) & (v < (1 << np.maximum(size[first] - 1, 0))), v - (1 << size[first]) + 1, v)
        pred[d, c[first]] += v
        out[d, block[d]] = pred[d, c[first]]
        pos[live] += n + size
        k[live] = np.where(first, 1, np.where(s == 0, 64, k[live] + (s >> 4) + 1))
        over = live[k[live] >= 64]
        block[over] += 1
        k[over] = 0
        live = live[block[live] < blocks[live]]
    return out


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan data without stuffing and restart markers, and where each interval starts."""
    ff = data == 255
    after = np.zeros(len(data), bool)
    after[1:] = ff[:-1]
    restart = after & (data >= 0xD0) & (data <= 0xD7)
    drop = after & (data == 0) | restart
    drop[:-1] |= restart[1:]
    keep = ~drop
    upto = keep.cumsum()
    return data[keep], np.concatenate(([0], upto[np.flatnonzero(restart)]))


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail (rows, columns of 8-bit samples) of each picture."""
    out: list[np.ndarray | None] = [None] * len(pictures)
    jobs: dict = {}
    for i, pic in enumerate(pictures):
        luma, h, v, _ = pic.parts[0]
        most_h, most_v = max(p[1] for p in pic.parts), max(p[2] for p in pic.parts)
        for use, data, quant in pic.scans:
            ids = [u[0] for u in use]
            if luma not in ids:
                continue
            if len(use) == 1:
                pattern, mh, mv = [0], 1, 1
                wide, high = -(-(-(-pic.width * h // most_h)) // 8), -(-(-(-pic.height * v // most_v)) // 8)
            else:
                by_id = {p[0]: p for p in pic.parts}
                pattern, mh, mv = [j for j, u in enumerate(ids) for _ in range(by_id[u][1] * by_id[u][2])], h, v
                wide, high = -(-pic.width // (8 * most_h)), -(-pic.height // (8 * most_v))
            jobs.setdefault((tuple(pattern), tuple(u[1:] for u in use)), []).append((i, ids.index(luma), wide, high, mh, mv, quant, data))
    for (pattern, tables), items in jobs.items():
        plain, starts, blocks, base = [], [], [], 0
        for i, _, wide, high, *_, data in items:
            bits, at = _intervals(data)
            mcus, every = wide * high, pictures[i].restart or wide * high
            if len(at) != -(-mcus // every):
                raise ValueError("restart markers do not match the size")
            n = np.full(len(at), every)
            n[-1] = mcus - every * (len(at) - 1)
            plain.append(bits)
            starts.append(at + base)
            blocks.append(n * len(pattern))
            base += len(bits)
        window, start, count = _windows(np.concatenate(plain)), np.concatenate(starts), np.concatenate(blocks)
        dc = decode_plain(window, start, count, *tables[0]) if len(pattern) == 1 else None
        if dc is None:
            dc = decode_any(window, start, count, list(pattern), list(tables))
        row = 0
        for (i, luma, wide, high, mh, mv, quant, _), n in zip(items, blocks, strict=True):
            own = dc[row : row + len(n)]
            row += len(n)
            own = own.ravel() if (n == dc.shape[1]).all() else np.concatenate([r[:k] for r, k in zip(own, n, strict=True)])
            own = own.reshape(high, wide, len(pattern))[:, :, [j for j, p in enumerate(pattern) if p == luma]]
            own = own.reshape(high, wide, mv, mh).transpose(0, 2, 1, 3).reshape(high * mv, wide * mh)
            out[i] = np.clip((own.astype(np.int32) * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells are brighter than their mean (small pictures repeat rows or columns)."""
    r, c = ((np.arange(9) * n) // 8 for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    thumb.cumsum(0, dtype=np.int64).cumsum(1, out=sums[1:, 1:])
    r1, c1 = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    cell = sums[r1][:, c1] - sums[r[:-1]][:, c1] - sums[r1][:, c[:-1]] + sums[r[:-1]][:, c[:-1]]
    cell = cell / ((r1 - r[:-1])[:, None] * (c1 - c[:-1])[None, :])
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


def _gathered(column: pa.Array) -> Iterator[list[bytes | None]]:
    rows, size = [], 0
    for x in column.cast(pa.binary()):
        rows.append(x.as_py())
        size += len(rows[-1] or b"")
        if size >= GATHER:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (the stored JPEG) of each row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for rows in _gathered(b.column(1)):
                n = pa.array([len(x or b"") for x in rows], pa.int64())
                media = encode([pad(x or b"") for x in rows])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), n, pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])
                at += len(rows)

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


FEATURES = "width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def look(media: list[bytes | None]) -> list[tuple]:
    """The features of each media value, decoded together; values that fail together are retried one by one."""
    try:
        pictures = [parse(m) for m in media]
        thumbs = iter(thumbnails([p for own in pictures for p in own]))
    except (ValueError, LookupError, TypeError, struct.error) as why:  # what broken or foreign bytes lead to
        if len(media) > 1:
            return [look([m])[0] for m in media]
        m = media[0]
        return [(None, None, None, None, None, len(m) if m is not None else None, hashlib.sha256(m).hexdigest() if m is not None else None, None, f"{type(why).__name__}: {why}")]
    out = []
    for m, own in zip(media, pictures, strict=True):
        each = [next(thumbs) for _ in own]
        payload = b"".join(t.tobytes()[: p.payload] if p.payload is not None else t.tobytes() for t, p in zip(each, own, strict=True))
        feature = ";".join(f"{p.width}x{p.height}:{average_hash(t)}" for t, p in zip(each, own, strict=True))
        out.append((own[0].width, own[0].height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, None))
    return out


def features(stored: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("id", "n_bytes")) -> DataFrame:
    """The kept columns and FEATURES of each row's media."""
    own = stored.select(*keep, F.col(media_col).alias("_media"))
    names = [f.split()[0] for f in FEATURES.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for rows in _gathered(b.column(len(keep))):
                found = list(zip(*look(rows), strict=True))
                arrays = [c.slice(at, len(rows)) for c in b.columns[: len(keep)]] + [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
                at += len(rows)

    kept = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(run, f"{kept}, {FEATURES}")


def op1_jpeg(spark, sf_dir: str) -> DataFrame:
    found = features(store(read(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
