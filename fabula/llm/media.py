"""Media columns: baseline JPEG, written and read.

A payload byte is the mean of one 8 x 8 block of a grey image: with a DC quantiser of 8 the quantised
DC coefficient is the byte less 128, an integer, so the image's DC-only thumbnail (an eighth of each
side) is the payload, without loss.  The Huffman tables are this writer's own: category c of the DC
differences has a code of 9 - c bits, and end-of-block, the only AC symbol, has one, so every block
takes 10 bits and numpy can pack and unpack all blocks at once.  The reader parses the markers of any
baseline file, decodes scans with any tables (block by block where the block length varies) and keeps
the luminance DC coefficients.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import _exchange as X
from fabula.llm import _grams as G

#: Payloads are filled with bytes 255 to a positive multiple of this.
UNIT = 576
MOST_SIDE = 8191  # blocks; 65,535 samples
_SLICE = 4 << 20


def _dc_table() -> tuple[bytes, bytes, np.ndarray]:
    """Code counts by length, symbols, and the 10 bits of a block for each difference from -255 to 255."""
    counts, symbols = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
    word = np.empty(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1
        word[d + 255] = (prefix << c | (d if d >= 0 else d + (1 << c) - 1)) << 1
    return counts, symbols, word


_COUNTS, _SYMBOLS, _WORD = _dc_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + b"\x08" * 64)
_TABLES = _segment(0xC4, b"\x00" + _COUNTS + _SYMBOLS) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + _segment(0xDA, b"\1\1\0\0\x3f\0")


def write_frame(samples: np.ndarray, width: int) -> bytes:
    """A grey JPEG whose blocks have these means (uint8, a multiple of 8 of them), `width` blocks a row."""
    dc = samples.astype(np.int16) - 128
    word = _WORD[np.diff(dc, prepend=np.int16(0)) + 255].reshape(-1, 4)
    five = word[:, 0] << np.uint64(30) | word[:, 1] << np.uint64(20) | word[:, 2] << np.uint64(10) | word[:, 3]
    scan = np.ascontiguousarray(five.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\0")
    frame = _segment(0xC0, struct.pack(">BHHB", 8, len(samples) // width * 8, width * 8, 1) + b"\1\x11\0")
    return b"".join((_HEAD, frame, _TABLES, scan, b"\xff\xd9"))


def to_jpeg(payload: np.ndarray) -> bytes:
    """One frame, or for payloads beyond the format's sides several after each other."""
    width = 24 if len(payload) // 24 <= MOST_SIDE else UNIT
    most = width * MOST_SIDE // UNIT * UNIT
    return b"".join(write_frame(payload[i : i + most], width) for i in range(0, len(payload), most))


class _Bits:
    """Bits of a scan, most significant first, from a window of 32; the scan's end is an error, ones follow it for symbols."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\xff" * 4, 0, len(data) * 8

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("scan ends early")
        return out

    def symbol(self, codes: list[tuple[int, int] | None]) -> int:
        found = codes[self.peek(16)]
        if found is None:
            raise ValueError("scan ends early" if self.at + 16 > self.end else "no such code")
        self.take(found[0])
        return found[1]


def _by_bits(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """Length and symbol of the code that 16 bits begin with."""
    out: list[tuple[int, int] | None] = [None] * 65536
    for (n, code), symbol in _codes(counts, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbol)] * (1 << (16 - n))
    return out


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _difference(bits: int, category: int) -> int:
    return bits if category == 0 or bits >> (category - 1) else bits - (1 << category) + 1


def read_jpeg(data: bytes) -> list[np.ndarray]:
    """The DC-only luminance thumbnail (uint8, rows x columns of blocks) of each frame in the bytes."""
    at, quant, tables, frames, frame, restart = 0, {}, {}, [], None, 0
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD8:
            quant, tables, frame, restart = {}, {}, None, 0
            continue
        if marker == 0xD9:
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body, after = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0 or marker == 0xC1:
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not 8-bit samples")
            frame = (high, wide, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan without a frame")
            end = after
            while True:
                end = data.find(b"\xff", end)
                if end < 0:
                    end = len(data)
                    break
                if end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                    end += 2
                    continue
                break
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if frame[2][0][0] in chosen:
                frames.append(_scan(data[after:end], frame, chosen, quant, tables, restart))
            after = end
        at = after
    return frames


def _scan(raw: bytes, frame: tuple, chosen: dict, quant: dict, tables: dict, restart: int) -> np.ndarray:
    high, wide, parts = frame
    parts = [p for p in parts if p[0] in chosen]
    luma = parts[0]
    alone = len(parts) == 1
    most_h, most_v = (1, 1) if alone else (max(p[1] for p in frame[2]), max(p[2] for p in frame[2]))
    columns, rows = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    if alone and restart == 0:
        dc = _equal_blocks(raw.replace(b"\xff\0", b"\xff"), columns * rows, tables[chosen[luma[0]] >> 4], tables[16 + (chosen[luma[0]] & 15)])
        if dc is not None:
            return _samples(dc.reshape(rows, columns), quant[luma[3]])
    h, v = (1, 1) if alone else luma[1:3]
    dc = np.zeros((rows * v, columns * h), np.int64)
    codes = {k: _by_bits(*t) for k, t in tables.items()}
    segments = [s.replace(b"\xff\0", b"\xff") for s in _split_restarts(raw)]
    bits, last = _Bits(segments[0]), dict.fromkeys(chosen, 0)
    for mcu in range(columns * rows):
        if restart and mcu and mcu % restart == 0:
            bits, last = _Bits(segments[mcu // restart]), dict.fromkeys(chosen, 0)
        for p in parts:
            for y in range(1 if alone else p[2]):
                for x in range(1 if alone else p[1]):
                    c = bits.symbol(codes[chosen[p[0]] >> 4])
                    last[p[0]] += _difference(bits.take(c), c)
                    k = 1
                    while k < 64:
                        s = bits.symbol(codes[16 + (chosen[p[0]] & 15)])
                        if s == 0:
                            break
                        bits.take(s & 15)
                        k += (s >> 4) + 1
                    if p is luma:
                        dc[mcu // columns * v + y, mcu % columns * h + x] = last[p[0]]
    return _samples(dc[: -(-high * v // (8 * most_v)), : -(-wide * h // (8 * most_h))], quant[luma[3]])


def _split_restarts(raw: bytes) -> list[bytes]:
    out, begin, i = [], 0, raw.find(b"\xff")
    while i >= 0 and i + 1 < len(raw):
        if 0xD0 <= raw[i + 1] <= 0xD7:
            out.append(raw[begin:i])
            begin = i + 2
        i = raw.find(b"\xff", i + 2)
    return [*out, raw[begin:]]


def _samples(dc: np.ndarray, quantiser: int) -> np.ndarray:
    return np.clip((dc * quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)


_LOOKUP: dict[tuple, tuple[int, np.ndarray] | None] = {}


def _lookup(dc_table: tuple[bytes, bytes], ac_table: tuple[bytes, bytes]) -> tuple[int, np.ndarray] | None:
    """Bits of a block and the difference for each such word, if the tables make all blocks equally long."""
    if ac_table[1] != b"\0" or ac_table[0][0] != 1:
        return None
    codes = _codes(*dc_table)
    lengths = {n + c for (n, _), c in codes.items()}
    if len(lengths) != 1 or max(lengths) > 15:
        return None
    size = max(lengths) + 1
    table = np.full(1 << size, 1 << 30, np.int64)
    for (_, code), c in codes.items():
        bits = np.arange(1 << c)
        table[(code << c | bits) << 1] = bits if c == 0 else np.where(bits >> (c - 1) == 1, bits, bits - (1 << c) + 1)
    return size, table


def _equal_blocks(scan: bytes, blocks: int, dc_table: tuple[bytes, bytes], ac_table: tuple[bytes, bytes]) -> np.ndarray | None:
    key = (*dc_table, *ac_table)
    if key not in _LOOKUP:
        if len(_LOOKUP) > 64:
            _LOOKUP.clear()
        _LOOKUP[key] = _lookup(dc_table, ac_table)
    if _LOOKUP[key] is None or blocks % 8:
        return None
    size, table = _LOOKUP[key]
    if len(scan) < blocks // 8 * size:
        raise ValueError("scan ends early")
    raw = np.zeros((blocks // 8, size + 3), np.uint32)
    raw[:, :size] = np.frombuffer(scan, np.uint8, blocks // 8 * size).reshape(-1, size)
    word = np.empty((blocks // 8, 8), np.uint32)
    for j in range(8):  # 8 blocks fill `size` bytes
        o, shift = j * size // 8, 24 - size - j * size % 8
        word[:, j] = (raw[:, o] << np.uint32(16) | raw[:, o + 1] << np.uint32(8) | raw[:, o + 2]) >> np.uint32(shift) & np.uint32((1 << size) - 1)
    difference = table[word.ravel()]
    if blocks and difference.max() == 1 << 30:
        raise ValueError("no such code")
    return np.cumsum(difference)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit gradient hash of the thumbnail's means in 8 rows and 9 columns, as hex."""
    small = thumb.astype(np.int64)
    for axis, n in ((0, 8), (1, 9)):
        at = np.arange(n) * small.shape[axis] // n
        span = np.maximum(np.diff(np.r_[at, small.shape[axis]]), 1)
        small = np.add.reduceat(small, at, axis=axis) // (span[:, None] if axis == 0 else span)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def _written(columns: list[str]):
    def written(batches):
        for batch in batches:
            buf, off = G.text_buffer(batch["text"])
            for a, b in G.slices(off, _SLICE):
                media = []
                for i, j in zip(off[a:b].tolist(), off[a + 1 : b + 1].tolist(), strict=True):
                    payload = np.full(max(1, -(-(j - i) // UNIT)) * UNIT, 255, np.uint8)
                    payload[: j - i] = buf[i:j]
                    media.append(to_jpeg(payload))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in columns), pa.array(np.diff(off[a : b + 1])), pa.array(media, pa.binary())], [*columns, "n_bytes", "media"])

    return lambda batches: X.tidy(written(batches))


def texts_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (the JPEG bytes) of each text's UTF-8, filled with 255 to a positive multiple of 576.

    A null text is empty.  A text of any length is stored whole, in several frames beyond 4.7 MB."""
    X.bounded_batches(df)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_written(["id"]), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _features(columns: list[str]):
    def features(batches):
        names = [*columns, "payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "media_bytes", "media_sha256", "feature", "error"]
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for media in batch["media"]:
                media = media.as_py()
                row: list = [None] * 9
                if media is not None:
                    row[5], row[6] = len(media), hashlib.sha256(media).hexdigest()
                    try:
                        thumbs = read_jpeg(media)
                        if not thumbs:
                            raise ValueError("no scan")
                        payload = b"".join(t.tobytes() for t in thumbs)
                        wide, high = thumbs[0].shape[1] * 8, sum(t.shape[0] for t in thumbs) * 8
                        row[:5] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), wide, high
                        row[7] = f"{wide}x{high}:" + ",".join(map(thumbnail_hash, thumbs))
                    except (ValueError, IndexError, KeyError, struct.error) as e:
                        row[8] = f"{type(e).__name__}: {e}"
                for o, x in zip(out, row, strict=True):
                    o.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names)

    return lambda batches: X.tidy(features(batches))


def media_features(df: DataFrame, media_col: str = "media", *, carry: list[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads JPEG bytes: thumbnail bytes (payload) with digests, dimensions, gradient hashes of the thumbnails.

    Null media gives nulls; bytes that are no baseline JPEG give nulls and the reason in `error`.  A
    carried column with the name of a result column is left out."""
    X.bounded_batches(df)
    carry = X.result_first(carry, ["payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "media_bytes", "media_sha256", "feature", "error"])
    names = [f"c{i}" for i in range(len(carry))]
    carried = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{media_col}`").alias("media"))
    own = "payload_bytes long, payload_sha256 string, tail_crc32 long, width long, height long, media_bytes long, media_sha256 string, feature string, error string"
    out = rows.mapInArrow(_features(names), f"{carried}, {own}" if carried else own)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], *out.columns[len(names) :])
