"""Baseline JPEG in numpy: DC-only encoder, marker parser, lane-parallel Huffman decoder.

The decoder reads any 8-bit baseline (SOF0) image with one interleaved scan, any sampling factors and
restart intervals. It Huffman-decodes every coefficient but keeps the luminance DC terms only, which make a
thumbnail of one sample for each 8x8 block. All restart segments of all images of a batch are decoded side by
side, one symbol a step, so that the work is numpy's and not the interpreter's.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of ITU-T T.81, table K.3: luminance DC code lengths and categories.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_VALUES = bytes(range(12))
#: The AC table of DC-only images: end-of-block alone, coded by one bit.
AC_BITS = bytes([1] + [0] * 15)
AC_VALUES = b"\x00"

ROW_BLOCKS = 192
IMAGE_ROWS = 4096


class JpegError(ValueError):
    """The bytes aren't a baseline JPEG that this decoder reads."""


def canonical(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of each code, by the canonical rule of the standard; JpegError where the table is short or
    names more codes of a length than there are."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            if k >= len(values) or code >= 1 << length:
                raise JpegError("short or overfull Huffman table")
            out.append((values[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=256)
def lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in canonical(bits, values):
        low = code << (16 - length)
        table[low : low + (1 << (16 - length))] = length << 8 | symbol
    return table


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned 16-bit codes and lengths of a whole DC-only block, by DC difference + 255."""
    dc = {s: (c, n) for s, c, n in canonical(DC_BITS, DC_VALUES)}
    codes, sizes = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = dc[size]
        amplitude = diff if diff >= 0 else diff + (1 << size) - 1
        n = length + size + 1  # the last bit is the end-of-block code
        codes[diff + 255] = (code << size | amplitude) << 1 << (16 - n)
        sizes[diff + 255] = n
    return codes, sizes


BLOCK_CODES, BLOCK_SIZES = _codes()


def header(rows: int) -> bytes:
    """Everything before the scan of a grey image of ``rows`` x ROW_BLOCKS constant blocks."""
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"".join((
        b"\xff\xd8",
        part(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        part(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW_BLOCKS * 8, 1) + b"\x01\x11\x00"),
        part(0xC4, b"\x00" + DC_BITS + DC_VALUES),
        part(0xC4, b"\x10" + AC_BITS + AC_VALUES),
        part(0xDD, struct.pack(">H", ROW_BLOCKS)),
        part(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of ROW_BLOCKS bytes) as one JPEG or, beyond IMAGE_ROWS rows, several in a row.

    A byte is the DC term of a block, quantised by 8, so that decoding gives it back exactly.
    """
    rows = np.array([len(p) // ROW_BLOCKS for p in payloads], np.int64)
    if any(len(p) % ROW_BLOCKS or not p for p in payloads):
        raise ValueError(f"a payload isn't a positive multiple of {ROW_BLOCKS} bytes")
    if not len(rows):
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW_BLOCKS).astype(np.int16)
    diff = np.diff(samples, axis=1, prepend=np.int16(128)) + 255
    total = len(samples)
    sizes = np.empty((total, ROW_BLOCKS + 1), np.uint8)
    codes = np.full((total, ROW_BLOCKS + 1), 0xFFFF, ">u2")  # the last column pads a row with ones
    sizes[:, :-1], codes[:, :-1] = BLOCK_SIZES[diff], BLOCK_CODES[diff]
    used = sizes[:, :-1].sum(axis=1, dtype=np.int64)
    sizes[:, -1] = -used % 8
    bits = np.unpackbits(codes.reshape(-1).view(np.uint8)).reshape(-1, 16)
    stream = np.packbits(bits[np.arange(16, dtype=np.uint8) < sizes.reshape(-1, 1)])
    row_bytes = (used + 7) // 8
    row_of = np.repeat(np.arange(total), row_bytes)
    width = 1 + (stream == 0xFF)
    at = np.cumsum(width) - width + 2 * row_of
    out = np.zeros(int(width.sum()) + 2 * total, np.uint8)
    out[at] = stream
    ends = np.cumsum(np.bincount(row_of, weights=width, minlength=total).astype(np.int64)) + 2 * np.arange(1, total + 1)
    first = np.repeat(np.cumsum(rows) - rows, rows)
    inside = (np.arange(total) - first) % IMAGE_ROWS
    last = (inside == IMAGE_ROWS - 1) | (np.arange(total) - first == np.repeat(rows, rows) - 1)
    out[ends - 2] = 0xFF
    out[ends - 1] = np.where(last, 0xD9, 0xD0 + inside % 8)
    data, result, row = out.tobytes(), [], 0
    for n in rows.tolist():
        parts = []
        for low in range(row, row + n, IMAGE_ROWS):
            high = min(low + IMAGE_ROWS, row + n)
            parts += header(high - low), data[int(ends[low - 1]) if low else 0 : int(ends[high - 1])]
        result.append(b"".join(parts))
        row += n
    return result


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, H, V, quantisation table
    quant: dict[int, int] = field(default_factory=dict)  # of the DC term
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of component, DC table, AC table
    interval: int = 0
    start: int = 0
    end: int = 0
    segments: list[tuple[int, int]] = field(default_factory=list)

    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        single = len(self.components) == 1
        h, v = (1, 1) if single else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def blocks(self) -> int:
        across, down = self.grid()
        return across * down * (1 if len(self.components) == 1 else sum(c[1] * c[2] for c in self.components))


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of the image that begins at ``at``; JpegError where it isn't one that this decoder reads."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no SOI marker")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError("cut segment")
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[65 + 64 * wide :]
            elif marker == 0xC0:
                precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not image.height or not image.width:
                    raise JpegError("size or precision not supported")
                image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
                if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in image.components):
                    raise JpegError("sampling factors outside 1 to 4")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise JpegError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    table = body[1:17], body[17 : 17 + n]
                    if len(body) < 17 or body[0] >> 4 > 1:
                        raise JpegError("bad Huffman table")
                    lookup(*table)
                    image.tables[body[0] >> 4, body[0] & 15] = table
                    body = body[17 + n :]
            elif marker == 0xDD:
                image.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = [c[0] for c in image.components]
                image.scan = [(ids.index(body[i]), body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                break
        except (struct.error, IndexError, ValueError) as e:
            raise JpegError(f"bad segment {marker:#x}: {e}") from e
    if len(image.scan) != len(image.components) or not image.components:
        raise JpegError("several scans")
    image.start = at
    scan = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(scan[:-1] == 0xFF)
    kinds = scan[marks + 1]
    restart = (kinds >= 0xD0) & (kinds <= 0xD7)
    stops = np.flatnonzero((kinds != 0) & ~restart & (kinds != 0xFF))
    if not len(stops):
        raise JpegError("no end of the scan")
    stop = marks[stops[0]]
    cuts = marks[restart & (marks < stop)]
    image.segments = list(zip([at, *(at + cuts + 2).tolist()], [*(at + cuts).tolist(), at + int(stop)], strict=True))
    if image.blocks() > 4 * int(stop):  # a block takes two bits at least
        raise JpegError("scan too short for the size")
    end = data.find(b"\xff\xd9", at + int(stop))
    image.end = end + 2 if end >= 0 else len(data)
    return image


def thumbnails(images: list[tuple[bytes, Image]]) -> list[np.ndarray | None]:
    """The luminance DC thumbnail of each parsed image; None where its entropy-coded data is broken."""
    bank: dict[tuple[bytes, bytes], int] = {}
    lanes: list[tuple[int, int, int]] = []  # image, first MCU, MCUs
    plans, pieces, dcs = [], [], []
    for i, (data, image) in enumerate(images):
        single = len(image.components) == 1
        across, down = image.grid()
        plan = []
        try:
            for c, dc, ac in image.scan:
                _, ch, cv, _ = image.components[c]
                for k in range(1 if single else ch * cv):
                    tables = [bank.setdefault(image.tables[key], len(bank)) for key in ((0, dc), (1, ac))]
                    plan.append((c, *tables, k))
        except KeyError:
            plans.append(None)
            dcs.append(None)
            continue
        luma = [k for k, p in enumerate(plan) if p[0] == 0]
        mcus = across * down
        per = image.interval or mcus
        if len(image.segments) != -(-mcus // per):
            plans.append(None)
            dcs.append(None)
            continue
        for s, (low, high) in enumerate(image.segments):
            pieces.append(data[low:high].replace(b"\xff\x00", b"\xff") + b"\xff" * 8)
            lanes.append((i, s * per, min(per, mcus - s * per)))
        plans.append(plan)
        dcs.append((across, down, luma, 1 if single else image.components[0][1], 1 if single else image.components[0][2]))
    out: list[np.ndarray | None] = [None] * len(images)
    if not lanes:
        return out
    tables = np.stack([lookup(*t) for t in bank])
    blocks = max(len(p) for p in plans if p)
    shape = np.zeros((len(images), blocks, 4), np.int64)
    for i, p in enumerate(plans):
        if p:
            shape[i, : len(p)] = p
    n_blocks = np.array([len(p or ()) for p in plans])
    slots = np.array([len(d[2]) * d[0] * d[1] if d else 0 for d in dcs])
    base = np.cumsum(slots) - slots
    n_luma = np.array([len(d[2]) if d else 0 for d in dcs])
    values = np.zeros(int(slots.sum()), np.int32)
    broken = np.zeros(len(images), bool)

    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    raw = np.append(raw, np.full(8, 255, np.uint32))
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    sizes = np.array([len(p) for p in pieces], np.int64)
    limit = np.cumsum(sizes) * 8
    who = np.array([x[0] for x in lanes])
    bit = limit - sizes * 8
    mcu, left = np.array([x[1] for x in lanes]), np.array([x[2] for x in lanes])
    block, k = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    previous = np.zeros((len(lanes), int(shape[:, :, 0].max()) + 1), np.int32)
    lane = np.arange(len(lanes))
    while len(who):
        place = shape[who, block]
        first = k == 0
        window = words[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32) & 0xFFFF
        found = tables[np.where(first, place[:, 1], place[:, 2]), window]
        length, symbol = (found >> 8).astype(np.int64), (found & 0xFF).astype(np.int64)
        size = np.where(first, symbol, symbol & 15)
        bit = bit + length
        bad = (length == 0) | (bit + size > limit) | (size > 15)
        if first.any():
            d, s = np.flatnonzero(first & ~bad), size[first & ~bad]
            extra = (words[bit[d] >> 3] >> (16 - (bit[d] & 7)).astype(np.uint32) & 0xFFFF).astype(np.int64) >> (16 - s)
            diff = np.where((s > 0) & (extra < (1 << np.maximum(s - 1, 0))), extra - (1 << s) + 1, extra)
            comp = place[d, 0]
            previous[lane[d], comp] += diff.astype(np.int32)
            luma = comp == 0
            e = d[luma]
            values[base[who[e]] + mcu[e] * n_luma[who[e]] + place[e, 3]] = previous[lane[e], 0]
        bit = bit + size
        run = symbol >> 4
        k = np.where(first, 1, np.where(symbol == 0, 64, k + run + 1))
        done = k >= 64
        bad |= k > 64
        block = block + done
        k[done] = 0
        full = done & (block >= n_blocks[who])
        block[full] = 0
        mcu, left = mcu + full, left - full
        if bad.any() or full.any():
            broken[who[bad]] = True
            keep = (left > 0) & ~bad
            if not keep.all():
                who, bit, limit, mcu, left, block, k, lane = (x[keep] for x in (who, bit, limit, mcu, left, block, k, lane))
    for i, d in enumerate(dcs):
        if d is None or broken[i]:
            continue
        across, down, luma, h, v = d
        image = images[i][1]
        grid = values[base[i] : base[i] + slots[i]].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        scale = image.quant.get(image.components[0][3], 1)
        most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
        if len(image.components) > 1:  # luminance samples, where it isn't the finest component
            grid = grid[: -(-image.height * v // (8 * most_v)), : -(-image.width * h // (8 * most_h))]
        out[i] = np.clip(np.rint(grid * (scale / 8.0)) + 128, 0, 255).astype(np.uint8)
    return out


def difference_hash(thumb: np.ndarray) -> int:
    """64-bit difference hash of a 9x8 box-sampled thumbnail."""
    rows = np.minimum((np.arange(8) * 2 + 1) * thumb.shape[0] // 16, thumb.shape[0] - 1)
    cols = np.minimum((np.arange(9) * 2 + 1) * thumb.shape[1] // 18, thumb.shape[1] - 1)
    small = thumb[np.ix_(rows, cols)].astype(np.int16)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")
