"""Media columns: bytes stored losslessly as the coefficients of a progressive JPEG, and read back scan by scan.

A payload byte is one quantised DCT coefficient (value - 128). The encoder writes a 4:2:0 image in progressive scans: DC
and two AC bands (spectral selection) at half precision, then a refinement scan for each (successive approximation).
The decoder accumulates all scans into coefficient arrays, which give the payload back bit for bit; an inverse transform
in numpy, chroma upsampling and the colour transform make the RGB tensor.

Files have a restart marker after each MCU, so the decoder advances in all restart intervals of a batch of files at once:
each numpy step decodes one symbol in every interval.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

UNIT = 192
#: Payload bytes that are coded together; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20
MCU_COLUMNS = 64
#: Payload bytes of a row of MCUs, and rows of a file: a longer payload is stored as several files of nearly equal size, one after another.
ROW_BYTES, PART_ROWS = MCU_COLUMNS * 6 * 64, 85
#: Scans: components, first and last coefficient, high and low bit.
SCANS = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))] + [((0, 1, 2), 0, 0, 1, 0)] + [((c,), 1, 63, 1, 0) for c in range(3)]
#: Horizontal and vertical sampling of the components.
SAMPLING = ((2, 2), (1, 1), (1, 1))


def _zigzag() -> np.ndarray:
    cells = sorted(((y + x, y if (y + x) % 2 else x, y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


ZIGZAG = _zigzag()
#: Code lengths by rule: 4 bits for DC sizes 0..11 and for AC sizes without a run, 9 bits for the other AC symbols.
DC_SYMBOLS = [(s, 4) for s in range(12)]
AC_SYMBOLS = [(s, 4) for s in range(1, 11)] + [(0, 4), (0xF0, 9)] + [(r << 4 | s, 9) for r in range(1, 16) for s in range(1, 11)]


def codes(symbols: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical Huffman code and length of each symbol."""
    code, length, at, last = np.zeros(256, np.int32), np.zeros(256, np.int32), 0, 0
    for symbol, n in symbols:
        at <<= n - last
        code[symbol], length[symbol], last = at, n, n
        at += 1
    return code, length


DC_CODE, DC_LENGTH = codes(DC_SYMBOLS)
AC_CODE, AC_LENGTH = codes(AC_SYMBOLS)


def bits_of(v: np.ndarray) -> np.ndarray:
    """Bits of |v|, below 2**12."""
    return _BITS[np.abs(v)]


_BITS = np.array([int(i).bit_length() for i in range(1 << 12)], np.int32)


def low_bits(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """JPEG's value bits: v itself, or v - 1 below zero, in n bits."""
    return np.where(v < 0, v + (1 << n) - 1, v)


@lru_cache(4096)
def geometry(n_mcu: int) -> tuple[int, int]:
    columns = min(n_mcu, MCU_COLUMNS)
    return columns, -(-n_mcu // columns)


@lru_cache(4096)
def block_order(columns: int, rows: int, component: int) -> np.ndarray:
    """For each block of the component in raster order, its place among all blocks in MCU order."""
    h, v = SAMPLING[component]
    before = sum(a * b for a, b in SAMPLING[:component])
    per = sum(a * b for a, b in SAMPLING)
    y, x = np.divmod(np.arange(rows * v * columns * h), columns * h)
    return ((y // v) * columns + x // h) * per + before + (y % v) * h + x % h


def join_bits(segment: np.ndarray, offset: np.ndarray, value: np.ndarray, length: np.ndarray, seg_bits: np.ndarray, last_of_file: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of at most 24 bits into the bytes of segments, with stuffing and restart markers; and each segment's end."""
    seg_bytes = (seg_bits + 7) // 8
    start = np.concatenate([[0], np.cumsum(seg_bytes)])
    at = start[segment] * 8 + offset
    word = value.astype(np.int64) << (32 - length - (at & 7))
    first = at >> 3
    out = np.zeros(start[-1] + 4)
    for j in range(4):
        out += np.bincount(first + j, (word >> (24 - 8 * j)) & 255, len(out))
    data = out[: start[-1]].astype(np.uint8)
    pad = seg_bytes * 8 - seg_bits
    some = seg_bytes > 0
    data[start[1:][some] - 1] |= ((1 << pad[some]) - 1).astype(np.uint8)  # the rest of the last byte is ones
    full = data == 255
    shift = np.concatenate([[0], np.cumsum(full)])
    owner = np.repeat(np.arange(len(seg_bytes)), seg_bytes)
    markers = np.concatenate([[0], np.cumsum(np.where(last_of_file, 0, 2))])
    place = np.arange(len(data)) + shift[:-1] + markers[owner]
    final = np.zeros(len(data) + shift[-1] + markers[-1], np.uint8)
    final[place] = data
    ends = start[1:] + shift[start[1:]] + markers[1:]
    inner = ~last_of_file
    final[ends[inner] - 2] = 255
    final[ends[inner] - 1] = 0xD0 + number[inner] % 8
    return final, ends


def encode_scan(blocks: np.ndarray, scan, groups: int) -> tuple[np.ndarray, ...]:
    """Entries (segment, offset, value, length) and bits of each segment. blocks: (n, 64) in scan order; groups: blocks in a segment."""
    _, a, b, high, low = scan
    n = len(blocks)
    if a == 0:
        dc = blocks[:, 0].reshape(-1, groups).astype(np.int64)
        if high:
            value, length = dc & 1, np.ones_like(dc)
        else:
            diff = np.diff(dc >> low, axis=1, prepend=0)
            size = bits_of(diff)
            value, length = DC_CODE[size] << size | low_bits(diff, size), DC_LENGTH[size] + size
        ends = np.cumsum(length, axis=1)
        return np.repeat(np.arange(len(dc)), groups), (ends - length).ravel(), value.ravel(), length.ravel(), ends[:, -1]
    v = blocks[:, a : b + 1].astype(np.int32)
    size = np.abs(v)
    k = np.arange(b - a + 1, dtype=np.int32)
    if not high:
        cut = np.sign(v) * (size >> low)
        some = cut != 0
        prior = np.maximum.accumulate(np.where(some, k, -1), axis=1)
        prior = np.concatenate([np.full((n, 1), -1, np.int32), prior[:, :-1]], axis=1)
        run, bits = k - prior - 1, bits_of(cut)
        symbol = np.where(some, (run % 16) << 4 | bits, 0)
        skips = np.where(some, run // 16, 0)
        length = np.where(some, AC_LENGTH[symbol] + bits, 0)
        ends = np.cumsum(length + 9 * skips, axis=1, dtype=np.int32)
        row, col = np.nonzero(some)
        s, bit = symbol[row, col], bits[row, col]
        parts = [(row, ends[row, col] - length[row, col], AC_CODE[s] << bit | low_bits(cut[row, col], bit), length[row, col])]
        row, col = np.nonzero(skips)
        for j in range(3):
            own = skips[row, col] > j
            r, c = row[own], col[own]
            parts.append((r, ends[r, c] - length[r, c] - 9 * (j + 1), np.full(len(r), AC_CODE[0xF0]), np.full(len(r), 9)))
        total = ends[:, -1]
        open_end = np.flatnonzero(~some[:, -1])
        parts.append((open_end, total[open_end], np.full(len(open_end), AC_CODE[0]), np.full(len(open_end), AC_LENGTH[0])))
        total = total.copy()
        total[open_end] += AC_LENGTH[0]
        return *(np.concatenate(x) for x in zip(*parts)), total
    new, zero, old = size == 1, size == 0, size > 1
    zeros = np.cumsum(zero, axis=1, dtype=np.int32)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    later = np.cumsum(new[:, ::-1], axis=1)[:, ::-1] - new > 0  # a new coefficient follows
    skip = zero & (since % 16 == 0) & later
    before = zeros - np.concatenate([np.zeros((n, 1), np.int32), np.maximum.accumulate(np.where(new, zeros, 0), axis=1)[:, :-1]], axis=1)
    end = new | skip
    symbol = np.where(new, (before % 16) << 4 | 1, 0xF0)
    length = np.where(end, AC_LENGTH[symbol] + new, 0)
    final = ~end[:, -1]  # an end-of-block symbol covers the rest
    done = np.cumsum(length, axis=1, dtype=np.int32)  # symbol bits of the spans that end here or before
    owed = np.cumsum(old, axis=1, dtype=np.int32)
    at_end = np.where(end, k, -1)
    last_end = np.maximum.accumulate(at_end, axis=1)
    last_end = np.concatenate([np.full((n, 1), -1, np.int32), last_end[:, :-1]], axis=1)
    row, col = np.nonzero(end)
    prior = last_end[row, col]
    corrected = np.where(prior >= 0, owed[row, np.maximum(prior, 0)], 0)
    sign = v[row, col] > 0
    s, is_new = symbol[row, col], new[row, col]
    parts = [(row, done[row, col] - length[row, col] + corrected, np.where(is_new, AC_CODE[s] << 1 | sign, AC_CODE[s]), length[row, col])]
    tail = np.flatnonzero(final)
    t = last_end[tail, -1]
    corrected = np.where(t >= 0, owed[tail, np.maximum(t, 0)], 0)
    parts.append((tail, done[tail, -1] + corrected, np.full(len(tail), AC_CODE[0]), np.full(len(tail), AC_LENGTH[0])))
    # a correction bit stands after its span's symbol: all symbols up to the next end count
    nxt = np.where(end, length, 0)
    covering = done - nxt  # symbol bits of spans that ended before k
    upcoming = np.where(end, k, b - a + 1)
    upcoming = np.minimum.accumulate(upcoming[:, ::-1], axis=1)[:, ::-1]
    own = np.where(upcoming <= b - a, np.take_along_axis(length, np.minimum(upcoming, b - a), axis=1), AC_LENGTH[0])
    row, col = np.nonzero(old)
    parts.append((row, (covering + own)[row, col] + owed[row, col] - 1, size[row, col] & 1, np.ones(len(row), np.int64)))
    total = done[:, -1] + owed[:, -1] + np.where(final, AC_LENGTH[0], 0)
    return *(np.concatenate(x) for x in zip(*parts)), total


def _table(kind: int, symbols) -> bytes:
    counts = [sum(n == k for _, n in symbols) for k in range(1, 17)]
    return struct.pack(">HHB16B", 0xFFC4, 19 + len(symbols), kind, *counts) + bytes(s for s, _ in symbols)


_TABLES = _table(0, DC_SYMBOLS) + _table(0x10, AC_SYMBOLS)


def _scan_header(scan) -> bytes:
    comps, a, b, high, low = scan
    return struct.pack(">HHB", 0xFFDA, 6 + 2 * len(comps), len(comps)) + b"".join(bytes((c + 1, 0)) for c in comps) + bytes((a, b, high << 4 | low))


def _header(columns: int, rows: int, n_payload: int) -> bytes:
    frame = struct.pack(">HHBHHB", 0xFFC2, 17, 8, rows * 16, columns * 16, 3) + b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(SAMPLING))
    note = b"payload %d" % n_payload
    return b"\xff\xd8" + struct.pack(">HH", 0xFFFE, 2 + len(note)) + note + struct.pack(">HHB", 0xFFDB, 67, 0) + b"\x01" * 64 + frame + _TABLES + struct.pack(">HHH", 0xFFDD, 4, 1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload (a positive multiple of 192 bytes)."""
    shapes = [geometry(-(-len(p) // (6 * 64))) for p in payloads]
    sizes = np.array([c * r for c, r in shapes])
    blocks = np.zeros((sizes.sum() * 6, 64), np.int16)
    starts = np.concatenate([[0], np.cumsum(sizes * 6)])
    flat = blocks.reshape(-1)
    for p, s in zip(payloads, starts):
        flat[s * 64 : s * 64 + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
    parts = [[_header(c, r, len(p))] for (c, r), p in zip(shapes, payloads)]
    for scan in SCANS:
        comps = scan[0]
        if len(comps) > 1:
            own, per_file, groups = blocks, sizes, 6
        else:
            orders = [block_order(c, r, comps[0]) + s for (c, r), s in zip(shapes, starts)]
            own, per_file, groups = blocks[np.concatenate(orders)], np.array([len(o) for o in orders]), 1
        ends_at = np.cumsum(per_file)
        last = np.zeros(ends_at[-1], bool)
        last[ends_at - 1] = True
        number = np.arange(ends_at[-1]) - np.repeat(ends_at - per_file, per_file)
        data, ends = join_bits(*encode_scan(own, scan, groups), last, number)
        head, begin = _scan_header(scan), 0
        raw = data.tobytes()
        for part, e in zip(parts, ends[ends_at - 1]):
            part += [head, raw[begin:e]]
            begin = e
    return [b"".join(p) + b"\xff\xd9" for p in parts]


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def parse(data: bytes) -> dict:
    """The segments of one file. Files must be progressive, 8 bits, with a restart interval of one MCU."""
    out: dict = {"tables": {}, "scans": [], "restart": 0}
    at = 2
    while data[at + 1] != 0xD9:
        kind, n = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xFFC2:
            _, out["height"], out["width"], count = struct.unpack_from(">BHHB", body)
            out["sampling"] = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(count))
        elif kind == 0xFFC4:
            out["tables"][body[0]] = body[1:]
        elif kind == 0xFFDB:
            out["quant"] = body[1:65]
        elif kind == 0xFFDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif kind == 0xFFFE:
            out["note"] = body
        elif kind == 0xFFDA:
            c = body[0]
            end = _SCAN_END.search(data, at).start()
            comps = tuple(body[1 + 2 * i] - 1 for i in range(c))
            out["scans"].append(((comps, body[1 + 2 * c], body[2 + 2 * c], body[3 + 2 * c] >> 4, body[3 + 2 * c] & 15), data[at:end]))
            at = end
    if out["restart"] != 1 or out.get("sampling") != SAMPLING:
        raise ValueError("only 4:2:0 files with a restart interval of one MCU can be read")
    return out


@lru_cache(16)
def lookup(spec: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that follow."""
    out, at, i = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            span = 1 << (16 - n)
            out[at : at + span] = n << 8 | spec[i]
            at, i = at + span, i + 1
    return out


class Lanes:
    """Bit readers, one for each restart interval of many scans."""

    def __init__(self, chunks: list[bytes]) -> None:
        d = np.frombuffer(b"".join(chunks) + b"\0", np.uint8)
        after = np.zeros(len(d), bool)
        after[1:] = d[:-1] == 255
        stuffed = after & (d == 0)
        stuffed[-1] = False
        second = after & (d >= 0xD0) & (d <= 0xD7)
        first = np.zeros(len(d), bool)
        first[:-1] = second[1:]
        keep = ~(stuffed | second | first)
        place = np.cumsum(keep) - keep
        begins = np.cumsum([0] + [len(c) for c in chunks[:-1]])
        self.at = np.sort(np.concatenate([place[begins], place[np.flatnonzero(second)]])) * 8
        b = np.concatenate([d[keep], np.zeros(4, np.uint8)]).astype(np.int64)
        self.words = b[:-2] << 16 | b[1:-1] << 8 | b[2:]

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        return self.words[at >> 3] >> (8 - (at & 7)) & 0xFFFF

    def take(self, lanes: np.ndarray, n) -> np.ndarray:
        value = self.peek(lanes) >> (16 - n)
        self.at[lanes] += n
        return value

    def symbol(self, lanes: np.ndarray, look: np.ndarray) -> np.ndarray:
        found = look[self.peek(lanes)]
        self.at[lanes] += found >> 8
        return found & 255

    def value(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        got = self.take(lanes, n)
        return np.where((got < (1 << n) >> 1) & (n > 0), got - (1 << n) + 1, got)


def decode_scan(out: np.ndarray, scan, lanes: Lanes, tables: dict) -> None:
    """Add one scan's bits to out: (segments, blocks in a segment, 64)."""
    _, a, b, high, low = scan
    n = len(out)
    every = np.arange(n)
    if a == 0:
        if high:
            for g in range(out.shape[1]):
                out[:, g, 0] |= (lanes.take(every, 1) << low).astype(out.dtype)
            return
        look, last = lookup(tables[0]), np.zeros(n, np.int64)
        for g in range(out.shape[1]):
            size = lanes.symbol(every, look)
            last = last + lanes.value(every, size)
            out[:, g, 0] = last << low
        return
    look = lookup(tables[0x10])
    own = out[:, 0, :]
    if not high:
        k = np.full(n, a)
        live = every
        while len(live):
            symbol = lanes.symbol(live, look)
            run, size = symbol >> 4, symbol & 15
            k[live] += run
            some = size > 0
            l, s = live[some], size[some]
            own[l, k[l]] = lanes.value(l, s) << low
            k[live] += 1
            live = live[(some | (run == 15)) & (k[live] <= b)]
        return
    run = np.full(n, -1)  # zeros still to pass; -1: a symbol is due; 99: the block's end was read
    new = np.zeros(n, np.int64)
    for k in range(a, b + 1):
        due = np.flatnonzero(run < 0)
        if len(due):
            symbol = lanes.symbol(due, look)
            size, r = symbol & 15, symbol >> 4
            run[due] = np.where((size == 0) & (r < 15), 99, r)
            new[due] = 0
            signed = due[size > 0]
            new[signed] = 2 * lanes.take(signed, 1) - 1
        c = own[:, k]
        old = np.flatnonzero(c)
        if len(old):
            c[old] += (np.sign(c[old]) * (lanes.take(old, 1) << low)).astype(c.dtype)
        zero = np.flatnonzero((c == 0) & (run != 99))
        hit = zero[run[zero] == 0]
        c[hit] = new[hit] << low
        run[zero] -= 1


def decode(files: list[bytes]) -> list[tuple[np.ndarray, dict]]:
    """For each file its coefficients, (blocks in MCU order, 64) in zigzag order, and its header."""
    heads = [parse(f) for f in files]
    kinds: dict = {}
    for i, h in enumerate(heads):
        kinds.setdefault((tuple(s for s, _ in h["scans"]), tuple(sorted(h["tables"].items()))), []).append(i)
    out: list = [None] * len(files)
    for (scans, tables), members in kinds.items():
        shapes = [(heads[i]["width"] // 16, heads[i]["height"] // 16) for i in members]
        sizes = np.array([c * r for c, r in shapes])
        starts = np.concatenate([[0], np.cumsum(sizes * 6)])
        blocks = np.zeros((starts[-1], 64), np.int16)
        for j, scan in enumerate(scans):
            lanes = Lanes([heads[i]["scans"][j][1] for i in members])
            if len(scan[0]) > 1:
                decode_scan(blocks.reshape(-1, 6, 64), scan, lanes, dict(tables))
            else:
                order = np.concatenate([block_order(c, r, scan[0][0]) + s for (c, r), s in zip(shapes, starts)])
                own = blocks[order][:, None, :]
                decode_scan(own, scan, lanes, dict(tables))
                blocks[order] = own[:, 0, :]
        for i, s, e in zip(members, starts, starts[1:]):
            out[i] = (blocks[s:e], heads[i])
    return out


_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)], np.float32)


def rgb(coefficients: np.ndarray, head: dict) -> np.ndarray:
    """The full-resolution tensor, (height, width, 3) uint8."""
    columns, rows = head["width"] // 16, head["height"] // 16
    spatial = np.zeros((len(coefficients), 64), np.float32)
    spatial[:, ZIGZAG] = coefficients * np.frombuffer(head["quant"], np.uint8)
    spatial = np.matmul(np.matmul(_DCT.T, spatial.reshape(-1, 8, 8)), _DCT)
    planes = []
    for c, (h, v) in enumerate(head["sampling"]):
        own = spatial[block_order(columns, rows, c)].reshape(rows * v, columns * h, 8, 8)
        plane = own.transpose(0, 2, 1, 3).reshape(rows * v * 8, columns * h * 8)
        planes.append(plane if h == 2 else plane.repeat(2, axis=0).repeat(2, axis=1))
    y, cb, cr = planes[0] + 128, planes[1], planes[2]
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1) + 0.5, 0, 255).astype(np.uint8)


def payload_of(coefficients: np.ndarray, head: dict) -> bytes:
    n = int(head["note"].split()[1])
    return (coefficients.reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def moments(tensor: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    flat = tensor.reshape(-1, 3).astype(np.int64)
    return len(flat), flat.sum(0), (flat * flat).sum(0)


def feature(sums: list[tuple[int, np.ndarray, np.ndarray]]) -> str:
    """Mean and mean square of each channel, in exact integers over the number of pixels of all parts."""
    n, total, squares = (sum(x) for x in zip(*sums))
    return ",".join(f"{a / n:.4f}:{b / n:.3f}" for a, b in zip(total, squares))


def parts_of(payload: bytes) -> list[bytes]:
    """The payload cut at rows of MCUs into parts of at most PART_ROWS rows, as even as can be."""
    rows = -(-len(payload) // ROW_BYTES)
    n = -(-rows // PART_ROWS)
    cuts = [rows * i // n * ROW_BYTES for i in range(n)] + [len(payload)]
    return [payload[a:b] for a, b in zip(cuts, cuts[1:])]


def files_of(media: bytes) -> list[bytes]:
    """The files that a stored form consists of. An end marker with a start marker after it occurs nowhere inside one."""
    return re.split(rb"(?<=\xff\xd9)(?=\xff\xd8)", media)


def read_back(media: bytes, tensors: bool) -> tuple[bytes, str, list[np.ndarray]]:
    """(payload, feature, tensors) of a stored form, part by part."""
    payload, sums, kept = [], [], []
    for f in files_of(media):
        [(c, head)] = decode([f])
        payload.append(payload_of(c, head))
        tensor = rgb(c, head)
        sums.append(moments(tensor))
        kept += [tensor] if tensors else []
    return b"".join(payload), feature(sums), kept


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    n = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw.ljust(n, b" ")


def store(documents: DataFrame, tensors: bool = False) -> DataFrame:
    """doc_id with the stored file (``media``) and what reading it back gives; with tensors, also ``height``, ``width`` and ``rgb``.

    A null or empty text is 192 bytes of padding. Each row depends on its text alone, so equal texts give equal values.
    Beyond 2 MB, ``media`` is several files of equal width, one after another; their tensors are stacked.
    """
    extra = ", height int, width int, rgb binary" if tensors else ""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary" + extra

    def run(ids: list, sized: list[tuple[int, bytes]]) -> pd.DataFrame:
        if len(sized[0][1]) > BATCH_BYTES:  # alone; part by part, so memory doesn't grow with the text
            f = b"".join(encode([p])[0] for p in parts_of(sized[0][1]))
            payload, features, planes = read_back(f, tensors)
            done = [(f, payload, features, planes)]
        else:
            files = encode([p for _, p in sized])
            done = []
            for f, (c, head) in zip(files, decode(files)):
                tensor = rgb(c, head)
                done.append((f, payload_of(c, head), feature([moments(tensor)]), [tensor]))
        rows = []
        for i, (n, _), (f, payload, features, planes) in zip(ids, sized, done):
            row = [i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), features, f]
            rows.append(row + ([sum(p.shape[0] for p in planes), planes[0].shape[1], b"".join(p.tobytes() for p in planes)] if tensors else []))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, sized, size = [], [], 0
            for i, t in zip(frame.doc_id, frame.text):
                one = padded(t)
                n = len(one[1])
                if ids and size + n > BATCH_BYTES:  # so a payload beyond BATCH_BYTES is always alone, and its files depend on nothing else
                    yield run(ids, sized)
                    ids, sized, size = [], [], 0
                ids.append(None if pd.isna(i) else int(i))
                sized.append(one)
                size += n
            if ids:
                yield run(ids, sized)

    return documents.select("doc_id", "text").mapInPandas(batches, schema)


def op7_media_progressive_jpeg(spark, sf_dir):
    return store(table(spark, sf_dir, "documents")).drop("media")
