"""Progressive JPEG in numpy: many images at a time, bit-exact coefficients, full-resolution RGB.

The coder keeps payload bytes as quantised coefficients (the format's unit): 64 bytes are one 8 x 8 block in zigzag order,
six blocks one MCU of 4:2:0 (four luma, two chroma), all quantisers are one. Scans: DC with the lowest bit left out, AC
1-5 and 6-63 of each component likewise (spectral selection), then the lowest bits of all (successive approximation).
Restart intervals are short, so the decoder walks all intervals of all images of a piece in step, as lanes of arrays.

The decoder reads any progressive file of 8-bit samples with up to four components and whole-number sampling factors:
scans in any legal order are accumulated into the coefficient arrays, which are dequantised, inverse-transformed,
upsampled and turned to RGB. All arithmetic is element by element, so equal files give equal tensors in any piece.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np

RESTART = 8             # blocks or MCUs in a restart interval
LAYOUT = (2, 1, 1)      # sampling factors of the coder's components
MCU_BLOCKS = 6
WINDOW = 30             # bits looked at in one step: a code of 16 and 14 more


def zigzag_order() -> np.ndarray:
    """Natural index (8 * row + column) of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)),
                   key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag_order()


def code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Lengths of the coder's own Huffman codes: DC categories alike; AC short for single values of five and six bits."""
    ac = {(r << 4) | s: 10 for r in range(16) for s in range(11)}
    ac.update({s: 5 for s in range(11)})
    ac.update({5: 2, 6: 2})
    return {s: 4 for s in range(12)}, ac


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, int]]:
    """(codes per length, symbols in order, code of each symbol)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        codes[s], last = code, lengths[s]
        code += 1
    return counts, symbols, codes


class CodeTable:
    """Codes by symbol for the coder."""

    def __init__(self, lengths: dict[int, int]):
        self.counts, self.symbols, codes = canonical(lengths)
        self.code = np.zeros(256, dtype=np.uint64)
        self.size = np.zeros(256, dtype=np.int64)
        for s, c in codes.items():
            self.code[s], self.size[s] = c, lengths[s]

    def segment(self, kind: int) -> bytes:
        body = bytes([kind << 4]) + bytes(self.counts) + bytes(self.symbols)
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


DC_CODES, AC_CODES = map(CodeTable, code_lengths())
ZRL = 0xF0


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of non-negative whole numbers below 2 ** 16."""
    return BITS[x]


BITS = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.int64)


# ---- coder -----------------------------------------------------------------------------------------------------------

def pack_bits(value: np.ndarray, size: np.ndarray, segment: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each padded with ones to a whole byte, and the bytes of each; sizes are 1 to 63 bits."""
    bits = np.bincount(segment, size, n_segments).astype(np.int64)
    n_bytes = (bits + 7) // 8
    start = np.cumsum(n_bytes) - n_bytes
    before = np.cumsum(size) - size
    first = np.cumsum(bits) - bits
    pos = before - first[segment] + 8 * start[segment]
    words = np.zeros(int(n_bytes.sum()) // 8 + 2, dtype=np.uint64)
    if len(value):
        at, off = pos >> 6, (pos & 63).astype(np.uint64)
        n = size.astype(np.uint64)
        high = (value << (np.uint64(64) - n)) >> off
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[heads]] = np.add.reduceat(high, heads)
        over = np.flatnonzero(off + n > 64)
        words[at[over] + 1] += value[over] << (np.uint64(128) - off[over] - n[over])
    raw = words.astype(">u8").view(np.uint8)[:int(n_bytes.sum())].copy()
    pad = (8 * n_bytes - bits)
    raw[start + n_bytes - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return raw, n_bytes


def stuff(raw: np.ndarray, n_bytes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data with stuffed bytes and restart markers, and where each segment's data begins.

    ``number``: the segment's place in its scan; all but the first have a marker before them.
    """
    segment = np.repeat(np.arange(len(n_bytes)), n_bytes)
    full = raw == 0xFF
    mark = np.where(number > 0, 2, 0)
    place = np.arange(len(raw)) + np.cumsum(full) - full + np.cumsum(mark)[segment]
    out = np.zeros(len(raw) + int(full.sum()) + int(mark.sum()), dtype=np.uint8)
    out[place] = raw
    heads = place[np.cumsum(n_bytes) - n_bytes]
    marked = np.flatnonzero(number > 0)
    out[heads[marked] - 2] = 0xFF
    out[heads[marked] - 1] = 0xD0 + (number[marked] - 1) % 8
    return out, heads


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _eob_runs(ends: np.ndarray, alone: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that start a run of end-of-band, and the runs' lengths. ``alone``: the block has symbols of its own."""
    same = np.concatenate([[False], (segment[1:] == segment[:-1]) & ends[:-1]])
    starts = np.flatnonzero(ends & (alone | ~same))
    if not len(starts):
        return starts, starts
    owner = np.cumsum(np.isin(np.arange(len(ends)), starts)) - 1
    return starts, np.bincount(owner[ends], minlength=len(starts))


def _eob_atoms(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = bit_length(length) - 1
    symbol = n << 4
    return (AC_CODES.code[symbol] << n.astype(np.uint64)) | (length - (1 << n)).astype(np.uint64), AC_CODES.size[symbol] + n


def code_ac_first(coefs: np.ndarray, segment: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, size, segment) of the symbols of a band of blocks, without the ``low`` lowest bits."""
    v = np.sign(coefs) * (np.abs(coefs) >> low)
    block, k = np.nonzero(v)
    x = v[block, k].astype(np.int64)
    head = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, dtype=bool)
    run = np.where(head, k, k - np.concatenate([[0], k[:-1]]) - 1)
    size = bit_length(np.abs(x))
    symbol = ((run & 15) << 4) | size
    value = (AC_CODES.code[symbol] << size.astype(np.uint64)) | _signed_bits(x, size)
    bits = AC_CODES.size[symbol] + size
    count = np.bincount(block, minlength=len(coefs))
    ends = v[:, -1] == 0
    starts, length = _eob_runs(ends, count > 0, segment)
    eob, eob_bits = _eob_atoms(length)
    skips = np.flatnonzero(run > 15)
    many = run[skips] >> 4
    at = np.concatenate([np.cumsum(count)[starts], np.repeat(skips, many)])
    owner = np.concatenate([starts, np.repeat(block[skips], many)])
    value = np.insert(value, at, np.concatenate([eob, np.full(many.sum(), AC_CODES.code[ZRL])]))
    bits = np.insert(bits, at, np.concatenate([eob_bits, np.full(many.sum(), AC_CODES.size[ZRL])]))
    return value, bits, segment[np.insert(block, at, owner)]


def _refine_block(row: list[int], low: int) -> tuple[list[tuple[int, int]], int, int, bool]:
    """Symbols of a block with new coefficients; what is left over as (bits, number of bits, whether the band's end is coded)."""
    size = [abs(x) >> low for x in row]
    last_new = max(k for k, s in enumerate(size) if s == 1)
    out: list[tuple[int, int]] = []
    run = bits = n = 0

    def flush() -> None:
        nonlocal bits, n
        if n:
            out.append((bits, n))
        bits = n = 0

    for k, s in enumerate(size):
        if s == 0:
            run += 1
            continue
        while run > 15 and k <= last_new:
            out.append((int(AC_CODES.code[ZRL]), int(AC_CODES.size[ZRL])))
            run -= 16
            flush()
        if s > 1:
            bits, n = bits << 1 | (s & 1), n + 1
            continue
        symbol = run << 4 | 1
        out.append((int(AC_CODES.code[symbol]) << 1 | (row[k] > 0), int(AC_CODES.size[symbol]) + 1))
        flush()
        run = 0
    return out, bits, n, run > 0 or n > 0


def code_ac_refine(coefs: np.ndarray, segment: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, size, segment) of the symbols that add bit ``low`` to a band of blocks."""
    size = np.abs(coefs) >> low
    old = size > 1
    left = np.cumsum(old[:, ::-1], axis=1)[:, ::-1] - 1                      # correction bits after this one
    tail = np.where(old, (size & 1).astype(np.uint64) << np.maximum(left, 0).astype(np.uint64), np.uint64(0)).sum(axis=1, dtype=np.uint64)
    tail_bits = old.sum(axis=1).astype(np.int64)
    ends = np.ones(len(coefs), dtype=bool)
    fresh = np.flatnonzero((size == 1).any(axis=1))
    atoms: list[tuple[int, int]] = []
    at: list[int] = []
    for b in fresh.tolist():
        symbols, bits, n, end = _refine_block(coefs[b].tolist(), low)
        atoms += symbols
        at += [3 * b] * len(symbols)
        tail[b], tail_bits[b], ends[b] = bits, n, end
    alone = np.zeros(len(coefs), dtype=bool)
    alone[fresh] = True
    starts, length = _eob_runs(ends, alone, segment)
    # a place for the band's end and two for the corrections of each block (63 bits at most, so one suffices)
    value, bits = np.zeros(3 * len(coefs), dtype=np.uint64), np.zeros(3 * len(coefs), dtype=np.int64)
    value[3 * starts], bits[3 * starts] = _eob_atoms(length)
    value[1::3], bits[1::3] = tail, tail_bits
    owner = np.repeat(segment, 3)
    if atoms:
        value = np.insert(value, at, np.array([a[0] for a in atoms], dtype=np.uint64))
        bits = np.insert(bits, at, np.array([a[1] for a in atoms]))
        owner = np.insert(owner, at, owner[at])
    used = bits > 0
    return value[used], bits[used], owner[used]


def _scan_header(components: list[int], band: tuple[int, int], approx: tuple[int, int]) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([*band, approx[0] << 4 | approx[1]])
    return b"\xff\xda" + struct.pack(">H", len(body) + 2) + body


def grid(n_bytes: int) -> tuple[int, int]:
    """MCUs across and down that hold so many payload bytes."""
    need = math.ceil(n_bytes / (64 * MCU_BLOCKS))
    wide = min(4095, max(1, math.isqrt(need - 1) + 1)) if need > 1 else 1
    return wide, math.ceil(need / wide)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive file per payload; payloads are whole multiples of 64 bytes."""
    shape = [grid(len(p)) for p in payloads]
    mcus = np.array([w * h for w, h in shape])
    data = np.zeros((int(mcus.sum()), MCU_BLOCKS * 64), dtype=np.uint8)
    flat = data.reshape(-1)
    at = 0
    for p, m in zip(payloads, mcus.tolist()):
        flat[at:at + len(p)] = np.frombuffer(p, dtype=np.uint8)
        at += m * MCU_BLOCKS * 64
    blocks = data.reshape(-1, MCU_BLOCKS, 64).astype(np.int16)
    doc = np.repeat(np.arange(len(payloads)), mcus)
    first = np.cumsum(mcus) - mcus
    # luma blocks in the order of their rows
    luma = np.concatenate([_luma_rows(w, h) + 4 * f for (w, h), f in zip(shape, first.tolist())]) if len(payloads) else np.zeros(0, dtype=np.int64)
    parts = [blocks[:, :4].reshape(-1, 64)[luma], blocks[:, 4], blocks[:, 5]]
    owners = [np.repeat(np.arange(len(payloads)), 4 * mcus), doc, doc]

    def segments(owner: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment of each unit, and of each segment its number in the scan and its document."""
        begin = np.searchsorted(owner, np.arange(len(payloads)))
        number = (np.arange(len(owner)) - begin[owner]) // per
        change = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])]))
        index = np.zeros(len(owner), dtype=np.int64)
        index[change[1:]] = 1
        return np.cumsum(index), number[change], owner[change]

    streams: list[tuple[bytes, list[bytes]]] = []

    def add(header: bytes, value, size, segment, number, owner) -> None:
        raw, n_bytes = pack_bits(value, size, segment, len(number))
        out, heads = stuff(raw, n_bytes, number)
        begin = heads[np.searchsorted(owner, np.arange(len(payloads)))].tolist() + [len(out)]
        whole = out.tobytes()
        streams.append((header, [whole[a:b] for a, b in zip(begin, begin[1:])]))

    segment, number, owner = segments(doc, RESTART)
    unit = np.repeat(segment, MCU_BLOCKS)
    dc = (blocks[:, :, 0] >> 1).astype(np.int64)
    diff = np.zeros_like(dc)
    restart = np.concatenate([[True], segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, dtype=bool)
    diff[:, 1:4] = dc[:, 1:4] - dc[:, 0:3]
    for c, before in ((0, 3), (4, 4), (5, 5)):
        diff[:, c] = dc[:, c] - np.where(restart, 0, np.concatenate([[0], dc[:-1, before]]))
    size = bit_length(np.abs(diff)).ravel()
    value = (DC_CODES.code[size] << size.astype(np.uint64)) | _signed_bits(diff.ravel(), size)
    add(_scan_header([0, 1, 2], (0, 0), (0, 1)), value, DC_CODES.size[size] + size, unit, number, owner)
    layout = [segments(o, RESTART) for o in owners]
    for low, high in ((1, 5), (6, 63)):
        for c, part in enumerate(parts):
            add(_scan_header([c], (low, high), (0, 1)), *code_ac_first(part[:, low:high + 1], layout[c][0], 1), *layout[c][1:])
    add(_scan_header([0, 1, 2], (0, 0), (1, 0)), (blocks[:, :, 0] & 1).ravel().astype(np.uint64), np.ones(len(unit), dtype=np.int64), unit, number, owner)
    for c, part in enumerate(parts):
        add(_scan_header([c], (1, 63), (1, 0)), *code_ac_refine(part[:, 1:], layout[c][0], 0), *layout[c][1:])
    tables = DC_CODES.segment(0) + AC_CODES.segment(1) + b"\xff\xdd\x00\x04" + struct.pack(">H", RESTART)
    quant = b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shape)):
        note = b"\xff\xfe\x00\x0a" + struct.pack(">Q", len(p))
        frame = b"\xff\xc2\x00\x11\x08" + struct.pack(">HHB", 16 * h, 16 * w, 3) + b"".join(bytes([c + 1, s << 4 | s, 0]) for c, s in enumerate(LAYOUT))
        out.append(b"".join([b"\xff\xd8", note, quant, frame, tables, *[x for header, each in streams for x in (header, each[i])], b"\xff\xd9"]))
    return out


def _luma_rows(w: int, h: int) -> np.ndarray:
    """For the luma blocks of a w x h grid of MCUs in row order: number of MCU times four plus place in it."""
    r, c = np.divmod(np.arange(4 * w * h), 2 * w)
    return 4 * ((r // 2) * w + c // 2) + 2 * (r % 2) + c % 2


# ---- decoder ---------------------------------------------------------------------------------------------------------

SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


class LookUp:
    """Length and symbol of the code at the head of 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.symbol = np.zeros(1 << 16, dtype=np.int32)
        code = at = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                lo = code << (16 - n)
                self.size[lo:lo + (1 << (16 - n))], self.symbol[lo:lo + (1 << (16 - n))] = n, symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


_lookups: dict[bytes, LookUp] = {}


def look_up(raw: bytes) -> LookUp:
    if raw not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[raw] = LookUp(raw[:16], raw[16:])
    return _lookups[raw]


class Image:
    """Frame and scans of one file."""

    def __init__(self, raw: bytes):
        self.note = b""
        quant: dict[int, list[int]] = {}
        codes: dict[int, bytes] = {}
        restart = 0
        self.scans: list[tuple] = []         # (components, band, high, low, tables, restart, segments)
        at = 2
        while at < len(raw):
            kind = raw[at + 1]
            if kind == 0xD9:
                break
            size = raw[at + 2] << 8 | raw[at + 3]
            body = raw[at + 4:at + 2 + size]
            at += 2 + size
            if kind == 0xFE:
                self.note = body
            elif kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = [int.from_bytes(body[1 + wide * i:1 + wide * (i + 1)], "big") for i in range(64)]
                    body = body[1 + 64 * wide:]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    codes[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                restart = body[0] << 8 | body[1]
            elif kind == 0xC2:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                self._layout()
            elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
                raise ValueError("not a progressive Huffman-coded file")
            elif kind == 0xDA:
                names = [p[0] for p in self.parts]
                chosen = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                low, high, approx = body[1 + 2 * body[0]:4 + 2 * body[0]]
                end = SCAN_END.search(raw, at)
                stop = end.start() if end else len(raw)
                pieces = [x.replace(b"\xff\x00", b"\xff") for x in RESTARTS.split(raw[at:stop])]
                tables = tuple(codes.get((t >> 4) if low == 0 else 0x10 | (t & 15), b"") for _, t in chosen) if not (low == 0 and approx >> 4) else ()
                self.scans.append((tuple(c for c, _ in chosen), (low, high), approx >> 4, approx & 15, tables, restart, pieces))
                at = stop
        self.quant = [np.array(quant[p[3]]) for p in self.parts]

    def _layout(self) -> None:
        wide, high = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcu_w, self.mcu_h = math.ceil(self.width / (8 * wide)), math.ceil(self.height / (8 * high))
        self.scale = [(wide // p[1], high // p[2]) for p in self.parts]
        # stored blocks of each component across and down, and those that a scan of it alone holds
        self.stored = [(self.mcu_w * p[1], self.mcu_h * p[2]) for p in self.parts]
        self.alone = [(math.ceil(math.ceil(self.width * p[1] / wide) / 8), math.ceil(math.ceil(self.height * p[2] / high) / 8)) for p in self.parts]
        sizes = [w * h for w, h in self.stored]
        self.first = [sum(sizes[:i]) for i in range(len(sizes))]
        self.blocks = sum(sizes)

    def order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks of a scan in coded order, the component of each, and the blocks of an MCU."""
        if len(components) == 1:
            c = components[0]
            (w, _), (aw, ah) = self.stored[c], self.alone[c]
            r, k = np.divmod(np.arange(aw * ah), aw)
            return self.first[c] + r * w + k, np.full(aw * ah, c), 1
        own, kind = [], []
        y, x = np.divmod(np.arange(self.mcu_w * self.mcu_h), self.mcu_w)
        for c in components:
            _, ch, cv, _ = self.parts[c]
            for v in range(cv):
                for h in range(ch):
                    own.append(self.first[c] + (y * cv + v) * self.stored[c][0] + x * ch + h)
                    kind.append(c)
        return np.stack(own, axis=1).ravel(), np.tile(kind, len(y)), len(own)


class Lanes:
    """The restart intervals of some scans side by side: their bits, and the blocks that each of them fills."""

    def __init__(self, jobs: list[tuple]):
        """jobs: (first block of the image in the arrays, image, scan)."""
        chunks: list[bytes] = []
        blocks, kinds, counts = [], [], []
        for base, image, (components, _, _, _, _, restart, parts) in jobs:
            order, kind, per = image.order(components)
            n = restart * per if restart else max(len(order), 1)
            if len(parts) != math.ceil(len(order) / n):
                raise ValueError("a restart interval is missing")
            blocks.append(order + base)
            kinds.append(kind)
            counts += [min(n, len(order) - i * n) for i in range(len(parts))]
            chunks += parts
        self.block = np.concatenate(blocks)
        self.kind = np.concatenate(kinds)
        self.count = np.array(counts)
        self.begin = np.cumsum(self.count) - self.count
        sizes = np.array([len(c) + 8 for c in chunks])
        self.bytes = np.frombuffer(b"".join([c + b"\0\0\0\0\0\0\0\0" for c in chunks]), dtype=np.uint8)
        self.pos = (np.cumsum(sizes) - sizes) * 8
        wide = self.bytes.astype(np.uint64)
        window = np.zeros(len(wide), dtype=np.uint64)
        for i in range(5):
            window[:len(wide) - 4] |= wide[i:len(wide) - 4 + i] << np.uint64(32 - 8 * i)
        self.window = window.view(np.int64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next WINDOW bits."""
        return (self.window[pos >> 3] >> (40 - WINDOW - (pos & 7))) & ((1 << WINDOW) - 1)

    def bits(self, pos: np.ndarray) -> np.ndarray:
        return (self.bytes[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def dc_first(coefs: np.ndarray, lanes: Lanes, tables: list[LookUp], low: int) -> None:
    """``tables``: by component."""
    size_of, symbol_of = np.stack([t.size for t in tables]), np.stack([t.symbol for t in tables])
    pred = np.zeros((len(lanes.count), len(tables)), dtype=np.int64)
    pos = lanes.pos.copy()
    for i in range(int(lanes.count.max(initial=0))):
        live = np.flatnonzero(lanes.count > i)
        at = lanes.begin[live] + i
        c = lanes.kind[at]
        seen = lanes.peek(pos[live])
        n, s = size_of[c, seen >> (WINDOW - 16)], symbol_of[c, seen >> (WINDOW - 16)]
        pred[live, c] += _extend((seen >> (WINDOW - n - s)) & ((1 << s) - 1), s)
        coefs[lanes.block[at], 0] = pred[live, c] << low
        pos[live] += n + s


def dc_refine(coefs: np.ndarray, lanes: Lanes, low: int) -> None:
    lane = np.repeat(np.arange(len(lanes.count)), lanes.count)
    bit = lanes.bits(lanes.pos[lane] + np.arange(len(lanes.block)) - lanes.begin[lane])
    coefs[lanes.block, 0] |= bit.astype(np.int16) << low


def ac_first(coefs: np.ndarray, lanes: Lanes, table: LookUp, band: tuple[int, int], low: int) -> None:
    first, last = band
    flat = coefs.reshape(-1)
    pos, at, end = lanes.pos.copy(), lanes.begin.copy(), lanes.begin + lanes.count
    k = np.full(len(pos), first)
    home = lanes.block[np.minimum(at, len(lanes.block) - 1)] * 64
    while len(pos):
        seen = lanes.peek(pos)
        head = seen >> (WINDOW - 16)
        n, symbol = table.size[head], table.symbol[head]
        run, size = symbol >> 4, symbol & 15
        is_value = size > 0
        if is_value.all():
            more = size
            k += run
            flat[home + k] = _extend((seen >> (WINDOW - n - more)) & ((1 << more) - 1), size) << low
            k += 1
            done = (k > last).astype(np.int64)
        else:
            more = np.where(is_value, size, np.where(run < 15, run, 0))
            extra = (seen >> (WINDOW - n - more)) & ((1 << more) - 1)
            k += np.where(is_value | (run == 15), run, 0)
            w = np.flatnonzero(is_value)
            flat[home[w] + k[w]] = _extend(extra[w], size[w]) << low
            eob = ~is_value & (run < 15)
            k += 1
            done = np.where(eob, (1 << run) + extra, k > last)
        pos += n + more
        if done.any():
            at += done
            k = np.where(done > 0, first, k)
            alive = at < end
            if not alive.all():
                pos, at, end, k = pos[alive], at[alive], end[alive], k[alive]
            home = lanes.block[at] * 64


def ac_refine(coefs: np.ndarray, lanes: Lanes, table: LookUp, band: tuple[int, int], low: int) -> None:
    first, last = band
    place = np.arange(first, last + 1)
    pos, at, end = lanes.pos.copy(), lanes.begin.copy(), lanes.begin + lanes.count
    k = np.full(len(pos), first)
    run_left = np.zeros(len(pos), dtype=np.int64)           # blocks whose band has ended, this one included
    while len(pos):
        stop = np.full(len(pos), last + 1)
        fresh = np.zeros(len(pos), dtype=np.int64)
        block = coefs[lanes.block[at], first:last + 1]
        old = (block != 0) & (place >= k[:, None])
        ask = np.flatnonzero(run_left == 0)
        if len(ask):
            seen = lanes.peek(pos[ask])
            head = seen >> (WINDOW - 16)
            n, symbol = table.size[head], table.symbol[head]
            run, size = symbol >> 4, symbol & 15
            eob = (size == 0) & (run < 15)
            more = np.where(eob, run, size)
            extra = (seen >> (WINDOW - n - more)) & ((1 << more) - 1)
            pos[ask] += n + more
            run_left[ask] = np.where(eob, (1 << run) + extra, 0)
            walk = np.flatnonzero(~eob)
            if len(walk):
                own = ask[walk]
                zero = (block[own] == 0) & (place >= k[own, None])
                hit = zero & (np.cumsum(zero, axis=1) == run[walk, None] + 1)
                stop[own] = np.where(hit.any(axis=1), first + hit.argmax(axis=1), last + 1)
                fresh[own] = np.where(size[walk] > 0, np.where(extra[walk] > 0, 1, -1), 0) << low
        old &= place < stop[:, None]
        rank = np.cumsum(old, axis=1)
        lane, column = np.nonzero(old)
        bit = lanes.bits(pos[lane] + rank[lane, column] - 1)
        changed = np.flatnonzero(bit)
        lane, column = lane[changed], column[changed]
        x = block[lane, column]
        block[lane, column] = np.where(np.abs(x) >> low & 1, x, x + np.sign(x) * (1 << low))
        new = np.flatnonzero((fresh != 0) & (stop <= last))
        block[new, stop[new] - first] = fresh[new]
        coefs[lanes.block[at], first:last + 1] = block
        pos += rank[:, -1]
        ended = run_left > 0
        run_left -= ended
        k = np.where(ended, last + 1, stop + 1)
        over = k > last
        at += over
        k[over] = first
        alive = at < end
        if not alive.all():
            pos, at, end, k, run_left = pos[alive], at[alive], end[alive], k[alive], run_left[alive]


def coefficients(images: list[Image]) -> tuple[np.ndarray, list[int]]:
    """Quantised coefficients of all blocks, in zigzag order, and each image's first block."""
    first = np.concatenate([[0], np.cumsum([x.blocks for x in images])]).astype(np.int64).tolist()
    coefs = np.zeros((first[-1], 64), dtype=np.int16)
    # scans of different components do not depend on each other and go together
    waves: list[dict[tuple, list[tuple]]] = []
    for base, image in zip(first, images):
        level = [0] * len(image.parts)
        for scan in image.scans:
            components, band, high, low, tables, _, _ = scan
            wave = max(level[c] for c in components)
            for c in components:
                level[c] = wave + 1
            while len(waves) <= wave:
                waves.append({})
            by_component = tuple(sorted(zip(components, tables))) if band[0] == 0 else tables
            waves[wave].setdefault((band, high, low, by_component), []).append((base, image, scan))
    for wave in waves:
        for (band, high, low, tables), jobs in wave.items():
            lanes = Lanes(jobs)
            if band[0] == 0 and high:
                dc_refine(coefs, lanes, low)
            elif band[0] == 0:
                named = dict(tables)
                blank = next(iter(named.values()))
                dc_first(coefs, lanes, [look_up(named.get(c, blank)) for c in range(max(named) + 1)], low)
            elif high:
                ac_refine(coefs, lanes, look_up(tables[0]), band, low)
            else:
                ac_first(coefs, lanes, look_up(tables[0]), band, low)
    return coefs, first[:-1]


def _cosines() -> list[list[np.float32]]:
    return [[np.float32((math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)]


COSINES = _cosines()


def inverse_transform(coefs: np.ndarray) -> np.ndarray:
    """Samples (n, 8, 8) as bytes of dequantised coefficients (n, 64) in zigzag order."""
    n = len(coefs)
    grid_ = np.empty((64, n), dtype=np.float32)
    grid_[ZIGZAG] = coefs.T
    grid_ = grid_.reshape(8, 8, n)
    for axis in (0, 1):
        out = np.empty_like(grid_)
        for x in range(8):
            total = None
            for u in range(8):
                part = (grid_[u] if axis == 0 else grid_[:, u]) * COSINES[u][x]
                total = part if total is None else np.add(total, part, out=total)
            if axis == 0:
                out[x] = total
            else:
                out[:, x] = total
        grid_ = out
    samples = np.clip(np.rint(grid_ + np.float32(128)), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(samples.transpose(2, 0, 1))


def to_rgb(planes: list[np.ndarray]) -> np.ndarray:
    """RGB (height, width, 3) of full planes: grey, or luma and two chroma, in whole-number arithmetic."""
    y = planes[0].astype(np.int32)
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    b, r = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    out[:, :, 0] = np.clip(y + ((91881 * r + half) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - ((22554 * b + 46802 * r + half) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116130 * b + half) >> 16), 0, 255)
    return out


def tensors(images: list[Image], coefs: np.ndarray, first: list[int]) -> list[np.ndarray]:
    """RGB of each image at full resolution; chroma is repeated up to luma's size."""
    scaled = coefs.astype(np.int32)
    plain = all((q == 1).all() for x in images for q in x.quant)
    if not plain:
        for base, image in zip(first, images):
            for c, (w, h) in enumerate(image.stored):
                scaled[base + image.first[c]:base + image.first[c] + w * h] *= image.quant[c]
    samples = inverse_transform(scaled)
    out = []
    for base, image in zip(first, images):
        planes = []
        for c, (w, h) in enumerate(image.stored):
            begin = base + image.first[c]
            plane = samples[begin:begin + w * h].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
            across, down = image.scale[c]
            if across > 1 or down > 1:
                plane = plane.repeat(down, axis=0).repeat(across, axis=1)
            planes.append(plane[:image.height, :image.width])
        out.append(to_rgb(planes))
    return out


def payloads(images: list[Image], coefs: np.ndarray, first: list[int]) -> list[bytes]:
    """What ``encode`` was given."""
    out = []
    for base, image in zip(first, images):
        w, h = image.mcu_w, image.mcu_h
        m = w * h
        whole = np.empty((m, MCU_BLOCKS, 64), dtype=np.uint8)
        luma = np.empty((4 * m, 64), dtype=np.uint8)
        luma[_luma_rows(w, h)] = coefs[base:base + 4 * m]
        whole[:, :4] = luma.reshape(m, 4, 64)
        whole[:, 4] = coefs[base + 4 * m:base + 5 * m]
        whole[:, 5] = coefs[base + 5 * m:base + 6 * m]
        out.append(whole.tobytes()[:struct.unpack(">Q", image.note)[0]])
    return out
