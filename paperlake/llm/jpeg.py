"""Baseline JPEG in numpy: a lossless byte carrier in quantised coefficients, and a decoder of baseline scans.

Writing: a payload byte is one quantised coefficient (the format's unit), in zigzag order; a minimum coded unit of
three full-resolution components holds 192 of them. Every quantiser step is 1 and every unit is a restart interval.
Reading: markers are parsed, entropy-coded segments of all images of a batch that share their tables are
Huffman-decoded in lockstep, one symbol of every restart interval at a time.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 192
#: Code lengths by symbol; a coefficient's symbol is its number of bits, 0 ends a block, 0xF0 is 16 zeros.
_AC_LENGTH = {0x03: 2, 0x04: 2, 0x02: 3, 0x05: 3, 0x07: 3, 0x01: 4, 0x08: 5, 0x06: 6, 0x00: 7, 0xF0: 8}
_DC_LENGTH = {size: 4 for size in range(9)}
#: Bytes up to this one are negative coefficients, the others positive; none is zero.
_PIVOT = 109


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """(number of codes of each length, symbols in code order, symbol -> (code, length)) of a JPEG Huffman table."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, lengths[symbols[0]]
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(n == i for n in lengths.values()) for i in range(1, 17)), bytes(symbols), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


class _Writer:
    def __init__(self):
        dc_counts, dc_symbols, dc = _canonical(_DC_LENGTH)
        ac_counts, ac_symbols, ac = _canonical(_AC_LENGTH)
        self.tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, b"\x00" + dc_counts + dc_symbols) + _segment(0xC4, b"\x10" + ac_counts + ac_symbols) + _segment(0xDD, b"\x00\x01")
        self.scan = _segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
        self.bits = np.zeros((2, 256), np.uint64)
        self.size = np.zeros((2, 256), np.int64)
        for b in range(256):
            v = b - _PIVOT if b > _PIVOT else b - _PIVOT - 1
            n = abs(v).bit_length()
            low = v if v > 0 else v + (1 << n) - 1
            for k, codes in enumerate((dc, ac)):
                code, length = codes[n]
                self.bits[k, b] = code << n | low
                self.size[k, b] = length + n

    def frame(self, units: int, payload: int) -> tuple[int, int, bytes]:
        columns = min(int(np.ceil(np.sqrt(units))), 8191)
        rows = -(-units // columns)
        if rows > 8191:
            raise ValueError("payload too long for one image")
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % payload) + self.tables
        head += _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00") + self.scan
        return columns, rows, head


_writer: list[_Writer] = []


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload; lengths are positive multiples of 192."""
    if not payloads:
        return []
    if not _writer:
        _writer.append(_Writer())
    w = _writer[0]
    frames = [w.frame(len(p) // UNIT, len(p)) for p in payloads]
    filled = [p + b" " * (c * r * UNIT - len(p)) for p, (c, r, _) in zip(payloads, frames)]
    units = np.array([c * r for c, r, _ in frames])
    data = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, UNIT)
    kind = np.ones(UNIT, np.int64)
    kind[::64] = 0
    size = w.size[kind, data]
    bits = w.bits[kind, data]
    stop = np.cumsum(size, axis=1)
    length = -(-stop[:, -1] // 8)
    last = np.zeros(len(data), bool)
    last[np.cumsum(units) - 1] = True
    room = length + np.where(last, 0, 2)  # a restart marker follows every unit but an image's last
    base = np.cumsum(room) - room
    total = int(room.sum())
    at = (stop - size + 8 * base[:, None]).ravel()
    word = bits.ravel() << (24 - (at & 7) - size.ravel()).astype(np.uint64)
    stream = np.zeros(total + 3, np.int64)
    byte = at >> 3
    for j, shift in enumerate((16, 8, 0)):
        stream += np.bincount(byte + j, weights=((word >> np.uint64(shift)) & np.uint64(0xFF)).astype(np.float64), minlength=total + 3)[: total + 3].astype(np.int64)
    stream = stream[:total]
    pad = 8 * length - stop[:, -1]
    stream[base + length - 1] |= (1 << pad) - 1
    marker = np.zeros(total, bool)
    inner = np.flatnonzero(~last)
    first = np.repeat(np.cumsum(units) - units, units)
    stream[(base + length)[inner]] = 0xFF
    stream[(base + length)[inner] + 1] = 0xD0 + (inner - first[inner]) % 8
    marker[(base + length)[inner]] = True
    stuff = (stream == 0xFF) & ~marker
    shift = np.cumsum(stuff) - stuff
    out = np.zeros(total + int(stuff.sum()), np.uint8)
    out[np.arange(total) + shift] = stream
    edge = np.concatenate((base[np.cumsum(units) - units], [total]))
    edge = edge + np.concatenate((shift, [int(stuff.sum())]))[edge]
    raw = out.tobytes()
    return [head + raw[a:b] + b"\xff\xd9" for (_, _, head), a, b in zip(frames, edge.tolist(), edge[1:].tolist())]


@dataclass
class Image:
    """What the markers say, and where the scan's entropy-coded bytes are."""

    width: int = 0
    height: int = 0
    payload: int | None = None
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, tuple[int, ...]] = field(default_factory=dict)
    huffman: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    tables: tuple = ()
    scan: tuple[int, int] = (0, 0)

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of minimum coded units."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(raw: bytes) -> Image:
    """Markers of a baseline JPEG with one interleaved scan; raises ValueError on anything else."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("broken marker")
        marker, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4])
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 2 if wide else 1
                image.quantisers[body[0] & 15] = tuple(int.from_bytes(body[1 + i * step : 1 + (i + 1) * step]) for i in range(64))
                body = body[1 + 64 * step :]
        elif marker == 0xC0:
            _, image.height, image.width, count = struct.unpack(">BHHB", body[:6])
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n_symbols = sum(body[1:17])
                image.huffman[body[0] >> 4, body[0] & 15] = body[1 : 17 + n_symbols]
                body = body[17 + n_symbols :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2])
        elif marker == 0xFE and body.startswith(b"payload "):
            image.payload = int(body[8:])
        elif marker == 0xDA:
            image.tables = tuple((body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            end = len(raw) - 2
            if raw[end:] != b"\xff\xd9" or len(image.tables) != len(image.components):
                raise ValueError("not one interleaved scan")
            image.scan = (at, end)
            return image


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits that may come next."""
    symbol, length = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            a = code << (16 - n)
            symbol[a : a + (1 << (16 - n))] = table[at]
            length[a : a + (1 << (16 - n))] = n
            code += 1
            at += 1
        code <<= 1
    return symbol, length


def _same_tables(image: Image) -> tuple:
    return (tuple((h, v) for _, h, v, _ in image.components), image.tables, tuple(sorted(image.huffman.items())), image.restart)


_TABLES: dict[tuple, tuple] = {}


def _tables_of(image: Image) -> tuple:
    key = _same_tables(image)
    if key not in _TABLES:
        _TABLES.clear()
        names = sorted(image.huffman)
        found = [_lookup(image.huffman[x]) for x in names]
        owner = [c for c, (_, h, v, _) in enumerate(image.components) for _ in range(h * v)]
        _TABLES[key] = (
            np.concatenate([s for s, _ in found]),
            np.concatenate([n for _, n in found]),
            np.array([names.index((0, image.tables[c][0])) << 16 for c in owner]),
            np.array([names.index((1, image.tables[c][1])) << 16 for c in owner]),
            np.array(owner),
        )
    return _TABLES[key]


def _decode_group(raws: list[bytes], images: list[Image]) -> list[np.ndarray]:
    symbols, lengths, dc, ac, owner = _tables_of(images[0])
    per_unit = len(owner)
    data = np.frombuffer(b"".join(r[i.scan[0] : i.scan[1]] for r, i in zip(raws, images)), np.uint8)
    edge = np.cumsum([0, *(i.scan[1] - i.scan[0] for i in images)])
    units = np.array([i.grid[0] * i.grid[1] for i in images])
    after = np.concatenate((data[1:], [0]))
    mark = (data == 0xFF) & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(data), bool)
    drop[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    drop |= mark
    drop[1:] |= mark[:-1]
    start = np.sort(np.concatenate((edge[:-1], np.flatnonzero(mark) + 2)))
    kept = np.cumsum(~drop) - ~drop
    clean = data[~drop]
    begin = np.append(kept, len(clean))[start]
    image_of = np.searchsorted(edge, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(image_of, image_of, "left")
    step = images[0].restart or int(units.max())
    count = np.minimum(step, units[image_of] - number * step) * per_unit  # blocks of each interval
    if not images[0].restart:
        count = units[image_of] * per_unit
    if (count <= 0).any() or (np.bincount(image_of, weights=count, minlength=len(images)) != units * per_unit).any():
        raise ValueError("restart intervals do not fill the image")
    wide = np.concatenate((clean, np.zeros(8, np.uint8))).astype(np.uint64)
    n = len(clean) + 1
    window = np.zeros(n, np.uint64)
    for j in range(8):
        window |= wide[j : j + n] << np.uint64(56 - 8 * j)
    first = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), 64), np.int16)
    bit = begin * 8
    block = np.zeros(len(start), np.int64)
    k = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    flat = out.ravel()
    for _ in range(int(count.max()) * 64 + 1):
        if not len(live):
            break
        kind = block % per_unit
        is_dc = k == 0
        ahead = window[np.minimum(bit >> 3, n - 1)] << (bit & 7).astype(np.uint64)
        code = (ahead >> np.uint64(48)).astype(np.int64) + np.where(is_dc, dc[kind], ac[kind])
        symbol, used = symbols[code], lengths[code]
        size = np.where(is_dc, symbol, symbol & 15)
        k = k + np.where(is_dc, 0, symbol >> 4)
        rest = (ahead << used.astype(np.uint64)) >> ((64 - size) & 63).astype(np.uint64)
        value = np.where(size > 0, rest, np.uint64(0)).astype(np.int64)
        half = (1 << size) >> 1
        value = np.where(value < half, value - (1 << size) + 1, value)
        put = size > 0
        if (k > 63).any():
            raise ValueError("broken scan")
        flat[((first + block)[put] << 6) + k[put]] = value[put]
        bit = bit + used + size
        ended = ~is_dc & (symbol == 0)
        k = np.where(ended, 64, k + 1)
        done = k > 63
        block = block + done
        k = np.where(done, 0, k)
        stay = block < count
        if not stay.all():
            live, bit, block, k, first, count = live[stay], bit[stay], block[stay], k[stay], first[stay], count[stay]
    return _undo_dc(out, owner, units, images[0].restart)


def _undo_dc(out: np.ndarray, owner: np.ndarray, units: np.ndarray, restart: int) -> list[np.ndarray]:
    """Blocks of each image, with its differential DC values summed up from each restart on."""
    result, at, per_unit = [], 0, len(owner)
    for u in units.tolist():
        part = out[at : at + u * per_unit]
        if restart != 1 or (np.bincount(owner) > 1).any():
            step = (restart or u) * per_unit
            for a in range(0, len(part), step):
                piece = part[a : a + step]
                which = np.tile(owner, len(piece) // per_unit)
                for c in range(owner.max() + 1):
                    piece[which == c, 0] = np.cumsum(piece[which == c, 0])
        result.append(part)
        at += u * per_unit
    return result


def decode(raws: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Each image's markers and its quantised coefficients (blocks in scan order, zigzag order within)."""
    images = [parse(r) for r in raws]
    out: list = [None] * len(raws)
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(_same_tables(image), []).append(i)
    for members in groups.values():
        for i, blocks in zip(members, _decode_group([raws[i] for i in members], [images[i] for i in members])):
            out[i] = (images[i], blocks)
    return out


def payload(image: Image, blocks: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    v = blocks.ravel()[: image.payload]
    return np.where(v > 0, v + _PIVOT, v + _PIVOT + 1).astype(np.uint8).tobytes()


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel for each 8 x 8 block of the first component."""
    rows, columns = image.grid
    _, h, v, quantiser = image.components[0]
    per_unit = sum(c[1] * c[2] for c in image.components)
    dc = blocks[:, 0].reshape(rows, columns, per_unit)[:, :, : h * v].reshape(rows, columns, v, h)
    plane = dc.transpose(0, 2, 1, 3).reshape(rows * v, columns * h).astype(np.int64)
    return np.clip(plane * image.quantisers[quantiser][0] // 8 + 128, 0, 255)


def average_hash(plane: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 reduction lie above their mean."""
    y = np.arange(8) * plane.shape[0] // 8
    x = np.arange(8) * plane.shape[1] // 8
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.cumsum(0).cumsum(1)
    y2, x2 = np.maximum(y + 1, (np.arange(8) + 1) * plane.shape[0] // 8), np.maximum(x + 1, (np.arange(8) + 1) * plane.shape[1] // 8)
    area = (y2 - y)[:, None] * (x2 - x)[None]
    cell = (total[y2][:, x2] - total[y][:, x2] - total[y2][:, x] + total[y][:, x]) / area
    return f"{int(np.packbits(cell.ravel() > cell.mean()).view('>u8')[0]):016x}"
