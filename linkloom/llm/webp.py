"""Lossless WebP (VP8L) for media columns: a decoder for the whole format and an encoder that can use every part of it.

Pixels are uint32 ARGB arrays of shape (height, width). The decoder reads prefix codes (simple and run-length coded), meta
prefix groups, back-references, the colour cache and the four transforms, and writes pixel arrays; streams whose channels
have codes of one length each are decoded as arrays, others symbol by symbol.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40
#: Least length of copies found by sorting, and their largest distance.
MATCH, MOST_BACK = 8, (1 << 20) - 120
#: A code that this many images have used gets a table of several literals an entry.
OFTEN = 8
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
MOST_SIDE = 1 << 14
#: Values above this distance code are plain distances.
PLANE_CODES = len(NEIGHBOURS)


# ---- bits ----


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        first, shift = self.at >> 3, self.at & 7
        out = int.from_bytes(self.data[first : first + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1)
        self.at += n
        return out


class BitWriter:
    """Collects (value, bits) pairs, first bit lowest, and packs them in one go."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.one_v: list[int] = []
        self.one_n: list[int] = []

    def write(self, value: int, n: int) -> None:
        if n:
            self.one_v.append(value)
            self.one_n.append(n)

    def _settle(self) -> None:
        if self.one_v:
            self.values.append(np.array(self.one_v, np.uint32))
            self.sizes.append(np.array(self.one_n, np.int64))
            self.one_v, self.one_n = [], []

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.values.append(values.astype(np.uint32))
        self.sizes.append(sizes.astype(np.int64))

    def bytes(self) -> bytes:
        self._settle()
        n = np.concatenate(self.sizes)
        v = np.concatenate(self.values) & (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        ends = np.cumsum(n)
        at = ends - n
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        over = np.flatnonzero((at & 63) + n > 64)  # one at most of each 64 bits
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: -(-int(ends[-1]) // 8)]


# ---- prefix codes ----


def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (code as written, first bit lowest; bits) of the canonical code with these lengths."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[s] = (_reversed(code, n), n)
        code, before = code + 1, n
    return out


class PrefixCode:
    """A decoding table: entry of the next `bits` bits -> symbol << 4 | length."""

    def __init__(self, lengths):
        codes = canonical(lengths)
        self.same, self.used, self.several = None, 0, None
        if len(codes) == 1:
            (symbol,) = codes
            self.bits, self.table = 0, [symbol << 4]
            self.same, self.order = 0, np.array([symbol], np.uint32)
            return
        if not codes or sum(2.0 ** -n for _, n in codes.values()) != 1.0:
            raise ValueError("not a complete prefix code")
        self.bits = max(n for _, n in codes.values())
        table = np.zeros(1 << self.bits, np.int64)
        for s, (code, n) in codes.items():
            table[code :: 1 << n] = s << 4 | n
        self.table = table.tolist()
        if all(n == self.bits for _, n in codes.values()):
            self.same, self.order = self.bits, (table >> 4).astype(np.uint32)

    def runs(self) -> list[tuple[bytes, int]] | None:
        """Entry of the next `bits` bits -> all literals that stand whole in them, and their bits. None for a code that few
        images have used, as the table takes longer to build than it saves."""
        self.used += 1
        if self.several is None and self.bits and self.used > OFTEN:
            self.several = []
            for word in range(1 << self.bits):
                found, at = bytearray(), 0
                while (e := self.table[word >> at]) < 4096 and at + (e & 15) <= self.bits:
                    found.append(e >> 4)
                    at += e & 15
                self.several.append((bytes(found), at))
        return self.several


@functools.lru_cache(maxsize=256)
def _code_of(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


@functools.lru_cache(maxsize=256)
def _codes_of(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Codes as written and their bits, by symbol; no bits where only one symbol occurs."""
    v, n = np.zeros(len(lengths), np.uint32), np.zeros(len(lengths), np.int64)
    codes = canonical(lengths)
    for s, (code, bits) in codes.items() if len(codes) > 1 else ():
        v[s], n[s] = code, bits
    return v, n


def _read_symbol(r: BitReader, code: PrefixCode) -> int:
    have = min(code.bits, r.size - r.at)
    at = r.at
    word = r.read(have)
    entry = code.table[word]
    if (entry & 15) > have:
        raise ValueError("the stream ends early")
    r.at = at + (entry & 15)
    return entry >> 4


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if r.read(1):
        two = r.read(1)
        lengths[r.read(8 if r.read(1) else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return _code_of(tuple(lengths))
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[CODE_LENGTH_ORDER[k]] = r.read(3)
    code = _code_of(tuple(own))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    s, before = 0, 8
    while s < alphabet and left:
        left -= 1
        x = _read_symbol(r, code)
        if x < 16:
            lengths[s] = x
            before = x or before
            s += 1
            continue
        value, bits, base = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[x - 16]
        n = base + r.read(bits)
        if s + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[s : s + n] = [value] * n
        s += n
    return _code_of(tuple(lengths))


def _limited(counts: np.ndarray, most: int) -> list[int]:
    """Lengths of a complete prefix code, none above most, for the symbols that occur (Huffman, with flattened counts where
    the code would be too long)."""
    import heapq

    used = np.flatnonzero(counts)
    lengths = [0] * len(counts)
    if len(used) <= 1:
        lengths[int(used[0]) if len(used) else 0] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), k, [int(s)]) for k, s in enumerate(used)]
        heapq.heapify(heap)
        depth, k = dict.fromkeys(map(int, used), 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(depth.values()) <= most:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        floor = floor * 2 + 1


def _level(counts: np.ndarray) -> list[int]:
    """Lengths of a code with one length: 2 ** n symbols, those that occur and, if need be, others."""
    used = np.flatnonzero(counts).tolist()
    lengths = [0] * len(counts)
    if len(used) <= 1:
        lengths[used[0] if used else 0] = 1
        return lengths
    n = max(1, (len(used) - 1).bit_length())
    have = set(used)
    spare = (s for s in range(len(counts)) if s not in have)
    for s in used + [next(spare) for _ in range((1 << n) - len(used))]:
        lengths[s] = n
    return lengths


def write_code(w: BitWriter, lengths) -> None:
    w.extend(*_written(tuple(lengths)))


@functools.lru_cache(maxsize=256)
def _written(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    w = BitWriter()
    _write_code(w, lengths)
    return np.array(w.one_v, np.uint32), np.array(w.one_n, np.int64)


def _write_code(w: BitWriter, lengths) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(int(used[0] > 1), 1)
        w.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.write(used[1], 8)
        return
    tokens, k = [], 0  # (code length symbol, extra value, extra bits)
    while k < len(lengths):
        n = lengths[k]
        run = 1
        while k + run < len(lengths) and lengths[k + run] == n:
            run += 1
        k += run
        if n:
            tokens.append((n, 0, 0))
            run -= 1
        while run >= 3:
            part = min(run, 138 if not n else 6)
            if n:
                tokens.append((16, part - 3, 2))
            elif part < 11:
                tokens.append((17, part - 3, 3))
            else:
                tokens.append((18, part - 11, 7))
            run -= part
        tokens += [(n, 0, 0)] * run
    counts = np.bincount([t for t, *_ in tokens], minlength=19)
    own = _limited(counts, 7)
    last = max((k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]), default=3)
    w.write(0, 1)
    w.write(max(4, last + 1) - 4, 4)
    for k in range(max(4, last + 1)):
        w.write(own[CODE_LENGTH_ORDER[k]], 3)
    w.write(0, 1)
    codes = canonical(own)
    for t, extra, bits in tokens:
        if len(codes) > 1:
            w.write(*codes[t])
        w.write(extra, bits)


# ---- decoder ----


def _prefix_value(symbol: int, r: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _level_pixels(r: BitReader, group: list[PrefixCode], n: int) -> np.ndarray | None:
    """n pixels of a stream of literals whose codes have one length each; None if there are other symbols among them."""
    widths = [c.same for c in group[:4]]
    if None in widths or group[0].order.max() >= 256:
        return None
    total, first = sum(widths), r.at >> 3
    if r.at + n * total > r.size:
        raise ValueError("the stream ends early")
    raw = np.frombuffer(r.data, np.uint8, count=-(-(r.at + n * total) // 8) - first, offset=first)
    bits = np.unpackbits(raw, bitorder="little")[r.at & 7 :][: n * total].reshape(n, total) if total else np.zeros((n, 0), np.uint8)
    parts, at = [], 0
    for c, k in zip(group, widths, strict=False):
        word = np.packbits(np.pad(bits[:, at : at + k], ((0, 0), (0, 16 - k))), axis=1, bitorder="little").view("<u2")[:, 0]
        parts.append(c.order[word])
        at += k
    r.at += n * total
    g, red, blue, alpha = parts
    return alpha << np.uint32(24) | red << np.uint32(16) | g << np.uint32(8) | blue


_last_read: dict[tuple[int, ...], tuple[int, int, list[PrefixCode]]] = {}


def _read_codes(r: BitReader, alphabets: tuple[int, ...]) -> list[PrefixCode]:
    """The codes of a group; where its bits are those of the group read last, they need not be taken apart again."""
    at = r.at
    if alphabets in _last_read:
        bits, n, codes = _last_read[alphabets]
        if at + n <= r.size and r.read(n) == bits:
            return codes
        r.at = at
    codes = [read_code(r, a) for a in alphabets]
    n, r.at = r.at - at, at
    _last_read[alphabets] = r.read(n), n, codes
    return codes


def _read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of over 11 bits")
    meta, meta_bits, groups = None, 0, 1
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        side = -(-width // (1 << meta_bits))
        image = _read_image(r, side, -(-height // (1 << meta_bits)), False)
        meta = (image >> 8 & 0xFFFF).tolist()
        groups = int((image >> 8 & 0xFFFF).max()) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    codes = [_read_codes(r, (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)) for _ in range(groups)]
    n = width * height
    if groups == 1:
        flat = _level_pixels(r, codes[0], n)
        if flat is not None:
            return flat.reshape(height, width)
    out, cache, cached = [0] * n, [0] * cache_size, 0
    shift, k = 32 - cache_bits, 0
    data, at, size = r.data + bytes(16), r.at, r.size
    windows = None
    if n > 64:  # 64 bits from each byte on
        raw = np.frombuffer(data, np.uint8)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8")[:, 0].tolist()
    tables = [[(c.table, (1 << c.bits) - 1) for c in g] for g in codes]
    green, red, blue, alpha, far = tables[0]
    if groups == 1 and windows and not any(c.bits for c in codes[0][1:4]):  # only the green channel has codes
        rest = np.uint32(codes[0][1].table[0] >> 4 << 16 | codes[0][2].table[0] >> 4 | codes[0][3].table[0] >> 4 << 24)
        (table, mask), (far_table, far_mask) = green, far
        found, stop = bytearray(), n - 3
        runs = codes[0][0].runs()
        fast = n - 45 if runs else 0  # three entries hold 45 literals at most
        while k < n and at < size:
            w = windows[at >> 3] >> (at & 7)
            if k < fast:
                x, a = runs[w & mask]
                if a:
                    w >>= a
                    y, b = runs[w & mask]
                    w >>= b
                    z, c = runs[w & mask]
                    found += x
                    found += y
                    found += z
                    k = len(found)
                    at += a + b + c
                    continue
            a = table[w & mask]
            w >>= a & 15
            if a < 4096:
                b = table[w & mask]
                if b < 4096 and k < stop:
                    w >>= b & 15
                    c = table[w & mask]
                    if c < 4096:
                        found += bytes((a >> 4, b >> 4, c >> 4))
                        at += (a & 15) + (b & 15) + (c & 15)
                        k += 3
                        continue
                found.append(a >> 4)
                at += a & 15
                k += 1
                continue
            s = (a >> 4) - 256
            if s >= LENGTH_CODES:
                break
            at += a & 15
            extra = max(0, (s - 2) >> 1)
            length = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + (w & ((1 << extra) - 1)) + 1
            at += extra
            w = windows[at >> 3] >> (at & 7)
            e = far_table[w & far_mask]
            w >>= e & 15
            s = e >> 4
            extra = max(0, (s - 2) >> 1)
            code = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + (w & ((1 << extra) - 1)) + 1
            at += (e & 15) + extra
            if code > PLANE_CODES:
                back = code - PLANE_CODES
            else:
                x, y = NEIGHBOURS[code - 1]
                back = max(1, x + y * width)
            if back > k or k + length > n:
                raise ValueError("a back-reference leaves the image")
            found += found[k - back : k - back + length] if back >= length else (found[k - back :] * (length // back + 1))[:length]
            k += length
        pixels = np.frombuffer(found, np.uint8).astype(np.uint32) << np.uint32(8) | rest
        if k == n and at <= size:
            r.at = at
            return pixels.reshape(height, width)
        out[:k] = pixels.tolist()
    while k < n:
        if meta is not None:
            green, red, blue, alpha, far = tables[meta[k // width >> meta_bits][k % width >> meta_bits]]
        if at > size:
            raise ValueError("the stream ends early")
        first = at >> 3
        w = (windows[first] if windows else int.from_bytes(data[first : first + 8], "little")) >> (at & 7)
        e = green[0][w & green[1]]
        s, used = e >> 4, e & 15
        if s < 256:
            w >>= used
            e = red[0][w & red[1]]
            p = s << 8 | (e >> 4) << 16
            used += e & 15
            w >>= e & 15
            e = blue[0][w & blue[1]]
            p |= e >> 4
            used += e & 15
            if used + 15 > 57:  # what is left of the window may not hold another code
                first = (at + used) >> 3
                w = int.from_bytes(data[first : first + 8], "little") >> ((at + used) & 7)
            else:
                w >>= e & 15
            e = alpha[0][w & alpha[1]]
            p |= (e >> 4) << 24
            at += used + (e & 15)
            out[k] = p
            k += 1
        elif s < 256 + LENGTH_CODES:
            r.at = at + used
            length = _prefix_value(s - 256, r)
            entry_at = r.at
            first = entry_at >> 3
            e = far[0][(int.from_bytes(data[first : first + 8], "little") >> (entry_at & 7)) & far[1]]
            r.at = entry_at + (e & 15)
            code = _prefix_value(e >> 4, r)
            if code > PLANE_CODES:
                back = code - PLANE_CODES
            else:
                x, y = NEIGHBOURS[code - 1]
                back = max(1, x + y * width)
            at = r.at
            if back > k or k + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[k] = out[k - back]
                k += 1
        else:
            while cached < k:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[k] = cache[s - 256 - LENGTH_CODES]
            at += used
            k += 1
    if at > size:
        raise ValueError("the stream ends early")
    r.at = at
    return np.array(out, np.uint32).reshape(height, width)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of pixels, each channel modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamped(values) -> int:
    out = 0
    for v in values:
        out = out << 8 | min(255, max(0, v))
    return out


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predictor modes: left, top, top right and top left neighbours."""
    if mode in (0, 14, 15):
        return OPAQUE
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    trio = list(zip(_channels(left), _channels(top), _channels(corner), strict=True))
    if mode == 11:
        to_left = sum(abs(t - c) for _, t, c in trio)  # |left + top - corner - left| of each channel
        to_top = sum(abs(x - c) for x, _, c in trio)
        return left if to_left < to_top else top
    if mode == 12:
        return _clamped(x + t - c for x, t, c in trio)
    half = [(a, c) for a, c in zip(_channels(_average(left, top)), _channels(corner), strict=True)]
    return _clamped(a + int((a - c) / 2) for a, c in half)


def _predict(image: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Residuals of an image (forward), or the image of residuals."""
    height, width = image.shape
    if not forward and set(np.unique(modes).tolist()) <= {2}:  # above the first row, everything adds up by column
        out = image.copy()
        out[0, :1] = _add(out[0, :1], np.array([OPAQUE], np.uint32))
        out[0] = np.cumsum(out[0].view(np.uint8).reshape(width, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
        channels = out.view(np.uint8).reshape(height, width, 4)
        return np.cumsum(channels, axis=0, dtype=np.uint8).view(np.uint32).reshape(height, width)
    src = image.ravel().tolist()
    out, mode = list(src), modes.tolist()
    seen = src if forward else out
    for k, p in enumerate(src):
        y, x = divmod(k, width)
        if y == 0:
            guess = seen[k - 1] if x else OPAQUE
        elif x == 0:
            guess = seen[k - width]
        else:
            guess = predicted(mode[y >> bits][x >> bits], seen[k - 1], seen[k - width], seen[k - width + 1], seen[k - width - 1])
        if forward:
            out[k] = ((p | 0x00FF00FF) - (guess & 0xFF00FF00) & 0xFF00FF00) | ((p | 0xFF00FF00) - (guess & 0x00FF00FF) & 0x00FF00FF)
        else:
            out[k] = ((p & 0xFF00FF00) + (guess & 0xFF00FF00) & 0xFF00FF00) | ((p & 0x00FF00FF) + (guess & 0x00FF00FF) & 0x00FF00FF)
    return np.array(out, np.uint32).reshape(height, width)


def _cross(image: np.ndarray, factors: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    height, width = image.shape
    f = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width]
    byte = lambda a, k: (a >> np.uint32(k) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda t, c: t * c >> 5
    red, blue, g = byte(image, 16), byte(image, 0), byte(image, 8)
    sign, old = (-1 if forward else 1), red
    red = (red + sign * delta(byte(f, 0), g)).astype(np.uint8).view(np.int8).astype(np.int32)
    blue = blue + sign * delta(byte(f, 8), g) + sign * delta(byte(f, 16), old if forward else red)
    return image & np.uint32(0xFF00FF00) | red.astype(np.uint8).astype(np.uint32) << np.uint32(16) | blue.astype(np.uint8).astype(np.uint32)


def _green(image: np.ndarray, forward: bool) -> np.ndarray:
    g = image >> np.uint32(8) & np.uint32(255)
    both = g << np.uint32(16) | g
    return _sub(image, both) if forward else _add(image, both)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a RIFF file with one VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    (n,) = struct.unpack("<I", data[16:20])
    r = BitReader(data[20 : 20 + n])
    if r.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, bits, _read_image(r, -(-now // (1 << bits)), -(-height // (1 << bits)), False), now))
        elif kind == PALETTE:
            size = r.read(8) + 1
            colours = _read_image(r, size, 1, False)
            colours = np.cumsum(colours.view(np.uint8).reshape(size, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            undo.append((kind, _packing(size), colours, now))
            now = -(-now // (1 << _packing(size)))
        else:
            undo.append((kind, 0, None, now))
    image = _read_image(r, now, height, True)
    for kind, bits, side, wide in reversed(undo):
        if kind == PREDICTOR:
            image = _predict(image, side >> np.uint32(8) & np.uint32(255), bits, False)
        elif kind == CROSS_COLOUR:
            image = _cross(image, side, bits, False)
        elif kind == SUBTRACT_GREEN:
            image = _green(image, False)
        else:
            index = image >> np.uint32(8) & np.uint32(255)
            if bits:
                depth = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(depth)) & np.uint32((1 << depth) - 1)).reshape(height, -1)[:, :wide]
            image = np.where(index < len(side), side[np.minimum(index, len(side) - 1)], np.uint32(0))
    return image


# ---- encoder ----


def _value_prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance code."""
    v -= 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def _tokens(flat: list[int], width: int, cache_bits: int, search: bool) -> list[tuple]:
    """Literals ("p", pixel), copies ("r", length, distance code) and cache hits ("c", index)."""
    plane = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}
    cache, last, out, k, n = [None] * ((1 << cache_bits) if cache_bits else 0), {}, [], 0, len(flat)

    def slot(p):
        return (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)

    while k < n:
        length, back = 0, 0
        if search and k + 3 <= n:
            at = last.get((flat[k], flat[k + 1], flat[k + 2]))
            if at is not None:
                back = k - at
                while k + length < n and length < 4096 and flat[k + length] == flat[at + length]:
                    length += 1
        step = length if length >= 3 else 1
        if length >= 3:
            out.append(("r", length, plane.get(back, back + PLANE_CODES)))
        elif cache_bits and cache[slot(flat[k])] == flat[k]:
            out.append(("c", slot(flat[k])))
        else:
            out.append(("p", flat[k]))
        for j in range(k, k + step):
            if cache_bits:
                cache[slot(flat[j])] = flat[j]
            if search and j + 3 <= n:
                last[(flat[j], flat[j + 1], flat[j + 2])] = j
        k += step
    return out


def _matches(flat: np.ndarray) -> np.ndarray:
    """Copies (start, length, distance) in a row of bytes, in order and apart: stretches in which every MATCH bytes stand before,
    all at one distance from where they stood last."""
    n = len(flat) - MATCH + 1
    if n < 2:
        return np.zeros((0, 3), np.int64)
    key = np.ndarray(n, "<u8", np.ascontiguousarray(flat), strides=(1,)).copy()
    place = max(n - 1, 1).bit_length()  # numbers of mixed keys and places sort faster than places by keys
    mixed = key * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.sort((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(place) << np.uint64(place) | np.arange(n, dtype=np.uint64))
    near = np.flatnonzero((mixed[1:] ^ mixed[:-1]) >> np.uint64(place) == 0)
    earlier, later = ((mixed[k] & np.uint64((1 << place) - 1)).astype(np.int64) for k in (near, near + 1))
    same = key[earlier] == key[later]
    earlier, later = earlier[same], later[same]
    back = np.zeros(n, np.int64)
    back[later] = later - earlier
    back[back > MOST_BACK] = 0
    starts = np.concatenate(([0], np.flatnonzero(back[1:] != back[:-1]) + 1))
    ends, far = np.concatenate((starts[1:], [n])) + MATCH - 1, back[starts]
    held = far > 0
    out, at = [], 0
    for s, e, d in zip(starts[held].tolist(), ends[held].tolist(), far[held].tolist(), strict=True):
        s = max(s, at)
        while e - s >= MATCH:
            m = min(e - s, 4096)
            out.append((s, m, d))
            s += m
        at = s
    return np.array(out, np.int64).reshape(-1, 3)


def _value_prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_value_prefix() of values of 5 and more."""
    v = v - 1
    high = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


@functools.cache
def _only(symbol: int) -> tuple[int, ...]:
    return tuple(int(c == symbol) for c in range(256))


def _write_copies(w: BitWriter, image: np.ndarray, usual: tuple[tuple[int, ...], tuple[int, ...]] | None) -> None:
    """The pixels of an image whose other channels are constant, as literals and copies."""
    flat = (image.ravel() >> np.uint32(8)).astype(np.uint8)
    starts, lengths, back = _matches(flat).T
    inside = np.zeros(len(flat) + 1, np.int64)
    inside[starts] += 1
    inside[starts + lengths] -= 1
    literals = flat[np.cumsum(inside[:-1]) == 0]
    (size, size_extra, size_bits), (far, far_extra, far_bits) = _value_prefixes(lengths), _value_prefixes(back + PLANE_CODES)
    size = size + 256
    counts = np.bincount(literals, minlength=256 + LENGTH_CODES) + np.bincount(size, minlength=256 + LENGTH_CODES)
    if usual is not None and int(counts @ np.array(usual[0])) <= 7 * int(counts.sum()):
        green, distance = usual
    else:
        green, distance = tuple(_limited(counts, 15)), tuple(_limited(np.bincount(far, minlength=DISTANCE_CODES), 15))
    write_code(w, green)
    pixel = int(image[0, 0])
    for k in (16, 0, 24):
        write_code(w, _only(pixel >> k & 255))
    write_code(w, distance)
    (v, n), (fv, fn) = _codes_of(green), _codes_of(distance)
    values, sizes = v[literals], n[literals]
    if len(starts):
        before = np.repeat(starts - (np.cumsum(lengths) - lengths), 4)  # literals in front of each copy
        values = np.insert(values, before, np.stack((v[size], size_extra, fv[far], far_extra), 1).ravel())
        sizes = np.insert(sizes, before, np.stack((n[size], size_bits, fn[far], far_bits), 1).ravel())
    w.extend(values, sizes)


def _if_short(counts: np.ndarray, usual: tuple[int, ...]) -> tuple[int, ...] | None:
    """The usual code, unless it takes more than seven bits a symbol."""
    return usual if int(counts @ np.array(usual)) <= 7 * int(counts.sum()) else None


def _write_image(w: BitWriter, image: np.ndarray, main: bool, level: bool = False, cache_bits: int = 0, search: bool = False, usual: tuple | None = None, copies: bool = False) -> None:
    w.write(int(cache_bits > 0), 1)
    w.write(cache_bits, 4 if cache_bits else 0)
    if main:
        w.write(0, 1)
    flat = image.ravel()
    if copies and not cache_bits and ((flat ^ flat[0]) & np.uint32(0xFFFF00FF) == 0).all():
        _write_copies(w, image, usual)
        return
    if copies:
        usual = None
    if not cache_bits and not search:
        parts = [(flat >> np.uint32(k) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24)]
        lengths = []
        for k, p in enumerate(parts):
            one = (p == p[0]).all()
            counts = np.zeros(256, np.int64)
            counts[p[0]] = 1
            counts = counts if one else np.bincount(p, minlength=256)
            made = _level(counts) if level else None if one or k or usual is None else _if_short(counts, usual)
            lengths.append(made or _limited(counts, 15))
        write_code(w, (*lengths[0], *[0] * LENGTH_CODES))
        for x in (*lengths[1:], [1] + [0] * (DISTANCE_CODES - 1)):
            write_code(w, x)
        codes = [_codes_of(tuple(x)) for x in lengths]
        codes = [(v[p], n[p]) for (v, n), p in zip(codes, parts, strict=True) if n.any()]
        if codes:
            w.extend(np.stack([v for v, _ in codes], 1).ravel(), np.stack([n for _, n in codes], 1).ravel())
        return
    tokens = _tokens(flat.tolist(), image.shape[1], cache_bits, search)
    counts = [np.zeros(n, np.int64) for n in (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)]
    for kind, *x in tokens:
        if kind == "p":
            for k, c in enumerate(_channels(x[0])):
                counts[(3, 1, 0, 2)[k]][c] += 1
        elif kind == "r":
            counts[0][256 + _value_prefix(x[0])[0]] += 1
            counts[4][_value_prefix(x[1])[0]] += 1
        else:
            counts[0][256 + LENGTH_CODES + x[0]] += 1
    codes = []
    for c in counts:
        lengths = _limited(c, 15)
        write_code(w, lengths)
        codes.append(canonical(lengths))

    def put(k: int, s: int) -> None:
        if len(codes[k]) > 1:
            w.write(*codes[k][s])

    for kind, *x in tokens:
        if kind == "p":
            a, red, g, blue = _channels(x[0])
            for k, s in enumerate((g, red, blue, a)):
                put(k, s)
        elif kind == "r":
            for k, v, base in ((0, x[0], 256), (4, x[1], 0)):
                s, extra, bits = _value_prefix(v)
                put(k, base + s)
                w.write(extra, bits)
        else:
            put(0, 256 + LENGTH_CODES + x[0])


def encode(image: np.ndarray, palette: bool = True, green: bool = False, cross: int | None = None, predictor: int | None = None, level: bool = False, cache_bits: int = 0, search: bool = False, usual: tuple | None = None, copies: bool = False) -> bytes:
    """A RIFF file that decode() turns into the same pixels.

    palette: index colours if there are at most 256. green: subtract the green channel. cross: one cross-colour element for
    every block. predictor: one mode for every block (15: modes in turn). level: codes of one length for each channel.
    cache_bits, search: use a colour cache of this many bits, and back-references. usual: code lengths of the
    green channel to use where they do well, so that images need no code of their own. copies: back-references found by sorting,
    for images whose only varying channel (after the transforms) is green; usual is then such lengths and those of distances."""
    height, width = image.shape
    if not (0 < height <= MOST_SIDE and 0 < width <= MOST_SIDE):
        raise ValueError("a side must have 1 to 16384 pixels")
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    if predictor is not None:
        bits = 2
        shape = (-(-height // 4), -(-width // 4))
        modes = (np.arange(shape[0] * shape[1]) % 14).reshape(shape) if predictor == 15 else np.full(shape, predictor)
        w.write(1 | PREDICTOR << 1 | (bits - 2) << 3, 6)
        _write_image(w, modes.astype(np.uint32) << np.uint32(8), False)
        image = _predict(image, modes, bits, True)
    if cross is not None:
        bits = 3
        factors = np.full((-(-height // 8), -(-width // 8)), cross, np.uint32)
        w.write(1 | CROSS_COLOUR << 1 | (bits - 2) << 3, 6)
        _write_image(w, factors, False)
        image = _cross(image, factors, bits, True)
    if green:
        w.write(1 | SUBTRACT_GREEN << 1, 3)
        image = _green(image, True)
    if palette:
        colours, index = np.unique(image, return_inverse=True)
        if len(colours) <= 256:
            w.write(1 | PALETTE << 1, 3)
            w.write(len(colours) - 1, 8)
            steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_image(w, np.ascontiguousarray(steps).view(np.uint32).reshape(1, -1), False)
            index, bits = index.reshape(height, width).astype(np.uint32), _packing(len(colours))
            if bits:
                side = -(-width // (1 << bits))
                index = np.pad(index, ((0, 0), (0, (side << bits) - width))).reshape(height, side, 1 << bits)
                index = (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(2, dtype=np.uint32)
            image = np.uint32(OPAQUE) | index << np.uint32(8)
    w.write(0, 1)
    _write_image(w, image, True, level, cache_bits, search, usual, copies)
    body = w.bytes()
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
