"""Lossless WebP media columns.

``decode`` reads any still VP8L image: prefix codes, entropy images, back-references,
colour cache, and inverts predictor, cross-colour, subtract-green and palette
transforms, into ARGB pixels.  ``encode`` writes them, with any of these.

``encode_many`` and ``decode_many`` take many images at once: matches, cache hits and
symbols of all are found in arrays, and bit streams are read side by side, a symbol of
each image a step.

``write_samples`` stores byte strings as green images with a palette, back-references and
a colour cache, by ``encode_many``; ``read_samples`` takes them back by ``decode_many``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Generator, Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import rebatched, utf8

ROW = 576
MAX_SIDE = 16384
CACHE_BITS = 4
BATCH_BYTES = 16 << 20
#: Samples that are encoded together.
GROUP_SAMPLES = 1 << 18
#: Rows of an image of a text; a longer text takes several.
STRIP_ROWS = 16
#: Fewer images than this are decoded one by one, and so are the last ones of many.
LANES = 48
SHORTEST, LONGEST = 4, 4096
#: Bits of a code that the encoder writes; short tables are read faster.
MOST_BITS = 11

#: Fixed values of the format.
_SIGNATURE = 0x2F
_PREDICTOR, _CROSS_COLOUR, _SUBTRACT_GREEN, _PALETTE = range(4)
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_MULTIPLIER = 0x1E35A7BD
_BLACK = 0xFF000000


@lru_cache(1)
def _near() -> list[tuple[int, int]]:
    """Neighbours by distance code: by squared distance, then by |x|, right before left."""
    spots = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(spots, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), s[0] < 0))


# ---------------------------------------------------------------- prefix codes


def _depths(weights: list[int]) -> list[int]:
    """Depths of two or more leaves of increasing weight in a Huffman tree."""
    n = len(weights)
    total = 2 * n - 1
    w, up = weights + [0] * (n - 1), [0] * total
    leaf, inner = 0, n
    for k in range(n, total):
        for _ in (0, 1):
            if leaf < n and (inner >= k or w[leaf] <= w[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            w[k] += w[pick]
            up[pick] = k
    depth = [0] * total
    for k in range(total - 2, -1, -1):
        depth[k] = depth[up[k]] + 1
    return depth[:n]


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets length 1."""
    used = sorted((n, i) for i, n in enumerate(counts) if n)
    out = [0] * len(counts)
    if len(used) < 2:
        for _, i in used:
            out[i] = 1
        return out
    floor = 1
    while True:
        depth = _depths([max(n, floor) for n, _ in used])
        if max(depth) <= most:
            break
        floor = max(floor * 2, sum(n for n, _ in used) >> (most + 1))
    for (_, i), n in zip(used, depth):
        out[i] = n
    return out


@lru_cache(16)
def _mirror(n: int) -> np.ndarray:
    """All numbers of n bits with their bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def canonical(lengths: list[int]) -> list[int]:
    """Each symbol's code with its first bit lowest, as the stream takes it."""
    out, at, mirror = [0] * len(lengths), 0, _mirror(15)
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        out[i] = int(mirror[at])
        at += 1 << (15 - n)
    return out


def _canonical_rows(lengths: np.ndarray) -> np.ndarray:
    """``canonical`` of each row; a row is a complete code or has no lengths."""
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    order = np.argsort(row << 4 | size, kind="stable")
    room = 1 << (15 - size[order])
    out = np.zeros_like(lengths)
    # A complete code fills its 15 bits, so that the next row begins at 0 again.
    out[row[order], symbol[order]] = _mirror(15)[(np.cumsum(room) - room) & 0x7FFF]
    return out


class BitWriter:
    def __init__(self):
        self.value, self.size, self.done = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n
        while self.size >= 512:
            self.done.append((self.value & ((1 << 512) - 1)).to_bytes(64, "little"))
            self.value >>= 512
            self.size -= 512

    def join(self, raw: bytes, total: int) -> None:
        """Bits that follow the ``size`` ones at hand, whose places in ``raw`` are left 0, up to ``total``."""
        raw = (int.from_bytes(raw[:64], "little") | self.value).to_bytes(64, "little") + raw[64:]
        full = total // 512 * 64
        if full:
            self.done.append(raw[:full])
        self.size = total % 512
        self.value = int.from_bytes(raw[full : full + 64], "little")

    def take(self) -> bytes:
        return b"".join([*self.done, self.value.to_bytes((self.size + 7) // 8, "little")])


def _put_many(outs: list[BitWriter], own: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Values of at most 32 bits each to the streams that ``own`` numbers in increasing order."""
    held = np.array([out.size for out in outs], np.int64)
    stop = np.concatenate([[0], np.cumsum(sizes)])
    first = stop[np.searchsorted(own, np.arange(len(outs) + 1))]
    total = np.diff(first) + held
    room = total // 512 * 16 + 18
    home = np.cumsum(room) - room
    spot = stop[:-1] + (held + 32 * home - first[:-1])[own]
    shifted = values.astype(np.uint64) << (spot & 31).astype(np.uint64)
    words = np.zeros(int(room.sum()), np.uint64)
    if len(spot):
        word = spot >> 5
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[edge]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), edge)
        words[word[edge] + 1] += np.add.reduceat(shifted >> np.uint64(32), edge)
    raw = words.astype("<u4").tobytes()
    for out, a, n, bits in zip(outs, (4 * home).tolist(), (4 * room).tolist(), total.tolist()):
        out.join(raw[a : a + n], bits)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def look(self) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends early")

    def get(self, n: int) -> int:
        if not n:
            return 0
        word = self.look()
        self.skip(n)
        return word & ((1 << n) - 1)


def _short_table(lengths: dict[int, int]) -> tuple[list[int], int]:
    """``Code``'s table of a small code, and its mask."""
    if len(lengths) < 2:
        return [next(iter(lengths), 0) << 4], 0
    most = max(lengths.values())
    table, at = [-1] * (1 << most), 0
    for n, symbol in sorted((n, symbol) for symbol, n in lengths.items()):
        if at >= 1 << 15:
            raise ValueError("an overfull prefix code")
        table[int(_mirror(15)[at]) :: 1 << n] = [symbol << 4 | n] * (1 << (most - n))
        at += 1 << (15 - n)
    if at != 1 << 15:
        raise ValueError("an incomplete prefix code")
    return table, (1 << most) - 1


class Code:
    """A prefix code: ``array`` has symbol and bits by the next ``mask`` bits; both are made when asked for."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths

    @cached_property
    def array(self) -> np.ndarray:
        return _tables([self])[0]

    @cached_property
    def mask(self) -> int:
        return (1 << max(self.lengths.values())) - 1 if len(self.lengths) > 1 else 0

    @cached_property
    def table(self) -> list[int]:
        return self.array.tolist()

    def read(self, bits: BitReader) -> int:
        hit = self.table[bits.look() & self.mask]
        bits.get(hit & 15)
        return hit >> 4


def _tables(codes: list[Code]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes' tables one behind the other, where each starts, and their masks."""
    held = [c.lengths or {0: 1} for c in codes]
    many = np.array([len(x) for x in held], np.int64)
    n = int(many.sum())
    symbols = np.fromiter(chain.from_iterable(held), np.int64, n)
    sizes = np.fromiter(chain.from_iterable(x.values() for x in held), np.int64, n)
    sizes[np.repeat(many == 1, many)] = 0  # a lone symbol takes no bits
    owner = np.repeat(np.arange(len(codes)), many)
    line = owner << 16 | sizes << 12 | symbols
    line.sort()
    symbols, sizes = line & 0xFFF, line >> 12 & 15
    first = np.cumsum(many) - many
    most = sizes[first + many - 1]
    room = 1 << (most[owner] - sizes)
    whole = 1 << most
    if (np.add.reduceat(room, first) != whole).any():
        raise ValueError("an incomplete or overfull prefix code")
    start = np.cumsum(whole) - whole
    place = np.arange(whole.sum()) - np.repeat(start, whole)
    by_code = np.repeat((symbols << 4 | sizes).astype(np.int32), room)
    return by_code[np.repeat(start, whole) + (_mirror(15)[place] >> np.repeat(15 - most, whole))], start, whole - 1


@lru_cache(8)
def _code_of(packed: bytes, most: int = MOST_BITS) -> tuple[int, int, list[int] | None]:
    """(header, its bits, code lengths) of a prefix code for packed 64-bit counts; no lengths where it takes no bits."""
    counts = np.frombuffer(packed, np.int64).tolist()
    used = [i for i, n in enumerate(counts) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        symbol = used[0] if used else 0
        return (1 | symbol << 3, 4, None) if symbol < 2 else (1 | 1 << 2 | symbol << 3, 11, None)
    if len(used) == 2 and used[1] < 256:
        lengths = [0] * (used[1] + 1)
        lengths[used[0]] = lengths[used[1]] = 1
        wide = 1 if used[0] < 2 else 8
        return 1 | 1 << 1 | (wide == 8) << 2 | used[0] << 3 | used[1] << (3 + wide), 11 + wide, lengths
    lengths = code_lengths(counts, most)
    runs: list[tuple[int, int, int]] = []  # (symbol, extra, bits of extra)
    i, stop = 0, used[-1] + 1
    while i < stop:
        n = lengths[i]
        j = i + 1
        while j < stop and lengths[j] == n:
            j += 1
        run = j - i
        if n == 0:
            while run >= 11:
                k = min(run, 138)
                runs.append((18, k - 11, 7))
                run -= k
            if run >= 3:
                runs.append((17, run - 3, 3))
                run = 0
            runs += [(0, 0, 0)] * run
        else:
            runs.append((n, 0, 0))
            run -= 1
            while run >= 3:
                k = min(run, 6)
                runs.append((16, k - 3, 2))
                run -= k
            runs += [(n, 0, 0)] * run
        i = j
    tally = [0] * 19
    for s, _, _ in runs:
        tally[s] += 1
    own = code_lengths(tally, 7)
    shown = max(4, 1 + max(k for k, s in enumerate(_LENGTH_ORDER) if own[s]))
    value, size = (shown - 4) << 1, 5
    for s in _LENGTH_ORDER[:shown]:
        value |= own[s] << size
        size += 3
    n = max(2, (len(runs) - 2).bit_length())
    n += n & 1
    value |= (1 | (n - 2) // 2 << 1 | max(len(runs) - 2, 0) << 4) << size
    size += 4 + n
    if len(runs) < 2:
        runs.append((0, 0, 0))
        if not own[0]:
            raise ValueError("a code of one run")
    alone = sum(1 for x in own if x) == 1
    codes = canonical(own)
    for s, extra, bits in runs:
        if not alone:
            value |= codes[s] << size
            size += own[s]
        value |= extra << size
        size += bits
    if len(used) == 1:
        return value, size, None
    return value, size, lengths


def _get_code(bits: BitReader, size: int) -> dict[int, int]:
    """Code lengths by symbol."""
    word = bits.look()
    if word & 1:
        wide = 8 if word & 4 else 1
        lengths = {word >> 3 & (1 << wide) - 1: 1}
        bits.skip(3 + wide)
        if word & 2:
            lengths[word >> (3 + wide) & 255] = 1
            bits.skip(8)
        return lengths
    shown = 4 + (word >> 1 & 15)
    bits.skip(5)
    word = bits.look()
    bits.skip(3 * shown)
    own = {s: n for k, s in enumerate(_LENGTH_ORDER[:shown]) if (n := word >> 3 * k & 7)}
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else size
    lengths: dict[int, int] = {}
    at, before = 0, 8
    table, mask = _short_table(own)
    data, spot = bits.data, bits.at >> 3
    word, have = int.from_bytes(data[spot : spot + 16], "little") >> (bits.at & 7), 128 - (bits.at & 7)
    spot += 16
    while at < size and left:
        left -= 1
        if have < 32:
            word |= int.from_bytes(data[spot : spot + 12], "little") << have
            have += 96
            spot += 12
        hit = table[word & mask]
        word >>= hit & 15
        have -= hit & 15
        s = hit >> 4
        if s < 16:
            if s:
                lengths[at] = before = s
            at += 1
        elif s == 16:
            for _ in range(3 + (word & 3)):
                lengths[at] = before
                at += 1
            word >>= 2
            have -= 2
        elif s == 17:
            at += 3 + (word & 7)
            word >>= 3
            have -= 3
        else:
            at += 11 + (word & 127)
            word >>= 7
            have -= 7
    bits.at = 8 * spot - have
    if at > size or bits.at > bits.end:
        raise ValueError("code lengths run past the alphabet or the stream")
    return lengths


# -------------------------------------------------------------------- decoding


def _divided(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


class _Head:
    """What stands before an entropy image's symbols: its cache, prefix codes and their plan."""

    def __init__(self, bits: BitReader, width: int, height: int, main: bool):
        self.bits, self.width, self.height = bits, width, height
        self.cache_bits = bits.get(4) if bits.get(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache of more than 11 bits")
        groups, self.tile, self.plan = 1, 0, None
        if main and bits.get(1):
            self.tile = bits.get(3) + 2
            self.plan = (_entropy_image(bits, _divided(width, self.tile), _divided(height, self.tile), False) >> 8) & 0xFFFF
            groups = int(self.plan.max()) + 1
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.codes = [[Code(_get_code(bits, n)) for n in sizes] for _ in range(groups)]


def _entropy_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    return _symbols(_Head(bits, width, height, main))


def _symbols(head: _Head, out: list[int] | None = None, cache: list[int] | None = None) -> np.ndarray:
    """The pixels of one entropy image, or its rest where some are there, with what the cache then holds."""
    bits, width, height, plan, tile, codes, cache_bits = head.bits, head.width, head.height, head.plan, head.tile, head.codes, head.cache_bits
    total = width * height
    out = [] if out is None else out
    cache = ([0] * (1 << cache_bits) if cache_bits else []) if cache is None else cache
    shift = 32 - cache_bits
    near = _near()
    green, red, blue, alpha, dist = codes[0]
    table, mask = green.table, green.mask
    plain = not (red.mask or blue.mask or alpha.mask)
    base = (int(alpha.array[0]) >> 4 << 24 | int(red.array[0]) >> 4 << 16 | int(blue.array[0]) >> 4) if plain else 0
    data, spot, word, have = bits.data, bits.at >> 3, 0, 0  # the next ``have`` bits are in ``word``
    skip = bits.at & 7
    word, have, spot = int.from_bytes(data[spot : spot + 24], "little") >> skip, 192 - skip, spot + 24
    at = cached = len(out)  # pixels made, and of these put into the cache
    while at < total:
        if plan is not None:
            green, red, blue, alpha, dist = codes[plan[(at // width) >> tile, (at % width) >> tile]]
            table, mask, plain = green.table, green.mask, False
        if have < 96:
            if spot > len(data) + 24:
                raise ValueError("the stream ends early")
            word |= int.from_bytes(data[spot : spot + 24], "little") << have
            have += 192
            spot += 24
        hit = table[word & mask]
        n = hit & 15
        word >>= n
        have -= n
        s = hit >> 4
        if s < 256:
            if plain:
                out.append(base | s << 8)
            else:
                pixel = s << 8
                for code, place in ((red, 16), (blue, 0), (alpha, 24)):
                    hit = code.table[word & code.mask]
                    word >>= hit & 15
                    have -= hit & 15
                    pixel |= hit >> 4 << place
                out.append(pixel)
            at += 1
        elif s < 280:
            s -= 256
            if s < 4:
                n = s + 1
            else:
                extra = (s - 2) >> 1
                n = ((2 + (s & 1)) << extra) + (word & ((1 << extra) - 1)) + 1
                word >>= extra
                have -= extra
            hit = dist.table[word & dist.mask]
            word >>= hit & 15
            have -= hit & 15
            s = hit >> 4
            if s < 4:
                back = s + 1
            else:
                extra = (s - 2) >> 1
                back = ((2 + (s & 1)) << extra) + (word & ((1 << extra) - 1)) + 1
                word >>= extra
                have -= extra
            if back > 120:
                back -= 120
            else:
                x, y = near[back - 1]
                back = max(1, x + y * width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if back >= n:
                out += out[at - back : at - back + n]
            else:
                out += (out[at - back :] * (n // back + 1))[:n]
            at += n
        else:
            for p in out[cached:at]:
                cache[(p * _CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
            cached = at
            out.append(cache[s - 280])
            at += 1
    bits.at = 8 * spot - have
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as int planes."""
    return np.stack([(pixels >> s) & 0xFF for s in (24, 16, 8, 0)]).astype(np.int64)


def _pixels(planes: np.ndarray) -> np.ndarray:
    a, r, g, b = (planes & 0xFF).astype(np.uint32)
    return a << 24 | r << 16 | g << 8 | b


def _signed(x: np.ndarray) -> np.ndarray:
    return np.where(x > 127, x - 256, x)


def _predicted(mode: int, left, top, right, corner) -> list[int]:
    """One pixel's prediction, as four channels; ``right`` is above to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 11:
        towards = sum(abs(t - c) for t, c in zip(top, corner)) - sum(abs(x - c) for x, c in zip(left, corner))
        return left if towards < 0 else top
    out = []
    for x, t, r, c in zip(left, top, right, corner):
        if mode == 5:
            v = ((x + r >> 1) + t) >> 1
        elif mode == 6:
            v = x + c >> 1
        elif mode == 7:
            v = x + t >> 1
        elif mode == 8:
            v = c + t >> 1
        elif mode == 9:
            v = t + r >> 1
        elif mode == 10:
            v = ((x + c >> 1) + (t + r >> 1)) >> 1
        elif mode == 12:
            v = min(255, max(0, x + t - c))
        elif mode == 13:
            m = x + t >> 1
            v = min(255, max(0, m + int((m - c) / 2)))
        else:
            v = 0
        out.append(v)
    return [255, 0, 0, 0] if mode in (0, 14, 15) else out


def _with_prediction(planes: np.ndarray, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (inverts) or subtracts (applies) each pixel's prediction from true neighbours."""
    _, height, width = planes.shape
    rows = planes.transpose(1, 2, 0).tolist()
    true = rows if sign < 0 else [[None] * width for _ in range(height)]
    out = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if not x and not y:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = true[y][x - 1]
            elif not x:
                guess = true[y - 1][0]
            else:
                right = true[y - 1][x + 1] if x + 1 < width else true[y][0]
                guess = _predicted(int(modes[y >> bits, x >> bits]), true[y][x - 1], true[y - 1][x], right, true[y - 1][x - 1])
            out[y][x] = [(v + sign * g) & 255 for v, g in zip(rows[y][x], guess)]
            if sign > 0:
                true[y][x] = out[y][x]
    return np.array(out, np.int64).reshape(height, width, 4).transpose(2, 0, 1)


def _with_cross_colour(planes: np.ndarray, tiles: np.ndarray, bits: int, sign: int) -> np.ndarray:
    a, red, green, blue = planes
    height, width = green.shape
    spread = np.repeat(np.repeat(_planes(tiles), 1 << bits, 1), 1 << bits, 2)[:, :height, :width]
    _, red_to_blue, green_to_blue, green_to_red = _signed(spread)
    g = _signed(green)
    new_red = (red + sign * (green_to_red * g >> 5)) & 255
    first = new_red if sign > 0 else red
    new_blue = (blue + sign * ((green_to_blue * g >> 5) + (red_to_blue * _signed(first) >> 5))) & 255
    return np.stack([a, new_red, green, new_blue])


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unbundled(indexes: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    wide = _bundle_bits(len(palette))
    x = np.arange(width)
    packed = (indexes >> 8 & 0xFF)[:, x >> wide]
    size = 8 >> wide
    number = packed >> ((x & ((1 << wide) - 1)) * size).astype(np.uint32) & np.uint32((1 << size) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[number]


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in this file")


def _windows(numbers: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """At least 57 bits from each place of a bit stream on."""
    return numbers[bit >> 3] >> (bit & 7)


def _side_by_side(heads: list[_Head]) -> list[np.ndarray]:
    """The pixels of many entropy images, one symbol of each a step."""
    streams = [h.bits.data for h in heads]
    where = np.cumsum([0, *map(len, streams)])
    joined = b"".join(streams) + bytes(1024)
    numbers = np.ndarray((len(joined) - 8,), "<i8", joined, 0, (1,))
    # All groups' codes in one table of (symbol, bits): where each starts, and its mask.
    table, starts, masks = _tables([code for h in heads for group in h.codes for code in group])
    starts, masks = starts.reshape(-1, 5), masks.reshape(-1, 5)
    fixed = (masks[:, 1:4] == 0).all(1)
    symbol = table[starts] >> 4
    symbol = symbol.astype(np.uint32)
    base = symbol[:, 3] << np.uint32(24) | symbol[:, 1] << np.uint32(16) | symbol[:, 2]
    first_group = np.cumsum([0, *(len(h.codes) for h in heads)])[:-1]
    planned = any(h.plan is not None for h in heads)
    plans = np.concatenate([np.zeros(1, np.int64) if h.plan is None else h.plan.ravel().astype(np.int64) for h in heads])
    plan_at = np.cumsum([0, *(1 if h.plan is None else h.plan.size for h in heads)])[:-1]
    sizes = np.array([h.width * h.height for h in heads], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a spare pixel behind each image
    out = np.zeros(int((sizes + 1).sum()), np.uint32)
    caches = np.array([1 << h.cache_bits for h in heads], np.int64)
    cache = np.zeros(int(caches.sum()), np.uint32)
    near_x, near_y = np.array(_near(), np.int64).T
    lanes = {
        "bit": np.array([8 * w + h.bits.at for w, h in zip(where, heads)], np.int64), "bound": 8 * where[1:], "at": begins.copy(), "begin": begins, "end": begins + sizes,
        "width": np.array([h.width for h in heads], np.int64), "group": first_group, "first": first_group, "plan": plan_at, "tile": np.array([h.tile if h.plan is not None else 31 for h in heads], np.int64),
        "across": np.array([_divided(h.width, h.tile) if h.plan is not None else 1 for h in heads], np.int64), "number": np.arange(len(heads)), "cache": np.cumsum(caches) - caches, "shift": np.array([32 - h.cache_bits for h in heads], np.uint32),
    }
    rich = not fixed.all()

    def slot(pixels: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return pixels * np.uint32(_CACHE_MULTIPLIER) >> shift

    turn = 0
    while True:
        if turn % 16 == 0:
            live = lanes["at"] < lanes["end"]
            if (lanes["bit"] > lanes["bound"]).any():
                raise ValueError("the stream ends early")
            if not live.all():
                for i, bit in zip(lanes["number"][~live].tolist(), lanes["bit"][~live].tolist()):
                    heads[i].bits.at = bit - 8 * int(where[i])
                lanes = {k: v[live] for k, v in lanes.items()}
            if len(lanes["at"]) < LANES:
                for i, bit, at, home in zip(*(lanes[k].tolist() for k in ("number", "bit", "at", "cache"))):
                    head, begin = heads[i], int(begins[i])
                    head.bits.at = bit - 8 * int(where[i])
                    held = cache[home : home + (1 << head.cache_bits)].tolist() if head.cache_bits else []
                    out[begin : begin + sizes[i]] = _symbols(head, out[begin:at].tolist(), held).ravel()
                break
            bit, at, end, begin, width, group, homes, shift = (lanes[k] for k in ("bit", "at", "end", "begin", "width", "group", "cache", "shift"))
            start, mask, colour = starts[group, 0], masks[group, 0], base[group]
        turn += 1
        open_ = at < end
        if planned:
            spot = at - begin
            y, x = spot // width, spot % width
            group = lanes["first"] + np.where(lanes["tile"] < 31, plans[lanes["plan"] + (y >> lanes["tile"]) * lanes["across"] + (x >> lanes["tile"])], 0)
            group = np.where(open_, group, lanes["first"])
            start, mask, colour = starts[group, 0], masks[group, 0], base[group]
        hit = table[start + (_windows(numbers, bit) & mask)]
        used = (hit & 15).astype(np.int64)
        kind = hit >> 4
        value = colour | ((kind & 255) << 8).view(np.uint32)
        step = np.ones(len(at), np.int64)
        if rich:
            some = np.flatnonzero((kind < 256) & ~fixed[group])
            if len(some):
                b, own, pixel = bit[some] + used[some], group[some], (kind[some] << 8).view(np.uint32)
                for k, place in ((1, 16), (2, 0), (3, 24)):
                    h = table[starts[own, k] + (_windows(numbers, b) & masks[own, k])]
                    b = b + (h & 15)
                    pixel |= (h >> 4).view(np.uint32) << np.uint32(place)
                value[some], used[some] = pixel, b - bit[some]
        cached = np.flatnonzero(kind >= 280)
        if len(cached):
            value[cached] = cache[homes[cached] + kind[cached] - 280]
        copies = np.flatnonzero((kind >= 256) & (kind < 280) & open_)
        if len(copies):
            b, own = bit[copies] + used[copies], group[copies]
            lengths, b = _number(numbers, b, kind[copies].astype(np.int64) - 256)
            h = table[starts[own, 4] + (_windows(numbers, b) & masks[own, 4])]
            back, b = _number(numbers, b + (h & 15), (h >> 4).astype(np.int64))
            close = np.minimum(back, 120) - 1
            back = np.where(back > 120, back - 120, np.maximum(1, near_x[close] + near_y[close] * width[copies]))
            here = at[copies]
            if (back > here - begin[copies]).any() or (here + lengths > end[copies]).any():
                raise ValueError("a back-reference leaves the image")
            value[copies], used[copies], step[copies] = out[here - back], b - bit[copies], lengths
        out[at] = value
        cache[homes + slot(value, shift)] = value
        if len(copies):
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            from_ = np.repeat(here - back, lengths) + np.where(np.repeat(back < lengths, lengths), place % np.repeat(back, lengths), place)
            pixels = out[from_]
            out[np.repeat(here, lengths) + place] = pixels
            cache[np.repeat(homes[copies], lengths) + slot(pixels, np.repeat(shift[copies], lengths))] = pixels
        bit += np.where(open_, used, 0)
        np.minimum(at + step, end, out=at)
    return [out[a : a + n].reshape(h.height, h.width) for a, n, h in zip(begins, sizes, heads)]


def _number(numbers: np.ndarray, bit: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances by their prefixes and the extra bits at these places, and where those end."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    low = _windows(numbers, bit) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + low + 1), bit + extra


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels, (height, width) uint32, of lossless WebP files.

    Every file reads itself up to its next entropy image; these are decoded side by side.
    """
    readers = [_reading(data) for data in files]
    out: list[np.ndarray] = [None] * len(files)
    asked = [(i, next(reader)) for i, reader in enumerate(readers)]
    while asked:
        heads = [head for _, head in asked]
        images = _side_by_side(heads) if len(heads) >= LANES else [_symbols(head) for head in heads]
        numbers, asked = [i for i, _ in asked], []
        for i, pixels in zip(numbers, images):
            try:
                asked.append((i, readers[i].send(pixels)))
            except StopIteration as done:
                out[i] = done.value
    return out


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, (height, width) uint32, of one lossless WebP file."""
    return decode_many([data])[0]


def _reading(data: bytes) -> Generator[_Head, np.ndarray, np.ndarray]:
    """Gives the head of each entropy image of a file, takes its pixels, and returns the picture."""
    body = _chunk(data)
    if not body or body[0] != _SIGNATURE:
        raise ValueError("not a lossless bit stream")
    bits = BitReader(body[1:])
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("an unknown version")
    undo: list[tuple] = []
    across = width
    seen = set()
    while bits.get(1):
        kind = bits.get(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (_PREDICTOR, _CROSS_COLOUR):
            tile = bits.get(3) + 2
            undo.append((kind, tile, (yield _Head(bits, _divided(across, tile), _divided(height, tile), False)), across))
        elif kind == _PALETTE:
            n = bits.get(8) + 1
            steps = np.ascontiguousarray((yield _Head(bits, n, 1, False)), "<u4").view(np.uint8).reshape(n, 4)
            undo.append((kind, 0, np.cumsum(steps, 0, np.uint8).view("<u4")[:, 0], across))
            across = _divided(across, _bundle_bits(n))
        else:
            undo.append((kind, 0, None, across))
    pixels = yield _Head(bits, across, height, True)
    return _undone(pixels, undo, height)


def _undone(pixels: np.ndarray, undo: list[tuple], height: int) -> np.ndarray:
    """Pixels with the transforms inverted, the last one first."""
    for kind, tile, image, wide in reversed(undo):
        if kind == _PALETTE:
            pixels = _unbundled(pixels, image, wide)
            continue
        planes = _planes(pixels)
        if kind == _SUBTRACT_GREEN:
            planes[1] += planes[2]
            planes[3] += planes[2]
        elif kind == _CROSS_COLOUR:
            planes = _with_cross_colour(planes, image, tile, 1)
        else:
            planes = _with_prediction(planes, image >> 8 & 15, tile, 1)
        pixels = _pixels(planes)
    return pixels


# -------------------------------------------------------------------- encoding


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, their number) of lengths or distances."""
    value = values - 1
    high = np.maximum(np.frexp(value.astype(np.float64))[1] - 1, 1).astype(np.int64)
    small = value < 4
    symbol = np.where(small, value, 2 * high + (value >> (high - 1) & 1))
    return symbol, np.where(small, 0, value & ((1 << (high - 1)) - 1)), np.where(small, 0, high - 1)


@lru_cache(64)
def _near_codes(width: int) -> np.ndarray:
    """The code of each short distance, 0 where it has none."""
    codes = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(_near())))}
    out = np.zeros(max(codes) + 1, np.int64)
    out[list(codes)] = list(codes.values())
    return out


def _same_before(keys: np.ndarray, bits: int) -> np.ndarray:
    """For each place the last place before it with the same key of ``bits`` bits, or -1.

    Keys too wide to stand beside their places in 64 bits lose their low bits.
    """
    n = len(keys)
    room = max(1, (n - 1).bit_length())
    if bits + room > 64:
        keys = keys >> np.uint64(bits + room - 64)
    packed = keys << np.uint64(room) | np.arange(n, dtype=np.uint64)
    packed.sort()
    place = (packed & np.uint64((1 << room) - 1)).astype(np.int64)
    key = packed >> np.uint64(room)
    same = np.flatnonzero(key[1:] == key[:-1])
    out = np.full(n, -1, np.int64)
    out[place[same + 1]] = place[same]
    return out


def _copies(flat: np.ndarray, owner: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, distance codes) of runs of SHORTEST pixels or more that stood before in their image.

    Every place knows the last place before it with the same four pixels; neighbours
    at one distance make a run, and a run begins where the one before it ends.
    """
    none = np.zeros(0, np.int64)
    if len(flat) < SHORTEST:
        return none, none, none
    x = flat.astype(np.uint64)
    key = owner[SHORTEST - 1 :].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        key += x[k : len(x) - SHORTEST + 1 + k] * np.uint64(factor)
    before = _same_before(key, 64)
    at = np.flatnonzero((before >= 0) & (owner[SHORTEST - 1 :] == owner[: 1 - SHORTEST]))
    source = before[at]
    equal = owner[at] == owner[source]
    for k in range(SHORTEST):
        equal &= flat[at + k] == flat[source + k]
    at, away = at[equal], (at - source)[equal]
    if not len(at):
        return none, none, none
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (np.diff(away) != 0) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(fresh)
    stop = at[np.append(first[1:], len(at)) - 1] + SHORTEST
    place, away = np.maximum(at[first], np.concatenate([[0], stop[:-1]])), away[first]
    enough = stop - place >= SHORTEST
    place, stop, away = place[enough], stop[enough], away[enough]
    pieces = -(-(stop - place) // LONGEST)
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place, stop, away = np.repeat(place, pieces) + turn * LONGEST, np.repeat(stop, pieces), np.repeat(away, pieces)
    code = away + 120
    own = widths[owner[place]]
    for width in np.unique(own):
        near = _near_codes(int(width))
        some = np.flatnonzero((own == width) & (away < len(near)))
        close = near[away[some]]
        code[some[close > 0]] = close[close > 0]
    return place, np.minimum(stop - place, LONGEST), code


def _put_entropy_images(outs: list[BitWriter], images: list[np.ndarray], main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """Writes an entropy image to each stream; items of all images are made together."""
    n = len(images)
    flat = np.concatenate([np.ascontiguousarray(x, np.uint32).ravel() for x in images])
    owner = np.repeat(np.arange(n), [x.size for x in images])
    place, length, away = _copies(flat, owner, np.array([x.shape[1] for x in images])) if references else (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[place] += 1
    edge[place + length] -= 1
    kept = edge[:-1].cumsum() == 0
    kept[place] = True
    at = np.flatnonzero(kept)  # where an item starts
    copy = np.searchsorted(at, place)
    own = owner[at]
    # The fields of an item: symbol, red, blue and alpha, or length, extra, distance and extra.
    change = int(np.bitwise_or.reduce(flat ^ flat[0]))
    fields = [(flat >> np.uint32(place) & np.uint32(255)).astype(np.int64) if change >> place & 255 else None for place in (8, 16, 0, 24)]
    alike = [int(flat[0]) >> place & 255 for place in (8, 16, 0, 24)]
    kinds = np.full(len(at), alike[0]) if fields[0] is None else fields[0][at]
    is_pixel = np.ones(len(at), bool)
    is_pixel[copy] = False
    if cache_bits:
        slot = (flat * np.uint32(_CACHE_MULTIPLIER) >> np.uint32(32 - cache_bits)).astype(np.int64)
        before = _same_before((owner << cache_bits | slot).astype(np.uint64), (n << cache_bits).bit_length())
        hit = is_pixel & (before[at] >= 0) & (flat[before[at]] == flat[at])
        is_pixel &= ~hit
        kinds[hit] = 280 + slot[at[hit]]
    long, long_extra, long_bits = _prefixes(length)
    far, far_extra, far_bits = _prefixes(away)
    kinds[copy] = 256 + long
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    pixel = np.flatnonzero(is_pixel)
    symbol = own * sizes[0] + kinds
    rest = [(own[pixel], alike[k] if fields[k] is None else fields[k][at[pixel]]) for k in (1, 2, 3)] + [(own[copy], far)]
    places = [symbol, *(whose * size + x for (whose, x), size in zip(rest, sizes[1:]))]
    counts = [np.bincount(x, minlength=n * size).reshape(n, size) for x, size in zip(places, sizes)]
    used = [np.where(c.any(1), c.shape[1] - (c[:, ::-1] > 0).argmax(1), 0).tolist() for c in counts]
    widths = [np.zeros((n, size), np.int64) for size in sizes]
    for i, out in enumerate(outs):
        out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
        if main:
            out.put(0, 1)
        for k in range(5):
            value, size, lengths = _code_of(counts[k][i, : used[k][i]].tobytes())
            out.put(value, size)
            if lengths is not None:
                widths[k][i, : len(lengths)] = lengths
    codes = [_canonical_rows(x) for x in widths]
    # What an item writes: one number, or four where its other fields take bits.
    entries = np.ones(len(at), np.int64)
    entries[copy] = 4
    told = [k for k in (1, 2, 3) if widths[k].any()]
    if told:
        entries[pixel] = 4
    spot = np.cumsum(entries) - entries
    bits, wide = np.zeros((2, int(entries.sum())), np.int64)
    both = (codes[0] << 4 | widths[0]).ravel()[symbol]
    bits[spot], wide[spot] = both >> 4, both & 15
    for k in told:
        bits[spot[pixel] + k], wide[spot[pixel] + k] = codes[k][rest[k - 1]], widths[k][rest[k - 1]]
    for k, (x, n_bits) in enumerate(((long_extra, long_bits), (codes[4][own[copy], far], widths[4][own[copy], far]), (far_extra, far_bits)), 1):
        bits[spot[copy] + k], wide[spot[copy] + k] = x, n_bits
    _put_many(outs, np.repeat(own, entries), bits, wide)


def _file(body: bytes) -> bytes:
    size = len(body)
    return b"RIFF" + struct.pack("<I", 12 + size + (size & 1)) + b"WEBPVP8L" + struct.pack("<I", size) + body + b"\0" * (size & 1)


def _header(out: BitWriter, width: int, height: int, alpha: bool) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side of 1 to 16384 pixels is needed")
    out.put(_SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)


def encode(
    pixels: np.ndarray,
    predictor: np.ndarray | None = None,
    cross_colour: np.ndarray | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    tile_bits: int = 2,
    cache_bits: int = 0,
    references: bool = True,
) -> bytes:
    """A lossless WebP file of (height, width) ARGB pixels.

    ``predictor`` holds a mode (0 to 13) and ``cross_colour`` an element for each tile
    of 2**tile_bits pixels.  A palette takes at most 256 colours.
    """
    own = [None if image is None else [image] for image in (predictor, cross_colour)]
    return encode_many([pixels], own[0], own[1], subtract_green, palette, tile_bits, cache_bits, references)[0]


def encode_many(
    images: list[np.ndarray],
    predictors: list[np.ndarray] | None = None,
    cross_colours: list[np.ndarray] | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    tile_bits: int = 2,
    cache_bits: int = 0,
    references: bool = True,
) -> list[bytes]:
    """Files of many images with the same transforms, as ``encode`` makes each."""
    images = [np.asarray(x, np.uint32) for x in images]
    outs = [BitWriter() for _ in images]
    for out, x in zip(outs, images):
        _header(out, x.shape[1], x.shape[0], bool((x >> 24 != 255).any()))
    if palette:
        colours, indexes = _palettes(images)
        if max(map(len, colours)) > 256:
            raise ValueError("more than 256 colours")
        for out, own in zip(outs, colours):
            out.put(1 | _PALETTE << 1 | (len(own) - 1) << 3, 11)
        _put_entropy_images(outs, [_steps(own) for own in colours], False)
        images = [_bundled(index.reshape(x.shape), len(own)) for x, index, own in zip(images, indexes, colours)]
    if predictors is not None or cross_colours is not None or subtract_green:
        planes = [_planes(x) for x in images]
        for kind, tiles in ((_PREDICTOR, predictors), (_CROSS_COLOUR, cross_colours)):
            if tiles is None:
                continue
            for out in outs:
                out.put(1 | kind << 1 | (tile_bits - 2) << 3, 6)
            if kind == _PREDICTOR:
                planes = [_with_prediction(x, t, tile_bits, -1) for x, t in zip(planes, tiles)]
                tiles = [np.uint32(_BLACK) | np.asarray(t, np.uint32) << np.uint32(8) for t in tiles]
            else:
                planes = [_with_cross_colour(x, np.asarray(t, np.uint32), tile_bits, -1) for x, t in zip(planes, tiles)]
            _put_entropy_images(outs, [np.asarray(t, np.uint32) for t in tiles], False)
        if subtract_green:
            for out in outs:
                out.put(1 | _SUBTRACT_GREEN << 1, 3)
            planes = [np.stack([x[0], x[1] - x[2], x[2], x[3] - x[2]]) for x in planes]
        images = [_pixels(x) for x in planes]
    for out in outs:
        out.put(0, 1)
    _put_entropy_images(outs, images, True, cache_bits, references)
    return [_file(out.take()) for out in outs]


def _palettes(images: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each image's colours in increasing order, and its pixels' places among them."""
    flat = np.concatenate([x.ravel() for x in images])
    if ((flat ^ flat[0]) & np.uint32(0xFFFF00FF)).any():
        colours = [np.unique(x) for x in images]
        return colours, [np.searchsorted(own, x.ravel()) for own, x in zip(colours, images)]
    # Only greens differ: a table of 256 for each image.
    sizes = [x.size for x in images]
    spot = np.repeat(np.arange(len(images)) << 8, sizes) | (flat >> np.uint32(8) & np.uint32(255))
    here = np.bincount(spot, minlength=len(images) << 8).reshape(-1, 256) > 0
    rank = (here.cumsum(1) - 1).ravel()
    rest = flat[0] & np.uint32(0xFFFF00FF)
    return [rest | np.flatnonzero(x).astype(np.uint32) << np.uint32(8) for x in here], np.split(rank[spot], np.cumsum(sizes)[:-1])


def _steps(colours: np.ndarray) -> np.ndarray:
    """A palette as an image of one row: each channel less that of the colour before."""
    channels = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.uint8)).view("<u4").reshape(1, -1)


def _bundled(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette numbers as pixels, several in one where there are few colours."""
    wide = _bundle_bits(colours)
    if not wide:
        return np.uint32(_BLACK) | index.astype(np.uint32) << np.uint32(8)
    height, width = index.shape
    across = _divided(width, wide)
    full = np.zeros((height, across << wide), np.int64)
    full[:, :width] = index
    packed = (full.reshape(height, across, 1 << wide) << (np.arange(1 << wide) * (8 >> wide))).sum(2)
    return np.uint32(_BLACK) | packed.astype(np.uint32) << np.uint32(8)


# ---------------------------------------------------------- texts as green images


def _sides(n: int) -> tuple[int, int]:
    """Width and height for n samples, n a multiple of ROW.

    If no rectangle holds just n, the last row has spare samples.
    """
    widths = range(ROW, MAX_SIDE + 1, ROW)
    for width in widths:
        if n // width <= MAX_SIDE and not n % width:
            return width, n // width
    width = next((w for w in widths if n <= w * MAX_SIDE), widths[-1])
    return width, -(-n // width)


def _strips(payload: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[int]]:
    """Samples of all images, where each starts, its sides, and how many images each run takes."""
    sides, counts, parts = [], [], []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        width, height = _sides(b - a)
        parts.append(payload[a:b])
        if spare := width * height - (b - a):
            parts.append(np.full(spare, 255, np.uint8))
        own = [(width, min(STRIP_ROWS, height - y)) for y in range(0, height, STRIP_ROWS)]
        sides += own
        counts.append(len(own))
    sizes = np.array([w * h for w, h in sides], np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), sides, counts


def write_samples(payload: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Files of green images, one behind the other, for each run ``payload[at[i]:at[i+1]]``, a positive multiple of ROW long.

    A run has a file for each STRIP_ROWS rows.
    """
    if len(at) < 2:
        return []
    payload, at, sides, counts = _strips(payload, at)
    images = [payload[a:b].reshape(height, width) for a, b, (width, height) in zip(at, at[1:], sides)]
    edges = np.flatnonzero(np.diff(at[:-1] // GROUP_SAMPLES, prepend=-1)).tolist()
    groups = ([x.astype(np.uint32) << np.uint32(8) | np.uint32(_BLACK) for x in images[a:b]] for a, b in zip(edges, [*edges[1:], len(images)]))
    files = (file for group in groups for file in encode_many(group, palette=True, cache_bits=CACHE_BITS))
    return [b"".join(islice(files, k)) for k in counts]


def _split(data: bytes) -> list[bytes]:
    """The files that stand one behind the other."""
    out, at = [], 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at : at + size])
        at += size
    return out


def read_samples(media: list[bytes], sizes: list[int]) -> list[bytes]:
    """The first ``sizes[i]`` samples of the green channel of the i-th run's files."""
    split = [_split(data) for data in media]
    found = ((pixels >> 8).astype(np.uint8).tobytes() for pixels in decode_many([file for files in split for file in files]))
    return [b"".join(islice(found, len(files)))[:n] for files, n in zip(split, sizes)]


def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run with bytes 255 up to a positive multiple of ROW."""
    sizes = np.diff(at)
    full = np.maximum(1, -(-sizes // ROW)) * ROW
    ends = np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[np.repeat(ends[:-1] - at[:-1], sizes) + np.arange(len(raw))] = raw
    return out, ends


def feature(samples: bytes) -> str:
    """Width, height, and of the samples: mean, deviation, distinct values, entropy in bits, mean step to the right."""
    width, height = _sides(len(samples))
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    mean = float((counts * np.arange(256)).sum()) / len(x)
    spread = (float((counts * np.arange(256) ** 2).sum()) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"{width}x{height};{mean:.3f};{spread:.3f};{len(share)};{-(share * np.log2(share)).sum():.3f};{step:.3f}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """Each whole text as a lossless WebP image, with digests of what is read back.

    Returns the key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, ``with_media``, the file.  Null and empty texts are one
    row of bytes 255.  A payload that fills no rectangle of whole rows has spare samples
    of 255 behind it in the image, which are not read back; above STRIP_ROWS rows the
    media are several files, one behind the other.  No shuffle; equal texts give equal values.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    tail = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rebatched(batches, most=BATCH_BYTES):
            raw, at = utf8(part.column("text"))
            full, ends = padded(raw, at)
            files = write_samples(full, ends)
            back = read_samples(files, np.diff(ends).tolist())
            columns = [
                part.column("key"),
                pa.array(np.diff(at), pa.int64()),
                pa.array([len(x) for x in back], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                pa.array([feature(x) for x in back]),
            ]
            names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if with_media:
                columns.append(pa.array(files, pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"`{key}` {kind}, {tail}" + ", media binary" * with_media)
