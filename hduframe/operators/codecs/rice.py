"""RICE_1 for 8, 16 and 32 bits, over many tiles at once.

A tile starts with its first value, then come blocks of differences: a code for the number k of low bits, then for each
zig-zag mapped difference its high part in unary and k low bits.  Two codes are special: all differences are 0, and plain values.
Encoding places all bits of all tiles by prefix sums.  Decoding looks up where the next one lies behind each bit; taken as often as a
block has pixels, that leads from block to block in one step each, and then all blocks are decoded side by side.
"""

from __future__ import annotations

import numpy as np

from ...errors import CompressionError, UnsupportedCompression

#: Fixed values by bytes of a pixel: bits of the code for k, the largest k's code, bits of a value.
PARAMETERS = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}


def parameters(width: int) -> tuple[int, int, int]:
    if width not in PARAMETERS:
        raise UnsupportedCompression(f"RICE_1 with BYTEPIX {width}")
    return PARAMETERS[width]


def zigzag(d: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return (d << 1) ^ (d >> 63)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> 1) ^ -(u & 1)


def wrap(v: np.ndarray, bits: int) -> np.ndarray:
    """The low bits, as a signed number."""
    return (v << (64 - bits)) >> (64 - bits)


def parameter(total: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """For blocks of n mapped differences that add up to total: the smallest k with total >> k <= 2 n, or -1 if all are 0."""
    k = np.zeros(len(total), np.int64)
    for step in range(most):
        k += ((total >> k) > 2 * n) & (k == step)
    return np.where(total == 0, -1, np.minimum(k, most))


def encode(tiles: list[np.ndarray], width: int, block: int = 32) -> list[bytes]:
    code_bits, plain, bits = parameters(width)
    sizes = np.array([len(t) for t in tiles], np.int64)
    if not sizes.sum():
        return [b""] * len(tiles)
    v = np.concatenate([np.asarray(t, np.int64) for t in tiles])
    tile = np.repeat(np.arange(len(tiles)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(v)) - begin[tile]
    before = np.where(place == 0, v, np.roll(v, 1))
    u = zigzag(wrap(v - before, bits))
    per = -(-sizes // block)
    first_block = np.cumsum(per) - per
    owner = first_block[tile] + place // block
    n = np.bincount(owner, minlength=int(per.sum()))
    total = np.zeros(len(n), np.int64)
    np.add.at(total, owner, u)
    k = parameter(total, n, plain)
    mine = k[owner]
    coded = (mine >= 0) & (mine < plain)
    low = np.where(coded, mine, 0)
    high = np.where(coded, u >> low, 0)
    length = np.where(coded, high + 1 + low, np.where(mine >= plain, bits, 0))
    # each field is a number of so many bits behind ``gap`` zeros: seeds, block codes, differences
    head = np.flatnonzero(place == 0)
    start = np.flatnonzero(place % block == 0)
    field_bits = length.copy()
    field_bits[start] += code_bits
    field_bits[head] += bits
    end = np.cumsum(field_bits)
    tile_bits = np.bincount(tile, field_bits, len(tiles)).astype(np.int64)
    bytes_of = -(-tile_bits // 8)
    shift = 8 * (np.cumsum(bytes_of) - bytes_of) - (np.cumsum(tile_bits) - tile_bits)
    end += shift[tile]
    out = np.zeros(8 * int(bytes_of.sum()), np.uint8)

    def put(value: np.ndarray, to: np.ndarray, count: np.ndarray | int) -> None:
        """The low ``count`` bits of each value, so that the last lies before ``to``."""
        count = np.broadcast_to(count, value.shape)
        for b in range(int(count.max(initial=0))):
            some = count > b
            out[to[some] - 1 - b] = value[some] >> b & 1

    put(np.where(coded, (1 << low) | (u & ((1 << low) - 1)), u), end, np.where(coded, low + 1, length))
    put(np.where(k[owner[start]] >= plain, plain, np.maximum(k[owner[start]], -1)) + 1, end[start] - length[start], code_bits)
    put(v[head] & ((1 << bits) - 1), end[head] - length[head] - code_bits, bits)
    packed = np.packbits(out).tobytes()
    edge = np.cumsum(bytes_of)
    return [packed[e - b : e] for e, b in zip(edge.tolist(), bytes_of.tolist(), strict=True)]


WINDOW = 1 << 16  # bytes of tiles that are decoded together; longer tiles take as many windows as they need


class Window:
    """The bits of some tiles, with the place of the next one behind each bit, so that unary codes are looked up."""

    def __init__(self, raw: bytes, block: int):
        self.size, self.block = 8 * len(raw), block
        self.raw = raw + bytes(16)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        place = np.where(np.unpackbits(np.frombuffer(raw, np.uint8)) == 1, np.arange(self.size, dtype=np.int32), np.int32(self.size))
        self.next = np.append(np.minimum.accumulate(place[::-1])[::-1], np.int32(self.size))
        self.jumps: dict[int, memoryview] = {}

    def jump(self, k: int) -> memoryview:
        """For each bit, where a whole block of codes with k low bits that starts there ends; the window's end if beyond."""
        if k not in self.jumps:
            step = np.minimum(self.next.astype(np.int64) + 1 + k, self.size).astype(np.int32)
            whole, n = None, self.block
            while n:  # the step to the power of the block's size
                if n & 1:
                    whole = step if whole is None else step[whole]
                n >>= 1
                step = step[step] if n else step
            self.jumps[k] = memoryview(whole)
        return self.jumps[k]

    def top(self, at: np.ndarray) -> np.ndarray:
        """The next 56 bits at the top of 64."""
        eight = self.bytes[np.minimum(at >> 3, len(self.raw) - 8)[:, None] + np.arange(8)]
        return eight.view(">u8")[:, 0].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        """Numbers of count bits, 1 at least."""
        return (self.top(at) >> (np.uint64(64) - np.asarray(count, np.uint64))).astype(np.int64)

    def blocks(self, at: int, n: int, limit: int, last: bool, code_bits: int, plain: int, bits: int) -> tuple[list[int], list[int], int, int]:
        """Of a tile with n pixels left, whose codes go on at a bit: where each block's values begin and its number of low bits (-1: all
        are 0); then the pixels that remain and where.  Unless the tile ends in this window (last), only whole blocks that lie in it are taken."""
        raw, mask, size = self.raw, (1 << code_bits) - 1, self.block
        starts, ks = [], []
        while n > 0 and (last or n >= size):
            if at + code_bits > limit:
                if last:
                    raise CompressionError("a RICE_1 tile ends too early")
                break
            k = ((raw[at >> 3] << 8 | raw[(at >> 3) + 1]) >> (16 - code_bits - (at & 7)) & mask) - 1
            begin = at + code_bits
            if n < size:  # the last block; where it ends is seen when it is decoded
                end = begin
            elif k < 0:
                end = begin
            elif k >= plain:
                end = begin + size * bits
            else:
                end = (self.jumps.get(k) or self.jump(k))[begin]
            if not last and end >= limit:
                break
            starts.append(begin)
            ks.append(k)
            at, n = min(end, self.size), n - min(n, size)
        return starts, ks, n, at

    def values(self, start: np.ndarray, k: np.ndarray, n: np.ndarray, plain: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The mapped differences of blocks of n pixels, one block behind the other, and where each block ends."""
        out, at = np.zeros((len(start), self.block), np.int64), start.copy()
        coded = np.flatnonzero((k >= 0) & (k < plain))
        low = np.maximum(k, 0)
        for j in range(self.block):
            coded = coded[n[coded] > j]
            if not len(coded):
                break
            begin, kk = at[coded], low[coded]
            one = self.next[np.minimum(begin, self.size)].astype(np.int64)
            some = kk > 0
            rest = np.where(some, self.take(one + 1, np.maximum(kk, 1)), 0)
            out[coded, j] = (one - begin) << kk | rest
            at[coded] = one + 1 + kk
        raw = np.flatnonzero(k >= plain)
        for j in range(self.block):
            raw = raw[n[raw] > j]
            if not len(raw):
                break
            out[raw, j] = self.take(at[raw], bits)
            at[raw] += bits
        return out[np.arange(self.block) < n[:, None]], at


def _tiles(streams: list[bytes], n: list[int], width: int, block: int) -> np.ndarray:
    """The pixels of some whole tiles, one tile behind the other."""
    code_bits, plain, bits = parameters(width)
    w, begin = Window(b"".join(streams), block), 0
    starts, ks, counts, limits, first = [], [], [], [], []
    for stream, left in zip(streams, n, strict=True):
        limit = begin + 8 * len(stream)
        if begin + bits > limit:
            raise CompressionError("a RICE_1 tile ends too early")
        first.append(begin)
        a, k, _, _ = w.blocks(begin + bits, left, limit, True, code_bits, plain, bits)
        starts += a
        ks += k
        counts += [block] * (len(a) - 1) + [left - block * (len(a) - 1)]
        limits += [limit] * len(a)
        begin = limit
    u, end = w.values(np.array(starts), np.array(ks), np.array(counts), plain, bits)
    if (end > np.array(limits)).any():
        raise CompressionError("a RICE_1 tile ends too early")
    return _sums(u, w.take(np.array(first), bits), np.array(n))


def _sums(u: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pixels from mapped differences, of tiles of n pixels and their first values."""
    total = np.cumsum(unzigzag(u))
    begin = np.cumsum(n) - n
    return total + np.repeat(first - np.where(begin > 0, total[begin - 1], 0), n)


def _long_tile(stream: bytes, n: int, width: int, block: int) -> np.ndarray:
    """A tile of many windows."""
    code_bits, plain, bits = parameters(width)
    first = int.from_bytes(stream[: bits // 8], "big")
    at, left, size, parts = bits, n, WINDOW, []
    while left:
        skip = at >> 3
        raw = stream[skip : skip + size]
        last = skip + size >= len(stream)
        w = Window(raw, block)
        starts, ks, rest, after = w.blocks(at & 7, left, 8 * len(raw), last, code_bits, plain, bits)
        if starts:
            counts = np.full(len(starts), block)
            counts[-1] = min(block, left - block * (len(starts) - 1))
            u, end = w.values(np.array(starts), np.array(ks), counts, plain, bits)
            if (end > 8 * len(raw)).any():
                raise CompressionError("a RICE_1 tile ends too early")
            parts.append(u)
            size = WINDOW
        elif last:
            raise CompressionError("a RICE_1 tile ends too early")
        else:
            size *= 2  # a block longer than the window
        at, left = 8 * skip + after, rest
    return _sums(np.concatenate(parts), np.array([first]), np.array([n]))


def decode(streams: list[bytes], sizes: list[int], width: int, block: int = 32) -> list[np.ndarray]:
    """Signed pixels, unsigned for 8 bits, of each stream."""
    _, _, bits = parameters(width)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sizes)
    some = [k for k, n in enumerate(sizes) if n]
    if any(not streams[k] for k in some):
        raise CompressionError("a RICE_1 tile without data")
    group: list[int] = []
    held = 0

    def put(ids: list[int], flat: np.ndarray) -> None:
        flat = flat & 0xFF if width == 1 else wrap(flat, bits)
        end = 0
        for k in ids:
            end += sizes[k]
            out[k] = flat[end - sizes[k] : end]

    for k in [*some, -1]:
        if group and (k < 0 or held + len(streams[k]) > WINDOW):
            put(group, _tiles([streams[i] for i in group], [sizes[i] for i in group], width, block))
            group, held = [], 0
        if k >= 0 and len(streams[k]) > WINDOW:
            put([k], _long_tile(streams[k], sizes[k], width, block))
        elif k >= 0:
            group.append(k)
            held += len(streams[k])
    return out
