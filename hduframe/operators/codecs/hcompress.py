"""HCOMPRESS_1 decoding: a 2-D Haar-like transform whose coefficients are coded as quadtrees of bit planes.

The stream holds, for each quadrant of the coefficients and each bit plane, a tree of 4-bit nodes (each says which of its four
parts hold ones), as Huffman codes or plainly; then the signs.  The inverse transform doubles the resolution level by level; all
butterflies of a level are done at once.  Images of 8 and 16 bits are computed in 32 bits, which wrap.

A node's place in the stream depends on the nodes before it, so a tile is read node by node; many tiles of one shape are read side by
side, the next node of all of them at once.
"""

from __future__ import annotations

import numpy as np

from ...errors import CompressionError, UnsupportedCompression

MAGIC = b"\xdd\x99"
#: Fixed codes of the nodes' values: code by length.
HUFFMAN = {
    3: {0b000: 1, 0b001: 2, 0b010: 4, 0b011: 8},
    4: {0b1000: 3, 0b1001: 5, 0b1010: 10, 0b1011: 12, 0b1100: 15},
    5: {0b11010: 6, 0b11011: 7, 0b11100: 9, 0b11101: 11, 0b11110: 13},
    6: {0b111110: 0, 0b111111: 14},
}


def levels(n: int) -> int:
    """The least k with 2**k >= n."""
    return max(0, n - 1).bit_length()


def _windows() -> tuple[np.ndarray, np.ndarray]:
    """For each six bits the node that they begin with and the bits of its code; the codes cover all of them."""
    value, length = np.zeros(64, np.uint8), np.zeros(64, np.int32)
    for size, table in HUFFMAN.items():
        for code, node in table.items():
            first = code << (6 - size)
            value[first : first + (1 << (6 - size))], length[first : first + (1 << (6 - size))] = node, size
    return value, length


_VALUE, _LENGTH = _windows()


class Stream:
    """Bits, and for each of them the node whose code would begin there and where the next one would."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        self.at = 0
        padded = np.append(self.bits, np.zeros(6, np.uint8))
        six = np.zeros(len(self.bits), np.uint8)
        for k in range(6):
            six |= padded[k : k + len(self.bits)] << np.uint8(5 - k)
        self.value = _VALUE[six].tobytes()
        self.next = memoryview((np.arange(len(six)) + _LENGTH[six]).astype(np.int64))

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise CompressionError("an HCOMPRESS_1 tile ends too early")
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def nybbles(self, n: int) -> np.ndarray:
        if self.at + 4 * n > len(self.bits):
            raise CompressionError("an HCOMPRESS_1 tile ends too early")
        four = self.bits[self.at : self.at + 4 * n].reshape(n, 4)
        self.at += 4 * n
        return (four @ np.array([8, 4, 2, 1], np.uint8)).astype(np.int64)

    def nodes(self, n: int) -> np.ndarray:
        out, at, value, following = bytearray(n), self.at, self.value, self.next
        try:
            for k in range(n):
                out[k] = value[at]
                at = following[at]
        except IndexError as e:
            raise CompressionError("an HCOMPRESS_1 tile ends too early") from e
        if at > len(self.bits):
            raise CompressionError("an HCOMPRESS_1 tile ends too early")
        self.at = at
        return np.frombuffer(bytes(out), np.uint8)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def spread(nodes: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Nodes to their four parts, without those beyond the edge; here and below the last two axes are a tile's."""
    *many, x, y = nodes.shape
    out = np.zeros((*many, 2 * x, 2 * y), np.int64)
    out[..., 0::2, 0::2], out[..., 0::2, 1::2] = nodes >> 3 & 1, nodes >> 2 & 1
    out[..., 1::2, 0::2], out[..., 1::2, 1::2] = nodes >> 1 & 1, nodes & 1
    return out[..., :nx, :ny]


def sizes(n: int) -> list[int]:
    """Sides of the levels from 1 up to n: at each, half of the next, rounded up."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def tree_sides(nx: int, ny: int) -> list[tuple[int, int]]:
    """Sides of a quadrant's levels, the shorter side padded with ones at the top."""
    a, b = sizes(nx), sizes(ny)
    depth = max(len(a), len(b))
    a, b = [1] * (depth - len(a)) + a, [1] * (depth - len(b)) + b
    return list(zip(a, b, strict=True))


def quadrant(s: Stream, nx: int, ny: int, planes: int) -> np.ndarray:
    out = np.zeros((nx, ny), np.int64)
    if not nx or not ny:
        return out
    half = ((nx + 1) // 2, (ny + 1) // 2)
    sides = tree_sides(nx, ny)
    for plane in range(planes - 1, -1, -1):
        kind = int(s.nybbles(1)[0])
        if kind == 0:
            nodes = s.nybbles(half[0] * half[1]).reshape(half)
        elif kind == 0xF:
            nodes = s.nodes(1).astype(np.int64).reshape(1, 1)
            for x, y in sides[1:-1]:
                nodes = spread(nodes, x, y).reshape(-1)
                there = np.flatnonzero(nodes)[::-1]
                nodes[there] = s.nodes(len(there))
                nodes = nodes.reshape(x, y)
        else:
            raise CompressionError(f"bit plane format {kind} of HCOMPRESS_1")
        out |= spread(nodes, nx, ny) << plane
    return out


HEAD = np.dtype([("magic", "S2"), ("nx", ">i4"), ("ny", ">i4"), ("scale", ">i4"), ("total", ">i8"), ("planes", "u1", 3)])


def heads(raws: list[bytes], sizes: list[int]) -> np.ndarray:
    """What streams begin with; sizes: the pixels that each must have."""
    if any(len(r) < HEAD.itemsize for r in raws):
        raise CompressionError("no HCOMPRESS_1 stream")
    h = np.frombuffer(b"".join(r[: HEAD.itemsize] for r in raws), HEAD)
    nx, ny = h["nx"].astype(np.int64), h["ny"].astype(np.int64)
    if (h["magic"] != MAGIC).any():
        raise CompressionError("no HCOMPRESS_1 stream")
    if (nx < 1).any() or (ny < 1).any():
        raise CompressionError("an HCOMPRESS_1 image without pixels")
    if ((nx == 1) & (ny == 1)).any():
        raise UnsupportedCompression("an HCOMPRESS_1 image of one pixel")
    if (wrong := np.flatnonzero(nx * ny != np.array(sizes))).size:
        raise CompressionError(f"an HCOMPRESS_1 tile of {(nx * ny)[wrong[0]]} pixels for {sizes[wrong[0]]}")
    return h


def coefficients(raw: bytes, head: np.void) -> np.ndarray:
    """Coefficients as they are stored."""
    nx, ny, total, planes = int(head["nx"]), int(head["ny"]), int(head["total"]), head["planes"].tolist()
    s = Stream(raw[HEAD.itemsize :])
    x, y = (nx + 1) // 2, (ny + 1) // 2
    out = np.zeros((nx, ny), np.int64)
    out[:x, :y] = quadrant(s, x, y, planes[0])
    out[:x, y:] = quadrant(s, x, ny - y, planes[1])
    out[x:, :y] = quadrant(s, nx - x, y, planes[1])
    out[x:, y:] = quadrant(s, nx - x, ny - y, planes[2])
    if s.nybbles(1)[0]:
        raise CompressionError("no end mark in an HCOMPRESS_1 stream")
    s.align()
    some = np.flatnonzero(out)
    if s.at + len(some) > len(s.bits):
        raise CompressionError("an HCOMPRESS_1 tile ends too early")
    sign = s.bits[s.at : s.at + len(some)].astype(bool)
    flat = out.reshape(-1)
    flat[some[sign]] *= -1
    flat[0] = total
    return out


class Streams:
    """The bits of some streams one behind the other, and where the next node of each begins."""

    def __init__(self, raws: list[bytes], room: int):
        """room: the most bits that are read between two looks at the streams' ends."""
        self.bits = np.unpackbits(np.frombuffer(b"".join(raws) + bytes(-(-room // 8) + 1), np.uint8))
        size = 8 * np.array([len(r) for r in raws], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.at = self.begin.copy()
        self.six = np.zeros(len(self.bits), np.uint8)
        for k in range(6):
            self.six[: len(self.bits) - k] |= self.bits[k:] << np.uint8(5 - k)

    def check(self) -> None:
        if (self.at > self.end).any():
            raise CompressionError("an HCOMPRESS_1 tile ends too early")

    def nybbles(self, of: np.ndarray, n: int) -> np.ndarray:
        """n numbers of four bits of each of these streams."""
        four = self.six[self.at[of, None] + 4 * np.arange(n)] >> np.uint8(2)
        self.at[of] += 4 * n
        self.check()
        return four.astype(np.int64)

    def node(self, of: np.ndarray) -> np.ndarray:
        six = self.six[self.at[of]]
        self.at[of] += _LENGTH[six]
        return _VALUE[six]


def quadrants(s: Streams, nx: int, ny: int, planes: np.ndarray) -> np.ndarray:
    """One quadrant of all streams."""
    out = np.zeros((len(planes), nx, ny), np.int64)
    if not nx or not ny:
        return out
    half = ((nx + 1) // 2, (ny + 1) // 2)
    sides = tree_sides(nx, ny)
    for plane in range(int(planes.max()) - 1, -1, -1):
        of = np.flatnonzero(planes > plane)
        kind = s.nybbles(of, 1)[:, 0]
        if (odd := (kind != 0) & (kind != 0xF)).any():
            raise CompressionError(f"bit plane format {kind[odd][0]} of HCOMPRESS_1")
        if len(plain := of[kind == 0]):
            out[plain] |= spread(s.nybbles(plain, half[0] * half[1]).reshape(-1, *half), nx, ny) << plane
        if len(coded := of[kind == 0xF]):
            nodes = s.node(coded).astype(np.int64).reshape(-1, 1, 1)
            for x, y in sides[1:-1]:
                nodes = spread(nodes, x, y).reshape(len(coded), -1)
                for k in range(x * y - 1, -1, -1):
                    there = np.flatnonzero(nodes[:, k])
                    nodes[there, k] = s.node(coded[there])
                nodes = nodes.reshape(-1, x, y)
                s.check()
            out[coded] |= spread(nodes, nx, ny) << plane
    return out


def coefficients_of(raws: list[bytes], head: np.ndarray) -> np.ndarray:
    """The same of streams of one shape, side by side."""
    nx, ny = int(head["nx"][0]), int(head["ny"][0])
    x, y = (nx + 1) // 2, (ny + 1) // 2
    s, planes = Streams([r[HEAD.itemsize :] for r in raws], 6 * nx * ny + 64), head["planes"].astype(np.int64)
    out = np.zeros((len(raws), nx, ny), np.int64)
    out[:, :x, :y] = quadrants(s, x, y, planes[:, 0])
    out[:, :x, y:] = quadrants(s, x, ny - y, planes[:, 1])
    out[:, x:, :y] = quadrants(s, nx - x, y, planes[:, 1])
    out[:, x:, y:] = quadrants(s, nx - x, ny - y, planes[:, 2])
    if s.nybbles(np.arange(len(raws)), 1).any():
        raise CompressionError("no end mark in an HCOMPRESS_1 stream")
    s.at = s.begin + -(-(s.at - s.begin) // 8) * 8
    flat = out.reshape(len(raws), -1)
    tile, place = np.nonzero(flat)
    n = np.bincount(tile, minlength=len(raws))
    sign = s.at[tile] + np.arange(len(tile)) - (np.cumsum(n) - n)[tile]
    s.at += n
    s.check()
    minus = s.bits[sign].astype(bool)
    flat[tile[minus], place[minus]] *= -1
    flat[:, 0] = head["total"]
    return out


def rounded(v: np.ndarray, bit: int, last: bool = False) -> np.ndarray:
    """To a multiple of bit, halves away from 0 upwards and towards 0 downwards."""
    up = bit >> 1
    return (v + np.where(v >= 0, up, 0 if last else up - 1)) & -bit


def interleave(a: np.ndarray) -> np.ndarray:
    """On both axes: the first half to even places, the rest to odd ones."""
    out = np.empty_like(a)
    x, y = (a.shape[-2] + 1) // 2, (a.shape[-1] + 1) // 2
    out[..., 0::2, 0::2], out[..., 0::2, 1::2] = a[..., :x, :y], a[..., :x, y:]
    out[..., 1::2, 0::2], out[..., 1::2, 1::2] = a[..., x:, :y], a[..., x:, y:]
    return out


def inverse(a: np.ndarray, kind: type) -> np.ndarray:
    nx, ny = a.shape[-2:]
    a = a.astype(kind)
    depth = levels(max(nx, ny))
    bit = kind(1 << (depth - 1)).item() if depth else 1
    a[..., 0, 0] = rounded(a[..., 0, 0], bit << 2)
    for k, (x, y) in enumerate(tree_sides(nx, ny)[1:]):
        last = k == depth - 1
        shift = 2 if last else 1
        part = interleave(a[..., :x, :y])
        ex, ey = x - x % 2, y - y % 2
        h0, hy = part[..., 0:ex:2, 0:ey:2].copy(), part[..., 0:ex:2, 1:ey:2].copy()
        hx, hc = part[..., 1:ex:2, 0:ey:2].copy(), part[..., 1:ex:2, 1:ey:2].copy()
        hx, hy, hc = rounded(hx, bit << 1), rounded(hy, bit << 1), rounded(hc, bit, last)
        low = hc & bit
        hx, hy = hx - np.where(hx >= 0, low, -low), hy - np.where(hy >= 0, low, -low)
        odd = (hc ^ hx ^ hy) & (bit << 1)
        h0 = h0 + np.where(h0 >= 0, low - odd, np.where(low == 0, odd, low - odd))
        part[..., 1:ex:2, 1:ey:2], part[..., 1:ex:2, 0:ey:2] = (h0 + hx + hy + hc) >> shift, (h0 + hx - hy - hc) >> shift
        part[..., 0:ex:2, 1:ey:2], part[..., 0:ex:2, 0:ey:2] = (h0 - hx + hy - hc) >> shift, (h0 - hx - hy + hc) >> shift
        for edge, axis in ((y % 2 and ex, 1), (x % 2 and ey, 0)):  # a last column, a last row
            if edge:
                line = part[..., :ex, -1] if axis else part[..., -1, :ey]
                h, g = line[..., 0::2].copy(), rounded(line[..., 1::2], bit << 1)
                odd = g & (bit << 1)
                h = h + np.where(h >= 0, -odd, odd)
                line[..., 0::2], line[..., 1::2] = (h - g) >> shift, (h + g) >> shift
        if x % 2 and y % 2:
            part[..., -1, -1] >>= shift
        a[..., :x, :y] = part
        bit >>= 1
    return a


#: So many tiles of one shape are read side by side at least, and up to so many pixels at a time.
SIDE_BY_SIDE, TOGETHER = 16, 1 << 18


def decode_many(raws: list[bytes], sizes: list[int], bits: int, smooth: int = 0) -> list[np.ndarray]:
    """The pixels of tiles with so many pixels each; bits: of the image's integers."""
    if smooth:
        raise UnsupportedCompression("HCOMPRESS_1 with SMOOTH")
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raws)
    if not raws:
        return out
    head, kind = heads(raws, sizes), np.int32 if bits in (8, 16) else np.int64
    _, shape = np.unique(np.stack([head["nx"], head["ny"]], 1), axis=0, return_inverse=True)
    for k in range(int(shape.max()) + 1):
        same = np.flatnonzero(shape.reshape(-1) == k)
        most = max(1, TOGETHER // sizes[same[0]])
        for at in range(0, len(same), most):
            of = same[at : at + most].tolist()
            if len(of) >= SIDE_BY_SIDE:
                a = coefficients_of([raws[i] for i in of], head[of])
            else:
                a = np.stack([coefficients(raws[i], head[i]) for i in of])
            scale = head["scale"][of].astype(np.int64)
            with np.errstate(over="ignore"):
                a = a * np.where(scale > 1, scale, 1)[:, None, None]
                flat = inverse(a, kind).astype(np.int64).reshape(len(of), -1)
            for i, v in zip(of, flat, strict=True):
                out[i] = v
    return out


def decode(raw: bytes, n: int, bits: int, smooth: int = 0) -> np.ndarray:
    """The n pixels of one tile."""
    return decode_many([raw], [n], bits, smooth)[0]
