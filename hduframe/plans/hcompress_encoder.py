"""Forward transform and a plain encoder of HCOMPRESS_1, for queries and tests of the decoder: the package writes no such files.

Tiles of one shape are encoded side by side; the last two axes are a tile's."""

from __future__ import annotations

import numpy as np

from ..operators.codecs import hcompress as hc

CODES = np.array([next(c for t in hc.HUFFMAN.values() for c, v in t.items() if v == node) for node in range(16)])
SIZES = np.array([next(n for n, t in hc.HUFFMAN.items() for v in t.values() if v == node) for node in range(16)])


def forward(img: np.ndarray) -> np.ndarray:
    """Sums and differences of two by two, level by level; bits that can be told from others are dropped."""
    nx, ny = img.shape[-2:]
    a = img.astype(np.int64).copy()
    depth = hc.levels(max(nx, ny))
    x, y, shift, prnd, prnd2 = nx, ny, 0, 1, 2
    for _ in range(depth):
        ex, ey = x - x % 2, y - y % 2
        p = a[..., :x, :y].copy()
        up = lambda v: np.where(v >= 0, v + prnd, v) & (-2 * prnd)
        top = lambda v: np.where(v >= 0, v + prnd2, v + prnd2 - 1) & (-2 * prnd2)
        a00, a01, a10, a11 = p[..., 0:ex:2, 0:ey:2], p[..., 0:ex:2, 1:ey:2], p[..., 1:ex:2, 0:ey:2], p[..., 1:ex:2, 1:ey:2]
        h0, hx, hy, hcc = (a11 + a10 + a01 + a00) >> shift, (a11 + a10 - a01 - a00) >> shift, (a11 - a10 + a01 - a00) >> shift, (a11 - a10 - a01 + a00) >> shift
        q = p.copy()
        q[..., 1:ex:2, 1:ey:2], q[..., 1:ex:2, 0:ey:2], q[..., 0:ex:2, 1:ey:2], q[..., 0:ex:2, 0:ey:2] = hcc, up(hx), up(hy), top(h0)
        if y % 2:
            u, v = p[..., 0:ex:2, -1], p[..., 1:ex:2, -1]
            q[..., 0:ex:2, -1], q[..., 1:ex:2, -1] = top((v + u) << (1 - shift)), up((v - u) << (1 - shift))
        if x % 2:
            u, v = p[..., -1, 0:ey:2], p[..., -1, 1:ey:2]
            q[..., -1, 0:ey:2], q[..., -1, 1:ey:2] = top((v + u) << (1 - shift)), up((v - u) << (1 - shift))
        if x % 2 and y % 2:
            q[..., -1, -1] = top(p[..., -1, -1] << (2 - shift))
        q = np.concatenate([q[..., 0::2, :], q[..., 1::2, :]], -2)
        q = np.concatenate([q[..., 0::2], q[..., 1::2]], -1)
        a[..., :x, :y] = q
        x, y = (x + 1) // 2, (y + 1) // 2
        shift, prnd, prnd2 = 1, prnd2, prnd2 * 2
    return a


def nodes_of(bits: np.ndarray) -> np.ndarray:
    *many, x, y = bits.shape
    p = np.zeros((*many, x + x % 2, y + y % 2), np.int64)
    p[..., :x, :y] = bits
    return p[..., 0::2, 0::2] * 8 + p[..., 0::2, 1::2] * 4 + p[..., 1::2, 0::2] * 2 + p[..., 1::2, 1::2]


def quadrant(m: np.ndarray, planes: np.ndarray, huffman: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For all tiles numbers, one behind the other, and the bits of each (0 where a tile has no such number)."""
    out = []
    n, nx, ny = m.shape
    if not nx or not ny:
        return out
    sides = hc.tree_sides(nx, ny)
    for plane in range(int(planes.max(initial=0)) - 1, -1, -1):
        has = (planes > plane)[:, None]
        level = nodes_of(m >> plane & 1)
        kind = np.full((n, 1), 15 if huffman else 0)
        out.append((kind, np.where(has, 4, 0)))
        if not huffman:
            flat = level.reshape(n, -1)
            out.append((flat, np.where(has, np.full(flat.shape, 4), 0)))
            continue
        tree = [level]
        for x, y in sides[1:-1][::-1]:
            assert tree[0].shape == (n, x, y)
            tree.insert(0, nodes_of((tree[0] != 0).astype(np.int64)))
        root = tree[0].reshape(n, -1)[:, :1]
        out.append((CODES[root], np.where(has, SIZES[root], 0)))
        for above, here in zip(tree[:-1], tree[1:], strict=True):
            there = hc.spread(above, *here.shape[1:]).reshape(n, -1)[:, ::-1] > 0
            flat = here.reshape(n, -1)[:, ::-1]
            out.append((CODES[flat], np.where(has & there, SIZES[flat], 0)))
    return out


def encode_many(img: np.ndarray, huffman: bool = True, scale: int = 0) -> list[bytes]:
    """The streams of tiles of one shape."""
    a = forward(img)
    if scale > 1:
        a = np.sign(a) * ((np.abs(a) + (scale >> 1)) // scale)
    n, nx, ny = a.shape
    m = np.abs(a)
    m[:, 0, 0] = 0
    x, y = (nx + 1) // 2, (ny + 1) // 2
    quads = [m[:, :x, :y], m[:, :x, y:], m[:, x:, :y], m[:, x:, y:]]
    top = np.array([[int(v).bit_length() for v in q.max((1, 2), initial=0).tolist()] for q in quads])
    planes = np.stack([top[0], np.maximum(top[1], top[2]), top[3]], 1)
    parts = [p for q, k in zip(quads, (0, 1, 1, 2), strict=True) for p in quadrant(q, planes[:, k], huffman)]
    parts.append((np.zeros((n, 1), np.int64), np.full((n, 1), 4)))
    used = sum(size.sum(1) for _, size in parts)
    parts.append((np.zeros((n, 1), np.int64), (-used % 8)[:, None]))
    signs = a.reshape(n, -1) < 0
    parts.append((signs.astype(np.int64), (m.reshape(n, -1) > 0).astype(np.int64)))
    parts.append((np.zeros((n, 1), np.int64), (-(m > 0).sum((1, 2)) % 8)[:, None]))
    value, size = (np.concatenate([p[k] for p in parts], 1) for k in (0, 1))
    some = size.reshape(-1) > 0
    value, bits = value.reshape(-1)[some], size.reshape(-1)[some]
    end = np.cumsum(bits)
    out = np.zeros(int(size.sum()), np.uint8)
    for b in range(int(bits.max())):
        has = bits > b
        out[end[has] - 1 - b] = value[has] >> b & 1
    packed, edge = np.packbits(out).tobytes(), np.cumsum(size.sum(1)) // 8
    head = np.zeros(n, hc.HEAD)
    head["magic"], head["nx"], head["ny"], head["scale"], head["total"], head["planes"] = hc.MAGIC, nx, ny, scale, a[:, 0, 0], planes
    return [h.tobytes() + packed[b:e] for h, b, e in zip(head, [0, *edge[:-1].tolist()], edge.tolist(), strict=True)]


def encode(img: np.ndarray, huffman: bool = True, scale: int = 0) -> bytes:
    return encode_many(img[None], huffman, scale)[0]
