"""Floats as scaled integers, with or without subtractive dithering by the standard's fixed random numbers."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Fixed values of the standard: quantized NaN and exact 0 (the latter with SUBTRACTIVE_DITHER_2 only), number of random values.
NULL, ZERO, N_RANDOM = -2147483647, -2147483646, 10_000
NONE, DITHER_1, DITHER_2 = "NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"


@cache
def random_table() -> np.ndarray:
    """Park and Miller's generator from seed 1, as 32-bit floats."""
    out, seed = np.empty(N_RANDOM, np.float32), 1
    for k in range(N_RANDOM):
        seed = 16807 * seed % 2147483647
        out[k] = seed / 2147483647.0
    return out


def offsets(n: int, tile: int, seed: int) -> np.ndarray:
    """The random value of each of a tile's n pixels; tile counts from 0, seed is ZDITHER0."""
    table = random_table()
    at = (tile + seed - 1) % N_RANDOM
    parts, size = [], 0
    while size < n:
        start = int(np.float32(table[at]) * np.float32(500))
        parts.append(table[start : start + n - size])
        size += len(parts[-1])
        at = (at + 1) % N_RANDOM
    return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)


def offsets_many(n: int, tiles: np.ndarray, seed: int) -> np.ndarray:
    """The same of tiles of n pixels each, a row for each tile."""
    if n > N_RANDOM - 500:  # a row may go on with the next start
        return np.stack([offsets(n, t, seed) for t in tiles.tolist()]) if len(tiles) else np.empty((0, n))
    table = random_table()
    start = (table[(tiles + seed - 1) % N_RANDOM] * np.float32(500)).astype(np.int64)
    return table.astype(np.float64)[start[:, None] + np.arange(n)]


def _two_sum(a: np.ndarray, b: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """A sum and what its rounding left."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def multiply_add(x: np.ndarray, scale: np.ndarray | float, zero: np.ndarray | float) -> np.ndarray:
    """x * scale + zero, rounded once: Dekker's exact product, exact sums, and the few values that these can't settle one by one."""
    scale, zero = np.asarray(scale, np.float64), np.asarray(zero, np.float64)
    with np.errstate(all="ignore"):
        high = lambda v: (c := v * 134217729.0) - (c - v)  # noqa: E731  (Veltkamp's split)
        p = x * scale
        xh, sh = high(x), high(scale)
        xl, sl = x - xh, scale - sh
        e = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
        s, t = _two_sum(p, zero)
        w, w_left = _two_sum(t, e)
        r, r_left = _two_sum(s, w)
        # r is right unless the exact value lies beside a tie, or parts over- or underflow
        gap = np.spacing(np.abs(r))
        tie = (w_left != 0) & ((2 * np.abs(r_left) == gap) | (4 * np.abs(r_left) == gap))
        odd = tie | ~np.isfinite(r) | ((p != 0) & (np.abs(p) < 1e-280)) | (np.abs(p) > 1e290) | (np.abs(x) > 1e290)
        odd |= (np.abs(scale) > 1e290) | (0 < np.abs(scale)) & (np.abs(scale) < 1e-290) | ~np.isfinite(zero)
    scale, zero = np.broadcast_to(scale, x.shape), np.broadcast_to(zero, x.shape)
    for k in zip(*(i.tolist() for i in np.nonzero(odd)), strict=True):
        a, b, c = float(x[k]), float(scale[k]), float(zero[k])
        try:
            r[k] = math.fma(a, b, c)
        except (OverflowError, ValueError):
            r[k] = a * b + c
    return r


def unquantize(q: np.ndarray, scale: float, zero: float, method: str = NONE, tile: int = 0, seed: int = 1, blank: int | None = None) -> np.ndarray:
    """One rounding for q * scale + zero; with dithering q - r + 0.5 takes q's place."""
    return unquantize_many(q[None], np.array([scale]), np.array([zero]), method, np.array([tile]), seed, None if blank is None else np.array([blank]))[0]


def unquantize_many(q: np.ndarray, scale: np.ndarray, zero: np.ndarray, method: str, tiles: np.ndarray, seed: int, blank: np.ndarray | None = None) -> np.ndarray:
    """The same of tiles of one size, a row of q for each; blank: the number that stands for NaN in each."""
    x = q.astype(np.float64)
    if method != NONE:
        x = x - offsets_many(q.shape[1], tiles, seed) + 0.5
    out = multiply_add(x, scale[:, None], zero[:, None])
    if blank is not None:
        out[q == blank[:, None]] = np.nan
    if method == DITHER_2:
        out[q == ZERO] = 0.0
    return out


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from 0."""
    whole = np.trunc(x)
    return whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)


def scale_zero(v: np.ndarray, q: float = 4.0) -> tuple[float, float]:
    """Of the finite values: the range in 65536 q steps, and the mean."""
    v = v[np.isfinite(v)].astype(np.float64)
    if not len(v):
        return 1.0, 0.0
    scale = (float(v.max()) - float(v.min())) / ((q if q > 0 else 4.0) * 65536.0)
    return (scale if math.isfinite(scale) and scale > 0 else 1.0), float(v.sum() / len(v))


def scale_zero_many(v: np.ndarray, q: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The same of tiles of one size, a row for each."""
    finite = np.isfinite(v)
    n, whole = finite.sum(1), finite.all(1)
    v = np.where(finite, v, 0).astype(np.float64)
    with np.errstate(all="ignore"):
        scale = np.where(finite, v, -np.inf).max(1, initial=-np.inf) - np.where(finite, v, np.inf).min(1, initial=np.inf)
        scale = scale / ((q if q > 0 else 4.0) * 65536.0)
        zero = v.sum(1) / np.maximum(n, 1)
    scale = np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)
    if v.shape[1] >= 8:  # longer sums are added up in parts, which values that are left out would move
        for k in np.flatnonzero(~whole & (n > 0)).tolist():
            own = v[k, finite[k]]
            zero[k] = own.sum() / len(own)
    return scale, zero


def quantize(v: np.ndarray, scale: float, zero: float, method: str = NONE, tile: int = 0, seed: int = 1) -> np.ndarray:
    """NaN and infinite values become NULL."""
    return quantize_many(v[None], np.array([scale]), np.array([zero]), method, np.array([tile]), seed)[0]


def quantize_many(v: np.ndarray, scale: np.ndarray, zero: np.ndarray, method: str, tiles: np.ndarray, seed: int) -> np.ndarray:
    """The same of tiles of one size, a row for each."""
    v, scale, zero = v.astype(np.float64), scale[:, None], zero[:, None]
    finite = np.isfinite(v)
    x = (np.where(finite, v, zero) - zero) / scale
    if method != NONE:
        x = x + offsets_many(v.shape[1], tiles, seed) - 0.5
    out = half_away(x).astype(np.int64)
    out[~finite] = NULL
    if method == DITHER_2:
        out[v == 0] = ZERO
    return out
