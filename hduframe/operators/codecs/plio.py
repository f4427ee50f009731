"""PLIO_1 decoding: run-length coded masks in 16-bit words.

A word's upper four bits say what to do with the lower twelve: 0 zeros, 4 that many pixels of the high value, 5 zeros and the last
pixel the high value; 1 sets the high value with the next word, 2 and 3 raise and lower it; 6 and 7 do so and write one pixel.
"""

from __future__ import annotations

import numpy as np

from ...errors import CompressionError


def decode(words: np.ndarray, n: int) -> np.ndarray:
    w = np.asarray(words, np.int64)
    out = np.zeros(n, np.int64)
    if len(w) < 4:
        if n and len(w):
            raise CompressionError("a PLIO_1 tile without a header")
        return out
    if w[2] > 0:
        length, first = int(w[2]), 3
    else:
        if len(w) < 7:
            raise CompressionError("a PLIO_1 tile without a header")
        length, first = (int(w[4]) << 15) + int(w[3]), int(w[1])
    if length > len(w):
        raise CompressionError("a PLIO_1 tile ends too early")
    w = w[first:length]
    op, data = w >> 12 & 0xF, w & 0xFFF
    # the word behind a 1 is a value, whatever it looks like
    value = np.zeros(len(w), bool)
    for k in np.flatnonzero(op == 1).tolist():
        if not value[k]:
            value[k + 1 : k + 2] = True
    behind = np.append(w[1:], 0)
    at = np.flatnonzero(~value)
    op, data, behind = op[at], data[at], behind[at]
    step = np.where((op == 0) | (op == 4) | (op == 5), data, (op == 6) | (op == 7))
    end = np.cumsum(step)
    begin = end - step
    if len(op) and op[-1] == 1 and at[-1] == len(w) - 1 and begin[-1] < n:
        raise CompressionError("a PLIO_1 tile ends too early")
    # the high value: from the last word that set it, with all that raised or lowered it since
    moved = np.cumsum(np.where((op == 2) | (op == 6), data, 0) - np.where((op == 3) | (op == 7), data, 0))
    last = np.maximum.accumulate(np.where(op == 1, np.arange(len(op)), -1)) if len(op) else op
    high = np.where(last >= 0, (behind[last] << 12) + data[last] - moved[last], 1) + moved if len(op) else op
    run = np.flatnonzero((op == 4) & (begin < n))
    size = np.minimum(end[run], n) - begin[run]
    out[np.repeat(begin[run] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = np.repeat(high[run], size)
    one = (op == 5) & (data > 0) & (end <= n) | ((op == 6) | (op == 7)) & (begin < n)
    out[end[one] - 1] = high[one]
    return out
