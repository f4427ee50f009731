"""GZIP_1 and GZIP_2: deflated big-endian numbers, in GZIP_2 the bytes of one place together."""

from __future__ import annotations

import zlib

import numpy as np

from ...errors import CompressionError

LEVEL = 6


def shuffle(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()


def unshuffle(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes()


def deflate(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def inflate(raw: bytes) -> bytes:
    """A gzip member; its checksum is verified."""
    try:
        return zlib.decompress(raw, 31)
    except zlib.error as e:
        raise CompressionError(f"gzip: {e}") from e


def encode(raw: bytes, width: int, shuffled: bool) -> bytes:
    return deflate(shuffle(raw, width) if shuffled else raw)


def decode(raw: bytes, width: int, shuffled: bool) -> bytes:
    out = inflate(raw)
    if len(out) % width:
        raise CompressionError(f"{len(out)} bytes are no numbers of {width}")
    return unshuffle(out, width) if shuffled else out
