"""Where the HDUs of a file are: headers are read one after another, data are stepped over."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs

from ..errors import InvalidFormat, MissingKeyword, UnsupportedExtension
from .cards import BLOCK, Header, parse_header


def padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def data_bytes(h: Header) -> int:
    """abs(BITPIX) / 8 * GCOUNT * (PCOUNT + product of the axes); 0 without axes."""
    bits, naxis = h.require_int("BITPIX"), h.require_int("NAXIS")
    if not naxis:
        return 0
    n = 1
    for k in range(1, naxis + 1):
        n *= h.require_int(f"NAXIS{k}")
    size = abs(bits) // 8 * h.get_int("GCOUNT", 1) * (h.get_int("PCOUNT", 0) + n)
    if not 0 <= size < 1 << 63:
        raise InvalidFormat(f"data of {size} bytes")
    return size


@dataclass
class Hdu:
    index: int
    header: Header
    header_offset: int
    data_offset: int
    data_bytes: int
    kind: str  # empty, image, table (ASCII) or bintable

    @property
    def axes(self) -> list[int]:
        return [self.header.require_int(f"NAXIS{k}") for k in range(1, self.header.get_int("NAXIS", 0) + 1)]

    @property
    def extname(self) -> str | None:
        return self.header.get_string("EXTNAME")

    @property
    def zimage(self) -> bool:
        return self.kind == "bintable" and self.header.get_bool("ZIMAGE") is True


def kind_of(h: Header, size: int) -> str:
    """Tables keep their kind without rows; images without pixels are empty."""
    ext = h.get_string("XTENSION")
    if ext is not None:
        kinds = {"IMAGE": "image", "TABLE": "table", "BINTABLE": "bintable"}
        if ext.strip() not in kinds:
            raise UnsupportedExtension(ext)
        kind = kinds[ext.strip()]
        return "empty" if kind == "image" and not size else kind
    return "image" if h.get_bool("SIMPLE") is not None and size else "empty"


class Source:
    """An open file of any store that pyarrow knows, or bytes."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        if data is not None:
            self.file, self.size = io.BytesIO(data), len(data)
        else:
            fs, name = filesystem(path)
            self.file, self.size = fs.open_input_file(name), fs.get_file_info(name).size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


#: Names under which Hadoop knows stores that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path there, for paths as Spark writes them."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in SCHEMES:
        path = f"{SCHEMES[scheme]}://{rest}"
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The file, or those of the folder in order; hidden ones and those that begin with _ are no data."""
    return [name for name, _ in sized_files(path)]


def sized_files(path: str) -> list[tuple[str, int]]:
    """The same with their sizes in bytes, from one listing."""
    fs, name = filesystem(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise InvalidFormat(f"no such file: {path}")
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    head = path[: len(path.rstrip("/")) - len(name.rstrip("/"))] if "://" in path or path.startswith("file:") else ""
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def index(source: Source, strict: bool = False) -> Iterator[Hdu]:
    """All HDUs.  A truncated extension ends the file, or raises if strict."""
    at, k = 0, 0
    while at < source.size:
        try:

            def blocks(at=at):
                while True:
                    yield source.read(at, BLOCK)
                    at += BLOCK

            header, n = parse_header(blocks())
            size = data_bytes(header)
            if at + n + size > source.size:
                raise InvalidFormat(f"HDU {k} is truncated")
        except (InvalidFormat, MissingKeyword):
            if k == 0 or strict:
                raise
            return
        yield Hdu(k, header, at, at + n, size, kind_of(header, size))
        at, k = at + n + padded(size), k + 1
    if not k:
        raise InvalidFormat("an empty file")


def find(source: Source, hdu: str | int | None = None, extname: str | None = None) -> Hdu:
    """By number, by EXTNAME (exact, the first extension that has it), else the first with data."""
    for h in index(source):
        if extname is not None:
            if h.index and h.extname == extname:
                return h
        elif hdu is not None:
            if h.index == int(hdu):
                return h
        elif h.kind != "empty":
            return h
    raise InvalidFormat(f"no such HDU: {extname if extname is not None else hdu}")
