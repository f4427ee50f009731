"""Errors of the package."""


class FitsError(Exception):
    """Base of all errors about FITS data."""


class InvalidFormat(FitsError):
    """The bytes are no FITS file, or a truncated one."""


class InvalidCard(FitsError):
    """A header card can't be parsed."""


class MissingKeyword(FitsError):
    """A mandatory keyword is absent."""


class WrongType(FitsError):
    """A keyword's value has another type than asked for."""


class UnsupportedBitpix(FitsError):
    """BITPIX is none of the six legal values."""


class SizeMismatch(FitsError):
    """Data have another length than the header says."""


class ChecksumMismatch(FitsError):
    """DATASUM or CHECKSUM don't agree with the bytes."""


class UnsupportedExtension(FitsError):
    """XTENSION is none of IMAGE, TABLE, BINTABLE."""


class InvalidTable(FitsError):
    """A table's layout or a cell is wrong."""


class UnsupportedCompression(FitsError):
    """A compression that isn't implemented, or not in this direction."""


class CompressionError(FitsError):
    """Compressed data can't be decoded or encoded."""


class WcsError(FitsError):
    """World coordinates can't be set up from the header."""


class UnsupportedWcs(WcsError):
    """A projection or distortion that isn't implemented."""
