"""The ``fits`` data source: catalogs, tables, images and compressed tiles of FITS files, and writing them.

Options of reading: mode (table, rows, pixels, hdus, cards, tiles), hdu or extname (else the first HDU with data), columns (a list
by commas: others aren't decoded), scale (apply TSCAL/TZERO to binary tables), nullLogical (bytes of 0 are null, not false), rowIndex, strict (truncated extensions raise),
verify (hdus: sum up the data), partitionBytes, pushdown (see ``read``), pathColumn (table, rows, pixels: a column of this name holds the file's path),
permissive (hdus, cards: a file that can't be parsed gives a row with its error instead of ending the job).
A scan is planned from a listing with sizes.  Of many files, those of up to WHOLE_FILE bytes are dealt to tasks whole, some for each, and the
tasks step through their headers; only of few or large files the driver does, and cuts their data into ranges of rows (of pixels, in the mode pixels, so that
an image of one long line is cut too).  Ranges grow with the input beyond MOST_PARTS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import InvalidTable
from ..functions.checksum import Checksum, datasum_status, verify_hdu
from .cards import UNDEFINED
from .decode import columns, image_schema, read_image, read_table, table_schema
from .layout import Hdu, Source, files, find, index, sized_files
from .tform import arrow_type

HDUS = "path string, hdu_index int, kind string, extname string, bitpix int, axes array<bigint>, nrows bigint, ncols int, pcount bigint, gcount bigint, header_offset bigint, data_offset bigint, data_bytes bigint, zimage boolean, datasum_status string, checksum_ok boolean, error string"
CARDS = "path string, hdu_index int, card_index int, name string, value_type string, v_bool boolean, v_int bigint, v_float double, v_str string, v_re double, v_im double, comment string, raw string, error string"
TILES = "path string, hdu_index int, tile_index bigint, payload binary, words array<smallint>, raw binary, zscale double, zzero double, zblank int"
PARTITION_BYTES, MOST_PARTS, FEW_FILES, WHOLE_FILE = 16 << 20, 100_000, 32, 256 << 20


@dataclass
class Part(InputPartition):
    path: str
    hdu: int
    first: int
    last: int


def flag(options: dict, name: str, default: str = "false") -> bool:
    return str(options.get(name, default)).lower() == "true"


class FitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    @property
    def mode(self) -> str:
        return self.options.get("mode", "table")

    def _first(self) -> tuple[Source, Hdu]:
        found = files(self.options["path"])
        if not found:
            raise InvalidTable(f"no files in {self.options['path']}")
        source = Source(found[0])
        return source, find(source, self.options.get("hdu"), self.options.get("extname"))

    def schema(self):
        if self.mode in ("hdus", "cards", "tiles"):
            return {"hdus": HDUS, "cards": CARDS, "tiles": TILES}[self.mode]
        _, hdu = self._first()
        own = [T.StructField(self.options["pathcolumn"], T.StringType())] if "pathcolumn" in self.options else []
        if self.mode in ("rows", "pixels"):
            return T.StructType([*own, *image_schema(hdu.header, self.mode).fields])
        full = table_schema(hdu.header, flag(self.options, "scale"), flag(self.options, "rowindex"))
        if wanted := self.options.get("columns"):
            names = [c.strip().lower() for c in wanted.split(",")]
            full = T.StructType([f for f in full.fields if f.name.lower() in names or f.name == "_row_index"])
        if own and own[0].name in full.names:
            raise InvalidTable(f"the table has a column {own[0].name}")
        return T.StructType([*own, *full.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PushingReader if flag(self.options, "pushdown") else Reader)(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        from .fits_sink import FitsWriter

        return FitsWriter(dict(self.options), schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted = options, schema
        self.low, self.high, self.only = 0, 1 << 62, None

    def _size(self, h: Hdu) -> tuple[int, int]:
        """Rows (or pixels), and bytes of each, in which the data are cut."""
        if h.kind in ("table", "bintable"):
            n = h.header.require_int("NAXIS2")
        else:
            n = 1 if h.axes else 0
            for k in h.axes[0 if self.mode == "pixels" else 1 :]:
                n *= k
        return n, max(1, h.data_bytes // n if n else 1)

    @property
    def mode(self) -> str:
        return self.options.get("mode", "table")

    def _find(self, source: Source) -> Hdu | None:
        if self.mode == "tiles" and "hdu" not in self.options and "extname" not in self.options:
            return next((x for x in index(source) if x.zimage), None)
        return find(source, self.options.get("hdu"), self.options.get("extname"))

    def partitions(self) -> list[Part]:
        found, out = sized_files(self.options["path"]), []
        most = max(int(self.options.get("partitionbytes", PARTITION_BYTES)), -(-sum(size for _, size in found) // MOST_PARTS))
        if self.mode in ("hdus", "cards"):  # some files for each task
            each = max(1, -(-len(found) // 4096))
            return [Part("\n".join(p for p, _ in found[k : k + each]), -1, 0, 0) for k in range(0, len(found), each)] or [Part("", -2, 0, 0)]
        held: list[str] = []
        room = most
        for path, size in found:
            if len(found) > FEW_FILES and size <= max(WHOLE_FILE, most):
                if held and size > room:
                    out.append(Part("\n".join(held), -3, 0, 1 << 62))
                    held, room = [], most
                held.append(path)
                room -= size
                continue
            source = Source(path)
            h = self._find(source)
            if h is None:
                continue
            n, width = self._size(h)
            each = max(1, most // width)
            for a in range(0, n, each):
                b = min(n, a + each)
                if self._wanted(a, b):
                    out.append(Part(path, h.index, max(a, self.low), min(b, self.high)))
            source.close()
        if held:
            out.append(Part("\n".join(held), -3, 0, 1 << 62))
        return out or [Part("", -2, 0, 0)]

    def _wanted(self, a: int, b: int) -> bool:
        return a < self.high and b > self.low and (self.only is None or any(a <= x < b for x in self.only))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.hdu == -2:
            return
        for path in part.path.split("\n"):
            if self.mode in ("hdus", "cards"):
                yield from self._headers(path)
                continue
            source = Source(path)
            try:
                if part.hdu == -3:  # a whole file
                    h = self._find(source)
                    if h is None:
                        continue
                    first, last = max(0, self.low), min(self._size(h)[0], self.high)
                    if first >= last or not self._wanted(first, last):
                        continue
                else:
                    h, first, last = find(source, part.hdu), part.first, part.last
                if self.mode == "tiles":
                    from ..operators.tiles import read_tiles

                    yield from read_tiles(source, h, path, first, last, self.wanted)
                elif h.kind in ("table", "bintable"):
                    yield from self._with_path(path, lambda wanted, h=h, first=first, last=last, source=source: read_table(source, h, first, last, wanted, flag(self.options, "scale"), flag(self.options, "nulllogical")))
                else:
                    yield from self._with_path(path, lambda wanted, h=h, first=first, last=last, source=source: read_image(source, h, first, last, wanted, self.mode))
            finally:
                source.close()

    def _with_path(self, path: str, batches) -> Iterator[pa.RecordBatch]:
        """With the option pathColumn, batches with the file's path in a column of that name."""
        name = self.options.get("pathcolumn")
        if not name or name not in self.wanted.names:
            yield from batches(self.wanted)
            return
        for batch in batches(T.StructType([f for f in self.wanted.fields if f.name != name])):
            yield pa.RecordBatch.from_arrays([pa.array([path] * batch.num_rows, pa.string()) if n == name else batch.column(n) for n in self.wanted.names], names=self.wanted.names)

    def _headers(self, path: str) -> Iterator[pa.RecordBatch]:
        try:
            source = Source(path)
            try:
                batches = list((self._hdus if self.mode == "hdus" else self._cards)(source, path))
            finally:
                source.close()
        except Exception as e:
            if not flag(self.options, "permissive"):
                raise
            batches = list(self._batch([(path, *[None] * (len(self.wanted.names) - 2), f"{type(e).__name__}: {e}")]))
        yield from batches

    def _batch(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow_type(f.dataType)) for c, f in zip(cols, self.wanted.fields, strict=True)], names=self.wanted.names)

    def _hdus(self, source: Source, path: str) -> Iterator[pa.RecordBatch]:
        rows = []
        for h in index(source, flag(self.options, "strict")):
            table = h.kind in ("table", "bintable")
            status = ok = None
            if flag(self.options, "verify"):
                total = datasum(source, h)
                status = datasum_status(h.header, total)
                ok = verify_hdu(source.read(h.header_offset, h.data_offset - h.header_offset), total) if h.header.find("CHECKSUM") else None
            head = h.header
            rows.append((path, h.index, h.kind, h.extname, head.get_int("BITPIX"), h.axes, head.get_int("NAXIS2") if table else None, head.get_int("TFIELDS") if table else None, head.get_int("PCOUNT", 0), head.get_int("GCOUNT", 1), h.header_offset, h.data_offset, h.data_bytes, h.zimage, status, ok, None))
        yield from self._batch(rows)

    def _cards(self, source: Source, path: str) -> Iterator[pa.RecordBatch]:
        rows = []
        for h in index(source, flag(self.options, "strict")):
            for k, c in enumerate(h.header):
                v = None if c.value is UNDEFINED else c.value
                kind = c.value_type
                pair = v if isinstance(v, tuple) else (None, None)
                rows.append((path, h.index, k, c.name, kind, v if kind == "logical" else None, v if kind == "int" else None, v if kind == "float" else None, v if kind == "string" else None, *(float(x) if x is not None else None for x in pair), c.comment, c.raw, None))
        yield from self._batch(rows)


def datasum(source: Source, h: Hdu, chunk: int = 1 << 20) -> int:
    """Of the data and, for ASCII tables, the blanks behind them."""
    from .layout import padded

    total, at = Checksum(), 0
    end = padded(h.data_bytes) if h.kind == "table" else h.data_bytes
    while at < end:
        raw = source.read(h.data_offset + at, min(chunk, end - at))
        if not raw:
            break
        total.update(raw)
        at += len(raw)
    return total.finish()


class PushingReader(Reader):
    """Takes comparisons of the row's number, so that ranges without such rows aren't read.

    The number has a name of its own in each mode; a table's own columns, whatever they are called, are values and aren't taken."""

    INDEXES = {"table": "_row_index", "rows": "row_index", "pixels": "pixel_index", "tiles": "tile_index"}

    def pushFilters(self, filters: list[Filter]):
        name = self.INDEXES.get(self.options.get("mode", "table"))
        if name == "_row_index" and not flag(self.options, "rowindex"):
            name = None
        for f in filters:
            if name and tuple(getattr(f, "attribute", ())) == (name,) and (isinstance(f, In) or isinstance(getattr(f, "value", None), int)):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, f.value + 1)
                elif isinstance(f, In):
                    self.only = [x for x in f.value if x is not None]
            yield f  # Spark looks at each row all the same


def read(spark: SparkSession, path: str, mode: str = "table", pushdown: bool = False, **options) -> DataFrame:
    """A scan.  With pushdown, comparisons of the row number leave out ranges; this sets the setting that Spark asks for."""
    register(spark)
    r = spark.read.format("fits").option("mode", mode)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        r = r.option("pushdown", "true")
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return r.load(path)


def register(spark: SparkSession) -> SparkSession:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(FitsDataSource)
    return spark
