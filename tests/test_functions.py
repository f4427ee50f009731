import math

import pytest
from pyspark.sql import functions as F

from hduframe.errors import MissingKeyword, UnsupportedWcs, WcsError
from hduframe.functions import cardexpr, scaling, wcs
from hduframe.sources.cards import Card, Header, format_card


def header(**more):
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 150.0, "CRVAL2": 30.0, "CRPIX1": 50.5, "CRPIX2": 50.5, "CDELT1": -0.01, "CDELT2": 0.01} | more
    return Header([Card(k, v) for k, v in base.items() if v is not None])


def test_wcs_headers():
    w = wcs.parse(header())
    assert w.code == "TAN" and w.cd == (-0.01, 0.0, 0.0, 0.01)
    assert wcs.parse(header(CD1_1=1.0)).cd == (1.0, 0.0, 0.0, 0.0)
    assert wcs.parse(header(PC1_2=0.5)).cd == (-0.01, -0.005, 0.0, 0.01)
    for bad in ({"CTYPE1": "RA---TAN-SIP"}, {"CTYPE2": "DEC--SIN"}, {"CTYPE1": "WAVE", "CTYPE2": "WAVE"}, {"CUNIT1": "rad"}):
        with pytest.raises(UnsupportedWcs):
            wcs.parse(header(**bad))
    for bad in ({"CTYPE1": None}, {"CRVAL2": None}, {"CDELT1": None}):
        with pytest.raises(MissingKeyword):
            wcs.parse(header(**bad))


@pytest.mark.parametrize("code", wcs.CODES)
@pytest.mark.parametrize("crval", [(150.0, 30.0), (0.5, -70.0)])
def test_projections(spark, code, crval):
    w = wcs.Wcs(code, crval, (50.5, 50.5), (-0.1, 0.02, 0.02, 0.1))
    grid = spark.range(49).select((F.col("id") % 7 * 16.5 + 1).alias("px"), (F.floor(F.col("id") / 7) * 16.5 + 1).alias("py"))
    r = wcs.with_pixel(wcs.with_world(grid, w, "px", "py"), w).collect()
    assert all(abs(x.x - x.px) < 1e-7 and abs(x.y - x.py) < 1e-7 and 0 <= x.lon < 360 for x in r)
    at = min(r, key=lambda x: abs(x.px - 50.5) + abs(x.py - 50.5))
    assert abs(at.px - 50.5) < 1e-9 and abs(at.lat - crval[1]) < 1e-9 and abs((at.lon - crval[0] + 180) % 360 - 180) < 1e-9


def test_what_can_t_be_projected(spark):
    w = wcs.Wcs("SIN", (0.0, 0.0), (0.0, 0.0), (1.0, 0.0, 0.0, 1.0))
    far = wcs.with_world(spark.sql("SELECT 100D AS px, 0D AS py"), w, "px", "py").first()
    assert far.lon is None and far.lat is None
    behind = wcs.with_pixel(spark.sql("SELECT 180D AS lon, 0D AS lat"), wcs.Wcs("TAN", (0.0, 0.0), (0.0, 0.0), (1.0, 0.0, 0.0, 1.0))).first()
    assert behind.x is None and behind.y is None
    singular = wcs.with_pixel(spark.sql("SELECT 0D AS lon, 0D AS lat"), wcs.Wcs("TAN", (0.0, 0.0), (0.0, 0.0), (1.0, 1.0, 1.0, 1.0))).first()
    assert singular.x is None
    with pytest.raises(WcsError):
        wcs.Wcs("NCP", (0.0, 0.0), (0.0, 0.0), (1.0, 0.0, 0.0, 1.0)).projection()


def test_gnomonic_against_the_closed_form(spark):
    w = wcs.Wcs("TAN", (150.0, 30.0), (0.0, 0.0), (-1.0, 0.0, 0.0, 1.0))
    for r in wcs.with_world(spark.sql("SELECT explode(array(-20D, 3D, 20D)) AS px, 7D AS py"), w, "px", "py").collect():
        x, y, d = math.radians(-r.px), math.radians(r.py), math.radians(30)
        assert abs(r.lon - (150 + math.degrees(math.atan2(x, math.cos(d) - y * math.sin(d))))) < 1e-10


def test_cards_as_expressions(spark):
    cards = [Card("A", 1, "c"), Card("B", -1.5e10), Card("C", True), Card("D", "it's", "n"), Card("E", (1, -2)), Card("F", (1.5, 2.0)), Card("COMMENT", None, "text")]
    raw = [format_card(c)[0].decode() for c in cards] + ["G       =".ljust(80), "H       =                1.5D2".ljust(80)]
    got = {r["name"]: r for r in cardexpr.parse_cards(spark.createDataFrame([(x,) for x in raw], "card string")).collect()}
    assert [got[k].value_type for k in "ABCDEFGH"] == ["int", "float", "logical", "string", "complex_int", "complex_float", "undefined", "float"]
    assert (got["A"].v_int, got["B"].v_float, got["C"].v_bool, got["D"].v_str, got["D"].comment, got["F"].v_re, got["F"].v_im, got["H"].v_float) == (1, -1.5e10, True, "it's", "n", 1.5, 2.0, 150.0)
    assert got["COMMENT"].value_type is None and got["COMMENT"].comment == "text"
    made = spark.range(1).select(cardexpr.card_of(F.lit("a"), F.lit("1"), F.lit("c")).alias("a"), cardexpr.string_card(F.lit("d"), F.lit("it's")).alias("d"), cardexpr.card_of(F.lit("c"), cardexpr.logical_text(F.lit(True))).alias("c")).first()
    assert (made.a, made.c) == (raw[0], raw[2]) and made.d == format_card(Card("D", "it's"))[0].decode()


def test_scaling_and_rasters(spark):
    df = spark.createDataFrame([(-32768,), (0,), (32767,)], "value int")
    assert [r[0] for r in df.select(scaling.unsigned("value", 16)).collect()] == [0, 32768, 65535]
    assert [r[0] for r in df.select(scaling.signed(scaling.unsigned("value", 16), 16)).collect()] == [-32768, 0, 32767]
    assert [r.grey for r in scaling.raster(df, 16, 1.0, 32768.0).collect()] == [0, 32768, 65535]
    assert [r.grey for r in scaling.raster(df, 16, 1.0, 0.0).collect()] == [0, 0, 32767]
    f = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.25,), (float("nan"),)], "value float")
    assert [r.grey for r in scaling.raster(f, -32).collect()] == [0, 65535, 32767, 16383, 0]
    same = spark.createDataFrame([(2.0,), (2.0,)], "value double")
    assert [r.grey for r in scaling.raster(same, -64).collect()] == [0, 0]
    assert spark.range(1).select(scaling.unsigned(F.lit(-(1 << 63)).cast("long"), 64)).first()[0] == 0


def test_typed_values(spark):
    cards = spark.createDataFrame([(0, "A", 5, None, None, None), (1, "a", 6, None, None, None), (2, "S", None, None, "x", None)], "card_index int, name string, v_int long, v_float double, v_str string, v_bool boolean")
    r = cards.agg(cardexpr.typed_value("a", "int").alias("i"), cardexpr.typed_value("A", "float").alias("f"), cardexpr.typed_value("s", "string").alias("s"), cardexpr.typed_value("zz", "int").alias("z")).first()
    assert (r.i, r.f, r.s, r.z) == (5, 5.0, "x", None)


def test_bits(spark):
    from hduframe.functions import bits

    values = [0, -1, 1, -2, 5, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", bits.zigzag("v").alias("z"), bits.unzigzag(bits.zigzag("v")).alias("u"), bits.sign_extend("v", 8).alias("s"), bits.unsigned_word("v").alias("w")).collect()
    assert [r.z for r in rows[:5]] == [0, 1, 2, 3, 10] and all(r.u == r.v for r in rows)
    assert [r.s for r in rows] == [0, -1, 1, -2, 5, -1, 0] and [r.w for r in rows] == [v & 0xFFFFFFFF for v in values]
    flags = spark.createDataFrame([(b"\xa5\x80",)], "b binary").select(bits.booleans("b", 9).alias("x")).first().x
    assert flags == [True, False, True, False, False, True, False, True, True]


def test_from_raster(spark):
    grey = spark.createDataFrame([(0,), (255,), (65535,)], "g int")
    column, scale, zero = scaling.from_raster("g", 16)
    assert [r[0] * scale + zero for r in grey.select(column).collect()] == [0.0, 255.0, 65535.0]
    assert scaling.from_raster("g", 8)[1:] == (1.0, 0.0)
