"""Celestial world coordinates: pixels to longitude and latitude and back, as column expressions for 23 projections.

The equations are those of the published papers on world coordinates.  A projection takes native longitude and latitude (radians)
to the plane and back; the sphere is turned so that the reference point lies at CRVAL.  What can't be projected is null.
Parameters (PV cards) aren't read; the papers' defaults hold, for conics a middle latitude of 45 degrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingKeyword, UnsupportedWcs, WcsError
from ..sources.cards import Header

PI = math.pi
HALF = PI / 2
CONIC = PI / 4
AIR_LIMIT = -0.5  # of the Airy projection that is best for the whole hemisphere
STEPS = 12


def _null(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _safe(x: Column) -> Column:
    """Within the range of arc sines; what is beyond by more than rounding is null."""
    return F.when(F.abs(x) <= 1 + 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def _iterate(start: Column, step: Callable[[Column], Column], n: int = STEPS) -> Column:
    """step applied n times, as one expression whose size doesn't grow."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start.cast("double"), lambda a, _: step(a).cast("double"))


# ---- zenithal: a radius for a latitude ----------------------------------------------------------------------------


def _zenithal(radius: Callable[[Column], Column], latitude: Callable[[Column], Column]):
    def forward(phi: Column, theta: Column):
        r = radius(theta)
        return r * F.sin(phi), -r * F.cos(phi)

    def inverse(x: Column, y: Column):
        r = F.sqrt(x * x + y * y)
        return F.when(r == 0, F.lit(0.0)).otherwise(F.atan2(x, -y)), latitude(r)

    return forward, inverse


def _xi(theta: Column) -> Column:
    return (HALF - theta) / 2


def _air(theta: Column) -> Column:
    xi = _xi(theta)
    return F.when(xi < 1e-4, -2 * (-xi / 2 + AIR_LIMIT * xi)).otherwise(-2 * (F.log(F.cos(xi)) / F.tan(xi) + AIR_LIMIT * F.tan(xi)))


def _air_inverse(r: Column) -> Column:
    def step(xi: Column) -> Column:
        t = F.tan(xi)
        value = F.when(xi < 1e-4, -2 * (-xi / 2 + AIR_LIMIT * xi)).otherwise(-2 * (F.log(F.cos(xi)) / t + AIR_LIMIT * t))
        slope = F.when(xi < 1e-4, F.lit(1 - 2 * AIR_LIMIT)).otherwise(2 + 2 * F.log(F.cos(xi)) / F.pow(F.sin(xi), 2) - 2 * AIR_LIMIT / F.pow(F.cos(xi), 2))
        return F.greatest(F.lit(0.0), F.least(F.lit(HALF - 1e-9), xi - (value - r) / slope))

    xi = _iterate(r / (1 - 2 * AIR_LIMIT), step, 30)
    return HALF - 2 * xi


TAN = _zenithal(lambda t: _null(t > 0, F.cos(t) / F.sin(t)), lambda r: F.atan2(F.lit(1.0), r))
ZENITHAL = {
    "TAN": TAN,
    "AZP": TAN,  # both are TAN at the papers' defaults
    "SZP": TAN,
    "SIN": _zenithal(lambda t: _null(t >= 0, F.cos(t)), lambda r: F.acos(_safe(r))),
    "ARC": _zenithal(lambda t: HALF - t, lambda r: _null(r <= PI, HALF - r)),
    "FEYE": _zenithal(lambda t: HALF - t, lambda r: _null(r <= PI, HALF - r)),  # an equidistant fisheye
    "ZEA": _zenithal(lambda t: 2 * F.sin(_xi(t)), lambda r: HALF - 2 * F.asin(_safe(r / 2))),
    "STG": _zenithal(lambda t: _null(t > -HALF, 2 * F.tan(_xi(t))), lambda r: HALF - 2 * F.atan(r / 2)),
    "AIR": _zenithal(_air, _air_inverse),
}


# ---- cylindrical and their kin ------------------------------------------------------------------------------------


def _cyp(phi: Column, theta: Column):
    return phi, 2 * F.sin(theta) / (1 + F.cos(theta))


def _cyp_inverse(x: Column, y: Column):
    eta = y / 2
    return x, F.atan2(eta, F.lit(1.0)) + F.asin(_safe(eta / F.sqrt(eta * eta + 1)))


def _mol(phi: Column, theta: Column):
    target = PI * F.sin(theta)
    start = F.when(F.abs(theta) > 1.5, F.signum(theta) * (PI - F.pow(6 * F.greatest(F.lit(0.0), PI - F.abs(target)), 1 / 3))).otherwise(theta)

    def step(v: Column) -> Column:  # v is twice gamma: v + sin v = target
        slope = 1 + F.cos(v)
        return F.when(F.abs(slope) < 1e-12, v).otherwise(F.greatest(F.lit(-PI), F.least(F.lit(PI), v - (v + F.sin(v) - target) / slope)))

    gamma = F.when(F.abs(theta) >= HALF, F.signum(theta) * HALF).otherwise(_iterate(start, step, 40) / 2)
    return 2 * math.sqrt(2) / PI * phi * F.cos(gamma), math.sqrt(2) * F.sin(gamma)


def _mol_inverse(x: Column, y: Column):
    g = F.asin(_safe(y / math.sqrt(2)))
    c = F.cos(g)
    return F.when(c > 1e-12, PI * x / (2 * math.sqrt(2) * c)).otherwise(F.lit(0.0)), F.asin(_safe((2 * g + F.sin(2 * g)) / PI))


def _ait(phi: Column, theta: Column):
    g = F.sqrt(2 / (1 + F.cos(theta) * F.cos(phi / 2)))
    return 2 * g * F.cos(theta) * F.sin(phi / 2), g * F.sin(theta)


def _ait_inverse(x: Column, y: Column):
    u = 1 - x * x / 16 - y * y / 4
    z = F.sqrt(_null(u >= 0.5 - 1e-12, u))
    return 2 * F.atan2(z * x / 2, 2 * z * z - 1), F.asin(_safe(y * z))


def _hpx(phi: Column, theta: Column):
    s = F.sin(theta)
    sigma = F.sqrt(3 * (1 - F.abs(s)))
    centre = -PI + (2 * F.least(F.floor((phi + PI) / HALF), F.lit(3)) + 1) * PI / 4
    equator = F.abs(s) <= 2 / 3
    return F.when(equator, phi).otherwise(centre + (phi - centre) * sigma), F.when(equator, 3 * PI / 8 * s).otherwise(F.signum(theta) * PI / 4 * (2 - sigma))


def _hpx_inverse(x: Column, y: Column):
    sigma = 2 - F.abs(y) * 4 / PI
    centre = -PI + (2 * F.greatest(F.lit(0), F.least(F.floor((x + PI) / HALF), F.lit(3))) + 1) * PI / 4
    equator = F.abs(y) <= PI / 4
    phi = F.when(equator, x).when(sigma > 1e-12, centre + (x - centre) / sigma).otherwise(centre)
    theta = F.when(equator, F.asin(_safe(y * 8 / (3 * PI)))).otherwise(F.signum(y) * F.asin(_safe(1 - sigma * sigma / 3)))
    return phi, _null(sigma >= 0, theta)


CYLINDRICAL = {
    "CAR": (lambda p, t: (p, t), lambda x, y: (x, _null(F.abs(y) <= HALF + 1e-12, y))),
    "MER": (lambda p, t: (p, _null(F.abs(t) < HALF, F.log(F.tan(PI / 4 + t / 2)))), lambda x, y: (x, 2 * F.atan(F.exp(y)) - HALF)),
    "CEA": (lambda p, t: (p, F.sin(t)), lambda x, y: (x, F.asin(_safe(y)))),
    "CYP": (_cyp, _cyp_inverse),
    "SFL": (lambda p, t: (p * F.cos(t), t), lambda x, y: (F.when(F.cos(y) > 1e-12, x / F.cos(y)).otherwise(F.lit(0.0)), _null(F.abs(y) <= HALF + 1e-12, y))),
    "PAR": (
        lambda p, t: (p * (2 * F.cos(2 * t / 3) - 1), PI * F.sin(t / 3)),
        lambda x, y: (F.when(1 - 4 * F.pow(y / PI, 2) > 1e-12, x / (1 - 4 * F.pow(y / PI, 2))).otherwise(F.lit(0.0)), 3 * F.asin(_safe(y / PI))),
    ),
    "MOL": (_mol, _mol_inverse),
    "AIT": (_ait, _ait_inverse),
    "HPX": (_hpx, _hpx_inverse),
}


# ---- conics: both standard parallels at the middle latitude -------------------------------------------------------


def _conic(c: float, y0: float, radius: Callable[[Column], Column], latitude: Callable[[Column], Column]):
    def forward(phi: Column, theta: Column):
        r = radius(theta)
        return r * F.sin(c * phi), y0 - r * F.cos(c * phi)

    def inverse(x: Column, y: Column):
        r = F.sqrt(x * x + (y0 - y) * (y0 - y))
        return F.when(r == 0, F.lit(0.0)).otherwise(F.atan2(x, y0 - y) / c), latitude(r)

    return forward, inverse


def _conics() -> dict:
    s, cot = math.sin(CONIC), 1 / math.tan(CONIC)
    gamma = 2 * s
    coe = lambda t: 2 / gamma * F.sqrt(F.greatest(F.lit(0.0), 1 + s * s - gamma * F.sin(t)))
    coe0 = 2 / gamma * math.sqrt(1 + s * s - gamma * s)
    psi = math.cos(CONIC) / (s * math.tan((HALF - CONIC) / 2) ** s)
    coo0 = psi * math.tan((HALF - CONIC) / 2) ** s
    return {
        "COP": _conic(s, cot, lambda t: cot - F.tan(t - CONIC), lambda r: CONIC + F.atan(cot - r)),
        "COE": _conic(s, coe0, coe, lambda r: F.asin(_safe((1 + s * s) / gamma - gamma * r * r / 4))),
        "COD": _conic(s, cot, lambda t: CONIC - t + cot, lambda r: CONIC + cot - r),
        "COO": _conic(s, coo0, lambda t: psi * F.pow(F.tan((HALF - t) / 2), F.lit(s)), lambda r: HALF - 2 * F.atan(F.pow(r / psi, F.lit(1 / s)))),
    }


CONICS = _conics()
CODES = (*ZENITHAL, "NCP", *CYLINDRICAL, *CONICS)


def _ncp(delta: float):
    """The old north-pole projection: the oblique form of SIN whose lines of projection run along the pole's axis."""
    if abs(math.sin(delta)) < 1e-12:
        raise WcsError("NCP needs a reference point off the equator")
    eta = math.cos(delta) / math.sin(delta)

    def forward(phi: Column, theta: Column):
        visible = theta >= -F.atan(eta * F.cos(phi)) - 1e-12
        return _null(visible, F.cos(theta) * F.sin(phi)), _null(visible, -F.cos(theta) * F.cos(phi) + eta * (1 - F.sin(theta)))

    def inverse(x: Column, y: Column):
        # with s = 1 - sin(theta): x**2 + (y - eta s)**2 = 1 - (1 - s)**2
        a, b, c = 1 + eta * eta, -2 * (1 + y * eta), x * x + y * y
        root = b * b - 4 * a * c
        s = (-b - F.sqrt(_null(root >= 0, root))) / (2 * a)
        return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.atan2(x, -(y - eta * s))), F.asin(_safe(1 - s))

    return forward, inverse


# ---- the header's part --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Wcs:
    code: str
    crval: tuple[float, float]
    crpix: tuple[float, float]
    cd: tuple[float, float, float, float]

    def projection(self):
        if self.code == "NCP":
            return _ncp(math.radians(self.crval[1]))
        return (ZENITHAL | CYLINDRICAL | CONICS)[self.code]

    def _matrix(self) -> list[list[float]]:
        """From native to celestial directions."""
        a, d = (math.radians(v) for v in self.crval)
        ca, sa, cd, sd = math.cos(a), math.sin(a), math.cos(d), math.sin(d)
        if self.code in ZENITHAL or self.code == "NCP":
            # the native pole at CRVAL, its prime meridian pointing away from the celestial pole
            return [[sd * ca, -sa, cd * ca], [sd * sa, ca, cd * sa], [-cd, 0.0, sd]]
        t = CONIC if self.code in CONICS else 0.0
        c, s = math.cos(d - t), math.sin(d - t)
        return [[ca * c, -sa, -ca * s], [sa * c, ca, -sa * s], [s, 0.0, c]]

    def pixel_to_world(self, df: DataFrame, x: str, y: str, lon: str, lat: str) -> DataFrame:
        """Adds longitude in [0, 360) and latitude in degrees of a pixel counted from 1.

        Each step is a column of its own, so that no step's expression is repeated in the next; the given columns stand aside in one
        meanwhile, so that none of theirs clashes."""
        dx, dy = F.col(x) - self.crpix[0], F.col(y) - self.crpix[1]
        out = df.select(F.struct("*").alias("row"), ((self.cd[0] * dx + self.cd[1] * dy) * (PI / 180)).alias("u"), ((self.cd[2] * dx + self.cd[3] * dy) * (PI / 180)).alias("v"))
        phi, theta = self.projection()[1](F.col("u"), F.col("v"))
        out = out.select("row", phi.alias("phi"), theta.alias("theta"))
        m, p, t = self._matrix(), F.col("phi"), F.col("theta")
        out = out.select("row", (F.cos(t) * F.cos(p)).alias("n0"), (F.cos(t) * F.sin(p)).alias("n1"), F.sin(t).alias("n2"))
        out = out.select("row", *((m[r][0] * F.col("n0") + m[r][1] * F.col("n1") + m[r][2] * F.col("n2")).alias(f"e{r}") for r in range(3)))
        e = [F.col(f"e{r}") for r in range(3)]
        out = out.select("row", F.degrees(F.atan2(e[1], e[0])).alias("lon"), F.degrees(F.atan2(e[2], F.sqrt(e[0] * e[0] + e[1] * e[1]))).alias("lat"))
        turned = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))
        return _beside(df, out, {lon: F.when(turned >= 360, F.lit(0.0)).otherwise(turned), lat: F.col("lat")})

    def world_to_pixel(self, df: DataFrame, lon: str, lat: str, x: str, y: str) -> DataFrame:
        m = self._matrix()
        out = df.select(F.struct("*").alias("row"), F.radians(lon).alias("a"), F.radians(lat).alias("d"))
        a, d = F.col("a"), F.col("d")
        out = out.select("row", (F.cos(d) * F.cos(a)).alias("e0"), (F.cos(d) * F.sin(a)).alias("e1"), F.sin(d).alias("e2"))
        out = out.select("row", *((m[0][k] * F.col("e0") + m[1][k] * F.col("e1") + m[2][k] * F.col("e2")).alias(f"n{k}") for k in range(3)))
        n = [F.col(f"n{k}") for k in range(3)]
        phi = F.when((n[0] == 0) & (n[1] == 0), F.lit(0.0)).otherwise(F.atan2(n[1], n[0]))
        out = out.select("row", F.atan2(n[2], F.sqrt(n[0] * n[0] + n[1] * n[1])).alias("theta"), phi.alias("phi"))
        u, v = self.projection()[0](F.col("phi"), F.col("theta"))
        out = out.select("row", (u * (180 / PI)).alias("u"), (v * (180 / PI)).alias("v"))
        det = self.cd[0] * self.cd[3] - self.cd[1] * self.cd[2]
        u, v, none = F.col("u"), F.col("v"), F.lit(None).cast("double")
        px = (self.cd[3] * u - self.cd[1] * v) / det + self.crpix[0] if det else none
        py = (self.cd[0] * v - self.cd[2] * u) / det + self.crpix[1] if det else none
        return _beside(df, out, {x: px, y: py})


def _beside(df: DataFrame, out: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of df, taken from ``row``, and new ones; those of the same name are replaced."""
    names = {n.lower() for n in new}
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c.lower() not in names), *(v.alias(n) for n, v in new.items()))


def parse(h: Header) -> Wcs:
    types = [h.get_string(f"CTYPE{k}") for k in (1, 2)]
    if None in types:
        raise MissingKeyword("CTYPE1/CTYPE2")
    types = [t.strip() for t in types]
    if any(t.endswith("-SIP") for t in types):
        raise UnsupportedWcs("SIP distortions")
    codes = [t.rsplit("-", 1)[-1] if "-" in t else "" for t in types]
    if codes[0] != codes[1] or codes[0] not in CODES:
        raise UnsupportedWcs(f"CTYPE {types}")
    for k in (1, 2):
        if (h.get_string(f"CUNIT{k}") or "").strip().lower() not in ("", "deg", "degree"):
            raise UnsupportedWcs(f"CUNIT{k} {h.get_string(f'CUNIT{k}')}")
    value = {n: h.get_float(n) for n in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")}
    if None in value.values():
        raise MissingKeyword(", ".join(k for k, v in value.items() if v is None))
    places = ((1, 1), (1, 2), (2, 1), (2, 2))
    if any(h.find(f"CD{i}_{j}") for i, j in places):
        cd = tuple(h.get_float(f"CD{i}_{j}", 0.0) for i, j in places)
    else:
        step = [h.get_float(f"CDELT{i}") for i in (1, 2)]
        if None in step:
            raise MissingKeyword("CDELT1/CDELT2")
        cd = tuple(step[i - 1] * h.get_float(f"PC{i}_{j}", 1.0 if i == j else 0.0) for i, j in places)
    return Wcs(codes[0], (value["CRVAL1"], value["CRVAL2"]), (value["CRPIX1"], value["CRPIX2"]), cd)


def with_world(df: DataFrame, header: Header | Wcs, x: str = "x", y: str = "y") -> DataFrame:
    """Adds lon and lat of pixels counted from 1."""
    w = header if isinstance(header, Wcs) else parse(header)
    return w.pixel_to_world(df, x, y, "lon", "lat")


def with_pixel(df: DataFrame, header: Header | Wcs, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds x and y, counted from 1, of positions in degrees."""
    w = header if isinstance(header, Wcs) else parse(header)
    return w.world_to_pixel(df, lon, lat, "x", "y")
