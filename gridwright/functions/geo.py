"""Affine georeferencing, coordinate systems and polygons as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import DEFAULT_CENTRE, DEFAULT_CRS, MAP_ZOOM
from .numbers import round_half_up

A, K0, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 0.9996, 500_000.0, 10_000_000.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Coefficients whose k-th row starts at n^k."""
    return [sum(c * _N ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(rows, 1)]


# Coefficients of the Krueger series (Krueger 1912, Karney 2011), by powers of the third flattening.
ALPHA = _series(
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
BETA = _series(
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
DELTA = _series(
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)


def pixel_to_geo(col: Column, row: Column, transform: tuple[float, ...], digits: int | None = None) -> tuple[Column, Column]:
    """x and y of a pixel's corner under (x0, x_res, row_rot, y0, col_rot, y_res)."""
    x0, xr, rr, y0, cr, yr = map(F.lit, map(float, transform))
    x, y = x0 + col * xr + row * rr, y0 + col * cr + row * yr
    return (round_half_up(x, digits), round_half_up(y, digits)) if digits is not None else (x, y)


def window_transform(transform: tuple[float, ...], col_off: Column, row_off: Column) -> Column:
    """The transform of a window: its origin moves, all else stays; an array in the same order."""
    x0, xr, rr, y0, cr, yr = map(F.lit, map(float, transform))
    return F.array(x0 + col_off * xr + row_off * rr, xr, rr, y0 + col_off * cr + row_off * yr, cr, yr)


def apply_transform(transform: Column, col: Column, row: Column) -> tuple[Column, Column]:
    t = [F.element_at(transform, i) for i in range(1, 7)]
    return t[0] + col * t[1] + row * t[2], t[3] + col * t[4] + row * t[5]


def geo_to_pixel(point: Column, transform: Column) -> Column:
    """[col, row] of a struct<x, y> under the inverse of (x0, x_res, row_rot, y0, col_rot, y_res)."""
    x0, xr, rr, y0, cr, yr = (F.element_at(transform, i) for i in range(1, 7))
    dx, dy, size = point["x"] - x0, point["y"] - y0, xr * yr - rr * cr
    return F.array((yr * dx - rr * dy) / size, (xr * dy - cr * dx) / size)


def bbox_ring(x1: Column, y1: Column, x2: Column, y2: Column, transform: Column, digits: int = 8) -> Column:
    """The closed ring of a box: (x1,y1), (x2,y1), (x2,y2), (x1,y2), (x1,y1)."""
    corners = ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))
    return F.array(*[F.array(*[round_half_up(v, digits) for v in apply_transform(transform, x, y)]) for x, y in corners])


def normalise_crs(crs: Column) -> Column:
    """EPSG text as it is, the code of an OGC URN, and WGS 84 for anything else."""
    upper = F.regexp_replace(F.upper(crs), r"\s+", "")
    code = F.regexp_extract(upper, r"URN:OGC:DEF:CRS:EPSG:.*:(\d+)", 1)
    return F.when(F.coalesce(crs, F.lit("")) == "", F.lit(DEFAULT_CRS)).when(upper.startswith("EPSG:"), upper).when(code != "", F.concat(F.lit("EPSG:"), code)).otherwise(F.lit(DEFAULT_CRS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2)


def utm_to_wgs84(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """struct<lng, lat> by the inverse series; six terms, no iteration."""
    north = F.when(south, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(BETA, 1):
            xi = xi - b * F.sin(p["xi"] * 2 * j) * F.cosh(p["eta"] * 2 * j)
            eta = eta - b * F.cos(p["xi"] * 2 * j) * F.sinh(p["eta"] * 2 * j)
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def sphere(p: Column) -> Column:
        return F.struct(F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))).alias("lam"), F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"))

    def ellipsoid(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(DELTA, 1):
            lat = lat + d * F.sin(p["chi"] * 2 * j)
        return F.struct((zone * 6 - 183 + p["lam"]).alias("lng"), F.degrees(lat).alias("lat"))

    start = F.struct(((y - north) / (K0 * _RADIUS)).alias("xi"), ((x - FALSE_EASTING) / (K0 * _RADIUS)).alias("eta"))
    return _let(_let(_let(start, plane), sphere), ellipsoid)


def wgs84_to_utm(lng: Column, lat: Column, zone: Column, south: Column) -> Column:
    """struct<x, y> by the forward series."""
    north = F.when(south, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))

    def plane(p: Column) -> Column:
        tau = F.sinh(F.atanh(F.sin(p["phi"])) - _E * F.atanh(_E * F.sin(p["phi"])))
        return F.struct(tau.alias("tau"), F.sin(p["lam"]).alias("s"), F.cos(p["lam"]).alias("c"))

    def sphere(p: Column) -> Column:
        return F.struct(F.atan2(p["tau"], p["c"]).alias("xi"), F.asinh(p["s"] / F.sqrt(p["tau"] * p["tau"] + p["c"] * p["c"])).alias("eta"))

    def ellipsoid(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, a in enumerate(ALPHA, 1):
            xi = xi + a * F.sin(p["xi"] * 2 * j) * F.cosh(p["eta"] * 2 * j)
            eta = eta + a * F.cos(p["xi"] * 2 * j) * F.sinh(p["eta"] * 2 * j)
        return F.struct((eta * (K0 * _RADIUS) + FALSE_EASTING).alias("x"), (xi * (K0 * _RADIUS) + north).alias("y"))

    start = F.struct(F.radians(lat).alias("phi"), F.radians(lng - (zone * 6 - 183)).alias("lam"))
    return _let(_let(_let(start, plane), sphere), ellipsoid)


def code_of(crs: Column) -> Column:
    """The EPSG number of a system, 99999 for one that isn't known; it is cheaper to ask once for a row than for each point."""
    return F.try_to_number(F.regexp_extract(normalise_crs(crs), r"^EPSG:(\d{4,5})$", 1), F.lit("99999")).cast("int")


def to_wgs84(x: Column, y: Column, crs: Column) -> Column:
    """struct<lng, lat>; a system that isn't known leaves the numbers as they are."""
    return _to_wgs84(x, y, code_of(crs))


def _to_wgs84(x: Column, y: Column, code: Column) -> Column:
    zone, south = F.pmod(code, F.lit(100)), code.between(32701, 32760)
    pair = lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"))
    return F.when(code == 3857, pair(mercator_to_wgs84(x, y))).when(code.between(32601, 32660) | south, utm_to_wgs84(x, y, zone, south)).otherwise(pair((x, y)))


def from_wgs84(lng: Column, lat: Column, crs: Column) -> Column:
    """struct<x, y> in a system; one that isn't known leaves the numbers as they are."""
    return _from_wgs84(lng, lat, code_of(crs))


def _from_wgs84(lng: Column, lat: Column, code: Column) -> Column:
    zone, south = F.pmod(code, F.lit(100)), code.between(32701, 32760)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mercator = pair(F.radians(lng) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A)
    return F.when(code == 3857, mercator).when(code.between(32601, 32660) | south, wgs84_to_utm(lng, lat, zone, south)).otherwise(pair(lng, lat))


def reproject(x: Column, y: Column, crs: Column, to: Column) -> Column:
    """struct<x, y> of a point in another system; in the same one it stays as it is, to the last digit."""
    return reproject_codes(x, y, code_of(crs), code_of(to), normalise_crs(crs) == normalise_crs(to))


def reproject_codes(x: Column, y: Column, code: Column, to: Column, same: Column) -> Column:
    """reproject by numbers of code_of, ``same`` saying that both are one system."""
    there = _let(_to_wgs84(x, y, code), lambda p: _from_wgs84(p["lng"], p["lat"], to))
    return F.when(same, F.struct(x.alias("x"), y.alias("y"))).otherwise(there)


def move_points(x: np.ndarray, y: np.ndarray, code: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """reproject_codes for many points of one pair of systems at a time, inside a task: expressions on arrays of points aren't compiled."""
    utm = lambda c: 32601 <= c <= 32660 or 32701 <= c <= 32760
    north = lambda c: FALSE_NORTHING if c > 32700 else 0.0
    scale = K0 * _RADIUS
    if code == 3857:
        lng, lat = np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - math.pi / 2)
    elif utm(code):
        xi, eta = (y - north(code)) / scale, (x - FALSE_EASTING) / scale
        xi1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
        eta1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
        chi = np.arcsin(np.sin(xi1) / np.cosh(eta1))
        lng = code % 100 * 6 - 183 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1)))
        lat = np.degrees(chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)))
    else:
        lng, lat = x, y
    if to == 3857:
        return np.radians(lng) * A, np.log(np.tan(np.radians(lat) / 2 + math.pi / 4)) * A
    if not utm(to):
        return lng, lat
    phi, lam = np.radians(lat), np.radians(lng - (to % 100 * 6 - 183))
    tau = np.sinh(np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi)))
    xi, eta = np.arctan2(tau, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(tau, np.cos(lam)))
    xi1 = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    eta1 = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return eta1 * scale + FALSE_EASTING, xi1 * scale + north(to)


def move_rings(rows: DataFrame, ring: str, code: str, to: str, same: str) -> DataFrame:
    """``rows`` with the rings (arrays of [x, y]) in another system, by columns with the numbers of code_of; other columns pass through."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch[ring]
            points, n = rings.flatten(), pc.fill_null(pc.list_value_length(rings), 0).to_numpy()
            xy = [pc.list_element(points, k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)] if len(points) else [np.zeros(0)] * 2
            pair = np.stack([pc.fill_null(batch[c].cast(pa.int64()), 0).to_numpy() for c in (code, to)] + [pc.fill_null(batch[same], False).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            kinds, at = np.unique(pair, axis=0, return_inverse=True)
            at = np.repeat(at.ravel(), n)
            with np.errstate(all="ignore"):  # what has no place in a system is no number there
                for k, (a, b, stays) in enumerate(kinds):
                    own = np.flatnonzero(at == k)
                    if not stays and len(own):
                        xy[0][own], xy[1][own] = move_points(xy[0][own], xy[1][own], int(a), int(b))
            pairs = pa.ListArray.from_arrays(np.arange(len(points) + 1, dtype=np.int32) * 2, pa.array(np.stack(xy, axis=1).ravel()))
            moved = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pairs, mask=rings.is_null() if rings.null_count else None)
            yield batch.set_column(batch.schema.get_field_index(ring), ring, moved)

    return rows.mapInArrow(run, fields)


def crs_of_wkt(wkt: Column) -> Column:
    """The system that a .prj text names: its own EPSG code, a UTM zone on WGS 84, web Mercator or WGS 84."""
    own = F.regexp_extract(wkt, r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]\]\s*$', 1)
    zone, side = F.regexp_extract(wkt, r"(?i)^PROJCS\[.WGS[_ ]*(?:19)?84[ _/]*UTM[_ ]zone[_ ](\d+)([NS])", 1), F.upper(F.regexp_extract(wkt, r"(?i)UTM[_ ]zone[_ ]\d+([NS])", 1))
    utm = F.concat(F.lit("EPSG:32"), F.when(side == "S", "7").otherwise("6"), F.lpad(zone, 2, "0"))
    named = F.when(own != "", F.concat(F.lit("EPSG:"), own)).when(zone != "", utm).when(wkt.rlike("(?i)^PROJCS.*(pseudo|auxiliary|web).?mercator|auxiliary_sphere"), F.lit("EPSG:3857"))
    return F.coalesce(named, F.lit(DEFAULT_CRS))


def with_wgs84(df: DataFrame, x: Column, y: Column, crs: Column) -> DataFrame:
    """Adds lng and lat. The steps are columns of their own, so each is computed once and in generated code."""
    code, south = F.col("_code"), F.col("_code").between(32701, 32760)
    rows = df.withColumns({"_x": x, "_y": y, "_code": code_of(crs)})
    north = F.when(south, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_xi": (F.col("_y") - north) / (K0 * _RADIUS), "_eta": (F.col("_x") - FALSE_EASTING) / (K0 * _RADIUS)})
    xi, eta = F.col("_xi"), F.col("_eta")
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(F.col("_xi") * 2 * j) * F.cosh(F.col("_eta") * 2 * j)
        eta = eta - b * F.cos(F.col("_xi") * 2 * j) * F.sinh(F.col("_eta") * 2 * j)
    utm = code.between(32601, 32660) | south
    rows = rows.withColumns({"_xi1": F.when(utm, xi), "_eta1": F.when(utm, eta)})
    rows = rows.withColumns({"_lam": F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))), "_chi": F.asin(F.sin("_xi1") / F.cosh("_eta1"))})
    lat = F.col("_chi")
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(F.col("_chi") * 2 * j)
    mx, my = mercator_to_wgs84(F.col("_x"), F.col("_y"))
    pick = lambda mercator, own, as_is: F.when(code == 3857, mercator).when(utm, own).otherwise(as_is)
    placed = rows.withColumns({"lng": pick(mx, F.pmod(code, F.lit(100)) * 6 - 183 + F.col("_lam"), F.col("_x")), "lat": pick(my, F.degrees(lat), F.col("_y"))})
    return placed.drop("_x", "_y", "_code", "_xi", "_eta", "_xi1", "_eta1", "_lam", "_chi")


def ring_to_lat_lng(ring: Column, crs: Column) -> Column:
    """[[lat, lng], ...] of a ring of [x, y]."""

    there = F.transform(ring, lambda p: to_wgs84(p[0], p[1], crs))
    return F.transform(there, lambda t: F.array(t["lat"], t["lng"]))


def bounds_to_lat_lng(left: Column, bottom: Column, right: Column, top: Column, crs: Column) -> Column:
    """[[minLat, minLng], [maxLat, maxLng]] from two corners; null without bounds."""
    low, high = to_wgs84(left, bottom, crs), to_wgs84(right, top, crs)
    box = F.array(F.array(low["lat"], low["lng"]), F.array(high["lat"], high["lng"]))
    return F.when(left.isNotNull() & bottom.isNotNull() & right.isNotNull() & top.isNotNull(), box)


def map_zoom(bounds: Column) -> Column:
    """How close a map starts: near where there are bounds, far else."""
    return F.when(bounds.isNull(), MAP_ZOOM[1]).otherwise(MAP_ZOOM[0])


def centre_of(bounds: Column) -> Column:
    """[lat, lng] in the middle of bounds, or the default centre."""
    middle = F.array((bounds[0][0] + bounds[1][0]) / 2, (bounds[0][1] + bounds[1][1]) / 2)
    return F.when(bounds.isNull(), F.array(*map(F.lit, DEFAULT_CENTRE))).otherwise(middle)

