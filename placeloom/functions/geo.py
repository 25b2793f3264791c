"""Geometry as Column expressions: coordinates are (lon, lat) doubles, rings arrays of structs (x, y)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean Earth radius in metres, metres in a degree of latitude, WGS84 axes.
EARTH_M, DEGREE_M = 6_371_008.8, 111_320.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def valid_lon(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(-180.0, 180.0)


def valid_lat(y: Column) -> Column:
    return y.isNotNull() & ~F.isnan(y) & y.between(-90.0, 90.0)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def degree_radius(metres: Column, lat: Column) -> Column:
    """A radius in metres as degrees that cover it at this latitude, however near the pole."""
    return metres / (DEGREE_M * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))


def in_box(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Inclusive edges; a box that crosses the antimeridian holds nothing."""
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def boxes_overlap(a0, b0, a1, b1, c0, d0, c1, d1) -> Column:
    return (a0 <= c1) & (a1 >= c0) & (b0 <= d1) & (b1 >= d0)


def _sides(ring: Column, test) -> Column:
    """The sides of a ring (closed by itself) that pass test(p, q)."""
    return F.filter(F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda s: test(s["p"], s["q"]))


def on_edge(ring: Column, x: Column, y: Column) -> Column:
    def test(p, q):
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.size(_sides(ring, test)) > 0


def _crossed(ring: Column, x: Column, y: Column) -> Column:
    def test(p, q):
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0)) + p["x"])

    return F.size(_sides(ring, test)) % 2 == 1


def within(ring: Column, x: Column, y: Column) -> Column:
    """Inside, the boundary excluded."""
    return _crossed(ring, x, y) & ~on_edge(ring, x, y)


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Inside, the boundary included."""
    return _crossed(ring, x, y) | on_edge(ring, x, y)


def path_length_m(points: Column) -> Column:
    """Sum of great-circle lengths over an array of structs (lon, lat)."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda t, d: t + d))


def overlap_area(a0, b0, a1, b1, c0, d0, c1, d1) -> Column:
    """Area shared by two boxes; 0 if none."""
    return F.greatest(F.least(a1, c1) - F.greatest(a0, c0), F.lit(0)) * F.greatest(F.least(b1, d1) - F.greatest(b0, d0), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])))
def decode_polyline6(shapes: pd.Series) -> pd.Series:
    """Encoded polylines of six decimals; null for null or broken input."""

    def one(shape):
        if shape is None:
            return None
        numbers, value, shift = [], 0, 0
        for c in shape.encode():
            value |= (c - 63 & 31) << shift
            shift += 5
            if c - 63 < 32:
                numbers.append(~(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
        if shift or len(numbers) % 2:
            return None
        steps = np.cumsum(np.array(numbers, np.int64).reshape(-1, 2), axis=0)
        return [{"lon": x / 1e6, "lat": y / 1e6} for y, x in steps.tolist()]

    return shapes.map(one)


@F.pandas_udf(T.DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Vincenty's inverse on WGS84; antipodal pairs that do not converge fall back on the mean sphere."""
    b = (1 - WGS84_F) * WGS84_A
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
    span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    span = (span + math.pi) % (2 * math.pi) - math.pi
    lam, done = span.copy(), np.zeros(len(span), bool)
    for _ in range(200):
        sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(np.cos(u1) * np.cos(u2) * np.sin(lam), sin_s, out=np.zeros_like(sin_s), where=sin_s != 0)
        cos2_a = 1 - sin_a**2
        cos_2m = cos_s - np.divide(2 * np.sin(u1) * np.sin(u2), cos2_a, out=np.zeros_like(cos_s), where=cos2_a != 0)
        cos_2m = np.where(cos2_a == 0, 0.0, cos_2m)
        c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
        new = span + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
        done = np.abs(new - lam) < 1e-12
        lam = new
        if done.all():
            break
    w = cos2_a * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    big_b = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    extra = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    flat = EARTH_M * np.arctan2(np.hypot(np.cos(u2) * np.sin(span), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(span)), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(span))
    return pd.Series(np.where(done, b * big_a * (sigma - extra), flat))
