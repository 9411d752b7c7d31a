"""Geometry: projection as column expressions; polygons as NumPy arrays of corners for the few steps that construct shapes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
A, FLATTENING, SCALE, EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing by the series in the third flattening (to its third power: millimetres inside a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * radius * east, SCALE * radius * north + (10_000_000.0 if south else 0.0)


def shoelace(p: np.ndarray) -> float:
    """Signed area, positive against the clock."""
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def holds(polygon: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points lie inside, by crossings of a ray to the right."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    straddles = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return (straddles & (x < cross)).sum(axis=1) % 2 == 1


def clipped(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one, cut side by side; empty if there is none."""
    if shoelace(convex) < 0:
        convex = convex[::-1]
    out = subject
    for p, q in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (q[0] - p[0]) * (out[:, 1] - p[1]) - (q[1] - p[1]) * (out[:, 0] - p[0])
        kept = []
        for k in range(len(out)):
            a, b, sa, sb = out[k - 1], out[k], side[k - 1], side[k]
            if (sa < 0) != (sb < 0):
                kept.append(a + (b - a) * (sa / (sa - sb)))
            if sb >= 0:
                kept.append(b)
        out = np.array(kept).reshape(-1, 2)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, against the clock."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(length, width) of the smallest rectangle around, which has a side along one of the hull's."""
    h = hull(points)
    best = (math.inf, 0.0, 0.0)
    for d in np.roll(h, -1, axis=0) - h:
        d = d / np.hypot(*d)
        u, v = h @ d, h @ np.array([-d[1], d[0]])
        a, b = float(np.ptp(u)), float(np.ptp(v))
        best = min(best, (a * b, max(a, b), min(a, b)))
    return best[1], best[2]
