"""From metres of the national grid back to degrees, in columns only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.operators.geometry import AIRY, GRID, SHIFT, WGS84, _let

#: Rounds in which a latitude settles, each to about a hundredth of the error before.
ROUNDS = 8


def _shift_back() -> tuple[np.ndarray, np.ndarray]:
    """(matrix, translation): the seven-parameter shift solved for its argument, once, as constants."""
    second = math.pi / 180 / 3600
    rx, ry, rz, scale = SHIFT["rx"] * second, SHIFT["ry"] * second, SHIFT["rz"] * second, 1 + SHIFT["s"]
    return np.linalg.inv(np.array([[scale, -rz, ry], [rz, scale, -rx], [-ry, rx, scale]])), np.array([SHIFT["tx"], SHIFT["ty"], SHIFT["tz"]])


def to_degrees(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with latitude and longitude (WGS 84) of their grid metres: the way back of geometry.to_national_grid.

    The transverse Mercator is undone by its series, with the terms in the ellipsoid's second eccentricity that the grid's own
    guide leaves out, the shift by solving its three equations. There and back agree within half a millimetre over the
    country, which is what the grid's own forward series leaves open. Null coordinates give null degrees.
    """
    a, b = AIRY
    e2, n, f0, lat0 = (a * a - b * b) / (a * a), (a - b) / (a + b), GRID["f0"], math.radians(GRID["lat0"])

    def arc(phi: Column) -> Column:
        """Metres along the meridian from the grid's origin."""
        d, t = phi - lat0, phi + lat0
        return b * f0 * (
            (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d
            - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(t)
            + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * t)
            - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
        )

    def foot(v: Column) -> Column:
        """The latitude whose arc is the northing."""
        north = v["y"] - GRID["n0"]
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), lat0 + north / (a * f0), lambda p, _: p + (north - arc(p)) / (a * f0))
        return F.struct(phi.alias("phi"), (v["x"] - GRID["e0"]).alias("e"))

    def curved(v: Column) -> Column:
        phi = v["phi"]
        curve = 1 - e2 * F.sin(phi) * F.sin(phi)
        each = {"phi": phi, "e": v["e"], "t": F.tan(phi), "sec": 1 / F.cos(phi), "nu": a * f0 / F.sqrt(curve), "rho": a * f0 * (1 - e2) / F.pow(curve, F.lit(1.5))}
        return F.struct(*[c.alias(k) for k, c in each.items()])

    def geodetic(v: Column) -> Column:
        """Latitude and longitude on the grid's own ellipsoid."""
        e, t2, nu, rho, k = v["e"], v["t"] * v["t"], v["nu"], v["rho"], v["nu"] / v["rho"] - 1
        step = e / nu
        down = v["t"] * nu / (2 * rho) * step**2 - v["t"] * nu / (24 * rho) * (5 + 3 * t2 + k - 9 * t2 * k) * step**4 + v["t"] * nu / (720 * rho) * (61 + 90 * t2 + 45 * t2 * t2) * step**6
        east = step - (nu / rho + 2 * t2) * step**3 / 6 + (5 + 28 * t2 + 24 * t2 * t2 + 6 * k + 8 * k * t2) * step**5 / 120 - (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2) * step**7 / 5040
        return F.struct((v["phi"] - down).alias("phi"), (math.radians(GRID["lon0"]) + v["sec"] * east).alias("lam"))

    def earth_centred(v: Column, height: Column) -> Column:
        nu = F.lit(a) / F.sqrt(1 - e2 * F.sin(v["phi"]) * F.sin(v["phi"]))
        out = (nu + height) * F.cos(v["phi"])
        return F.struct((out * F.cos(v["lam"])).alias("x"), (out * F.sin(v["lam"])).alias("y"), ((nu * (1 - e2) + height) * F.sin(v["phi"])).alias("z"))

    back, moved = _shift_back()

    def shifted(v: Column) -> Column:
        off = [v[c] - float(m) for c, m in zip("xyz", moved)]
        return F.struct(*[sum((float(back[i][j]) * off[j] for j in range(3)), F.lit(0.0)).alias("xyz"[i]) for i in range(3)])

    def on_wgs84(v: Column) -> Column:
        wa, wb = WGS84
        we2 = (wa * wa - wb * wb) / (wa * wa)
        p = F.hypot(v["x"], v["y"])
        nu = lambda phi: F.lit(wa) / F.sqrt(1 - we2 * F.sin(phi) * F.sin(phi))
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.atan2(v["z"], p * (1 - we2)), lambda q, _: F.atan2(v["z"] + we2 * nu(q) * F.sin(q), p))
        return _let(F.struct(phi.alias("phi"), p.alias("p"), v["y"].alias("y"), v["x"].alias("x")), placed)

    def placed(v: Column) -> Column:
        wa, wb = WGS84
        nu = F.lit(wa) / F.sqrt(1 - (wa * wa - wb * wb) / (wa * wa) * F.sin(v["phi"]) * F.sin(v["phi"]))
        return F.struct(F.degrees(v["phi"]).alias("latitude"), F.degrees(F.atan2(v["y"], v["x"])).alias("longitude"), (v["p"] / F.cos(v["phi"]) - nu).alias("height"))

    def level(v: Column) -> Column:
        """With the height above the grid's ellipsoid at which a place lies on the other one: the grid is made from such places."""
        other = _let(_let(earth_centred(v, F.lit(0.0)), shifted), on_wgs84)
        return F.struct(v["phi"].alias("phi"), v["lam"].alias("lam"), (-other["height"]).alias("h"))

    at = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for step in (foot, curved, geodetic, level, lambda v: earth_centred(v, v["h"]), shifted, on_wgs84):
        at = _let(at, step)
    return points.withColumn("_at", at).withColumns({"latitude": F.col("_at.latitude"), "longitude": F.col("_at.longitude")}).drop("_at")
