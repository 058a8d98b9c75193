"""Sea water and layer depths, as column expressions (EOS-80)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import let


def pressure_from_depth(depth: Column, lat: Column) -> Column:
    """Decibars by Saunders (1981); 7500.004 at 7321.45 m and 30 degrees."""
    s = F.sin(F.abs(lat) * F.lit(3.141592654 / 180.0))
    # Coefficients of the published formula.
    c = 1.0 - (5.92e-3 + s * s * 5.25e-3)
    return (c - F.sqrt(c * c - 8.84e-6 * depth)) / 4.42e-6


def lapse_rate(salt: Column, temp: Column, pressure: Column) -> Column:
    """Adiabatic change of temperature by pressure, degrees per decibar (Bryden 1973)."""
    # Published coefficients, lowest power of temperature first.
    by_temp = (3.5803e-5, 8.5258e-6, -6.836e-8, 6.6228e-10)
    by_salt = (1.8932e-6, -4.2393e-8)
    by_pressure = (1.8741e-8, -6.7795e-10, 8.733e-12, -5.4481e-14)
    by_salt_pressure = (-1.1351e-10, 2.7759e-12)
    by_square = (-4.6206e-13, 1.8676e-14, -2.1687e-16)
    s = salt - 35.0

    def poly(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = out * temp + F.lit(c)
        return out

    return poly(by_temp) + poly(by_salt) * s + (poly(by_pressure) + poly(by_salt_pressure) * s + poly(by_square) * pressure) * pressure


def potential_temperature(salt: Column, temp: Column, pressure: Column, reference: Column) -> Column:
    """Temperature moved adiabatically to ``reference`` by one Runge-Kutta-Gill step for each 1000 decibars begun (Fofonoff 1977)."""
    root = math.sqrt(0.5)
    apart = reference - pressure
    steps = F.floor(F.abs(apart) / 1000.0) + 1

    def advance(state: Column, _: Column) -> Column:
        t, p, h = state["t"], state["p"], state["h"]
        rate = lambda temp_, at: h * let(temp_, lambda x: lapse_rate(salt, x, at))
        third = lambda y: let(rate(y["t"], p + h), lambda k4: F.struct((y["t"] + (k4 - 2 * y["q"]) / 6.0).alias("t"), (p + h).alias("p"), h.alias("h")))
        second = lambda x, k3: let(F.struct((x["t"] + (1 + root) * (k3 - x["q"])).alias("t"), ((2 + 2 * root) * k3 - (3 * root + 2) * x["q"]).alias("q")), lambda y: third(y))
        first = lambda k1, k2: let(
            F.struct((t + 0.5 * k1 + (1 - root) * (k2 - k1)).alias("t"), ((2 - 2 * root) * k2 + (3 * root - 2) * k1).alias("q")),
            lambda x: let(rate(x["t"], p + 0.5 * h), lambda k3: second(x, k3)),
        )
        return let(rate(t, p), lambda k1: let(rate(t + 0.5 * k1, p + 0.5 * h), lambda k2: first(k1, k2)))

    start = F.struct(temp.cast("double").alias("t"), pressure.cast("double").alias("p"), (apart / steps).cast("double").alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, advance)["t"]


def in_situ_temperature(salt: Column, theta: Column, pressure: Column) -> Column:
    """The inverse: from potential temperature at the surface."""
    return potential_temperature(salt, theta, F.lit(0.0), pressure)


def terrain_depths(zeta: Column, bottom: Column, levels: int, theta_b: float = 0.6, theta_s: float = 5.0, critical: float = 10.0) -> Column:
    """Depths of the levels of a stretched terrain-following coordinate, the uppermost at 0."""
    first, second = 1.0 / math.sinh(theta_s), 0.5 / math.tanh(0.5 * theta_s)

    def depth(k: int) -> Column:
        s = (k - levels - 0.5) / levels
        c = (1.0 - theta_b) * first * math.sinh(theta_s * s) + theta_b * (second * math.tanh(theta_s * (s + 0.5)) - 0.5)
        return zeta + (zeta + bottom) * (critical * s + c * bottom) / (bottom + critical)

    top = depth(levels)
    return F.array(*[depth(k) - top for k in range(1, levels + 1)])


def mixed_layer_by_buoyancy(levels: Column, critical: float = 0.0003) -> Column:
    """Depth where buoyancy first reaches ``critical``, by linear interpolation; the deepest level if it never does.

    ``levels`` is an array of struct(depth, buoyancy), top first.
    """
    pairs = F.zip_with(F.slice(levels, 1, F.size(levels) - 1), F.slice(levels, 2, F.size(levels) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.try_element_at(F.filter(pairs, lambda p: p["b"]["buoyancy"] >= critical), F.lit(1))
    a, b = first["a"], first["b"]
    at = a["depth"] + (b["depth"] - a["depth"]) * (critical - a["buoyancy"]) / (b["buoyancy"] - a["buoyancy"])
    return F.when(F.size(levels) < 1, 0.0).otherwise(F.coalesce(at, F.try_element_at(levels, F.lit(-1))["depth"]))
