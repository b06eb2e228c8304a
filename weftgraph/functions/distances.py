"""Distances between array<double> columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def lp_distance(x: Column, y: Column, p: float) -> Column:
    return F.pow(_fold(F.zip_with(x, y, lambda a, b: F.pow(F.abs(b - a), F.lit(float(p))))), F.lit(1.0 / p))


def euclidean_distance(x: Column, y: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(x, y, lambda a, b: (b - a) * (b - a))))


def maximum_distance(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(b - a)))


def angular_distance(x: Column, y: Column) -> Column:
    """Between points of a sphere given by angles: the first n-1 in [0, pi], the last a longitude."""
    n = F.size(x)
    cos_part = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            F.when(i < n, a["c"] + a["s"] * F.cos(F.element_at(x, i)) * F.cos(F.element_at(y, i))).otherwise(a["c"] + a["s"] * F.cos(F.element_at(x, i) - F.element_at(y, i))).alias("c"),
            (a["s"] * F.sin(F.element_at(x, i)) * F.sin(F.element_at(y, i))).alias("s"),
        ),
        lambda a: a["c"],
    )
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_part)))


def polar_hyperbolic_distance(x: Column, y: Column) -> Column:
    """Points as (radius, angles...)."""
    a, b = F.element_at(x, 1), F.element_at(y, 1)
    angle = F.cos(angular_distance(F.slice(x, 2, F.size(x) - 1), F.slice(y, 2, F.size(y) - 1)))
    return F.acosh(F.greatest(F.lit(1.0), F.cosh(a) * F.cosh(b) - F.sinh(a) * F.sinh(b) * angle))


def hyperboloid_hyperbolic_distance(x: Column, y: Column) -> Column:
    """Points of the hyperboloid by all coordinates but the time-like one."""
    dot = _fold(F.zip_with(x, y, lambda a, b: a * b))
    return F.acosh(F.greatest(F.lit(1.0), F.sqrt(1 + _fold(F.transform(x, lambda a: a * a))) * F.sqrt(1 + _fold(F.transform(y, lambda a: a * a))) - dot))
