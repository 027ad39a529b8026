"""Rounding, clamping, labels and divisions with one meaning in every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: floor(x * 10^digits + 0.5) / 10^digits, as a double."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def half_up_int(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def label(score: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The first label whose cut the score reaches."""
    out = F.lit(rest)
    for cut, name in reversed(cuts):
        out = F.when(score >= cut, F.lit(name)).otherwise(out)
    return out


def first_of(*cases: tuple[Column, object], rest: object = None) -> Column:
    """The value of the first condition that holds; a null condition does not hold."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(rest if isinstance(rest, Column) else F.lit(rest))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda binds it, so no rule of the optimizer repeats it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
