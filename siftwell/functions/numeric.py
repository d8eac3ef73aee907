"""Column helpers: safe numbers, min-max scaling, vectors and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def finite(x: Column) -> Column:
    """``x`` as a double, null where it is null, NaN or infinite, or doesn't parse."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(float(default)))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def minmax(x: Column, by: list[str] | None = None, constant: str = "zero") -> Column:
    """``x`` scaled to 0..1 over the rows of ``by`` (all rows if none).

    Bounds come from finite values. NaN and minus infinity become 0, plus
    infinity 1. Where all finite values are equal the result is 0, or the value
    clipped to 0..1 if ``constant`` is "clip".
    """
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return scaled(x, F.min(finite(x)).over(w), F.max(finite(x)).over(w), constant)


def scaled(x: Column, low: Column, high: Column, constant: str = "zero") -> Column:
    """``x`` between known bounds; what ``minmax`` does where the bounds come from an aggregation."""
    d = x.cast("double")
    flat = clip01(d) if constant == "clip" else F.lit(0.0)
    inner = F.when(high - low <= EPSILON, flat).otherwise(clip01((d - low) / (high - low)))
    return F.when(d == float("inf"), 1.0).when(finite(x).isNull() | low.isNull(), 0.0).otherwise(inner)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` divided by its length, at least 1e-12."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(EPSILON))), lambda n: F.transform(a, lambda x: x / n))[0]


def stable_random(*key: Column) -> Column:
    """A draw in 0..1 from the SHA-256 of the key's parts joined by colons: 12 hex digits over their largest value."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[k.cast("string") for k in key]), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))


def when_any(*rules: tuple[Column, str], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(default) if out is None else out.otherwise(default)
