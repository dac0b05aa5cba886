"""Column expressions of the domain: interpolation, weights, phases, vectors.

All are plain expressions of built-in functions, so they stay inside
whole-stage code generation. Missing values are null, never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (the session may run in ANSI mode)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def linear(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Value at t on the segment (t0, v0)-(t1, v1); the ends clamp, a null end
    means there is none on that side."""
    slope = (v1 - v0) / F.nullif(t1 - t0, F.lit(0.0))
    return F.when(t0.isNull(), v1).when(t1.isNull() | (t0 == t), v0).otherwise(v0 + (t - t0) * F.coalesce(slope, F.lit(0.0)))


def interpolate(values: Column, position: Column) -> Column:
    """Linear interpolation of an array at a fractional 0-based index, clamped."""
    n = F.size(values)
    p = F.least(F.greatest(position, F.lit(0.0)), (n - 1).cast("double"))
    low = F.least(F.floor(p).cast("int"), F.greatest(n - 2, F.lit(0)))
    part = p - low
    a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
    return a * (1 - part) + b * part


def wrap(step: Column, spacing: Column) -> Column:
    """A step brought into [-spacing/2, spacing/2) by whole spacings."""
    return F.pmod(step + spacing / 2, spacing) - spacing / 2


def parabola(left: Column, mid: Column, right: Column, rule: str = "nonzero") -> Column:
    """Offset of a peak from its sample, in samples, within half a sample.

    ``rule`` is "nonzero" (any curvature) or "concave" (only a true maximum).
    """
    den = left - 2 * mid + right
    ok = den < 0 if rule == "concave" else F.abs(den) > 1e-6
    return F.when(ok, clip(0.5 * (left - right) / F.nullif(den, F.lit(0.0)), -0.5, 0.5)).otherwise(F.lit(0.0))


def radius(y: Column, x: Column, axis_y: Column, axis_x: Column) -> Column:
    return F.sqrt((y - axis_y) * (y - axis_y) + (x - axis_x) * (x - axis_x))


def sector(dy: Column, dx: Column, degrees: int = 90) -> Column:
    """Which sector of so many degrees, from +x towards +y, a direction is in."""
    return F.floor(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)) / degrees).cast("int")


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def trilinear_weight(fraction: Column, corner: Column) -> Column:
    """The factor of one axis: f at the far corner (1), 1 - f at the near one."""
    return F.when(corner == 1, fraction).otherwise(1 - fraction)


def decode_signed(value: Column) -> Column:
    """A byte to [-1, 1]; 0 is missing."""
    return F.when(value == 0, None).otherwise((value - 128) / F.lit(127.0))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights of offsets -r..r, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)] if sigma > 0 else [1.0]
    return [w / sum(raw) for w in raw]


def reflect_index(i: Column, n: Column) -> Column:
    """An index outside [0, n) mirrored at the array's ends, ends repeated."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def smooth_array(values: Column, sigma: float, edge: str = "reflect") -> Column:
    """Gaussian smoothing of an array column; ``edge`` is reflect or nearest."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2

    def at(a: Column, i: Column) -> Column:
        n = F.size(a)
        j = reflect_index(i, n) if edge == "reflect" else F.least(F.greatest(i, F.lit(0)), n - 1)
        return F.get(a, j)

    def smooth(a: Column) -> Column:
        total = lambda i: sum((w * at(a, i + (k - r)) for k, w in enumerate(kernel)), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), total)

    return F.transform(F.array(values), smooth)[0]


def binomial_se(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / F.nullif(n.cast("double"), F.lit(0.0)))


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; nulls are left out."""
    return F.avg(condition.cast("int").cast("double"))
