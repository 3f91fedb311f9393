"""Column functions over numbers, arrays and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digitise(x: Column, edges: list[float], below: str = "keep") -> Column:
    """Number of edges not above x, less one (left-closed bins; -1 below the first edge).
    ``below``: keep, or last / extra: -1 becomes the last bin or one more. Null and NaN give null."""
    names = F.array(*[F.lit(float(e)) for e in edges])
    k = F.size(F.filter(names, lambda e: e <= x)) - 1
    if below != "keep":
        k = F.when(k == -1, len(edges) - 1 + (below == "extra")).otherwise(k)
    return F.when(x.isNotNull() & ~F.isnan(x), k)


def band(separation: Column, edges: tuple[int, ...] = (24, 12, 6)) -> Column:
    """0 for the widest band, then one more for each narrower one; -1 below the last edge."""
    out = None
    for i, e in enumerate(edges):
        out = F.when(F.abs(separation) >= e, i) if out is None else out.when(F.abs(separation) >= e, i)
    return out.otherwise(-1)


def access_class(value: Column, low: int = 10, high: int = 43, missing: int = 45) -> Column:
    v = F.coalesce(value, F.lit(missing))
    return F.when(v <= low, 0).when(v <= high, 1).otherwise(2)


def location(d: Column, scale: float = 50.0) -> Column:
    return F.least(F.lit(1.0), F.abs(d) / scale)


def cube_root(d: Column) -> Column:
    return F.cbrt(F.abs(d).cast("double"))


def log_feature(d: Column) -> Column:
    return F.log10(F.greatest(F.lit(1.0), F.abs(d).cast("double")))


def inverse(d: Column) -> Column:
    return 1.0 / (1.0 + F.abs(d))


def inverse_root(d: Column) -> Column:
    return 1.0 / F.sqrt(1.0 + F.abs(d))


def gyration(n: Column, unit: int = 100, floor: bool = False) -> Column:
    """Estimated radius of n residues; ``floor`` counts whole units only."""
    share = F.floor(n / unit) if floor else n / F.lit(float(unit))
    return 0.395 * F.pow(share * 100.0, F.lit(0.6)) + 7.257


def clipped_log(d: Column) -> Column:
    return F.log(F.greatest(d, F.lit(math.exp(-1))))


def below_cutoff(prob: Column, bins: int) -> Column:
    """Probability of the first ``bins`` bins."""
    return F.aggregate(F.slice(prob, 1, bins), F.lit(0.0), lambda s, x: s + x)


def contact(d: Column, cutoff: float = 8.00001) -> Column:
    return ((d > 0) & (d < cutoff)).cast("int")


def label_one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == label).cast("int"))


def outer_product(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in array order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def wrap_degrees(a: Column) -> Column:
    """The same angle in (-180, 180]."""
    p = F.pmod(a, F.lit(360.0))
    return F.when(p > 180, p - 360).otherwise(p)


def circular_gap(a: Column, b: Column, turn: float = 2 * math.pi) -> Column:
    """Smaller way round between two angles."""
    d = F.pmod(F.abs(a - b), F.lit(turn))
    return F.least(d, turn - d)


def step_score(d: Column, steps: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0)) -> Column:
    """Share of the steps that a distance stays within."""
    return sum(((d <= s).cast("double") for s in steps), F.lit(0.0)) / len(steps)


def d0(n: Column) -> Column:
    """Length-dependent distance scale, half a unit at least."""
    return F.greatest(F.lit(0.5), 1.24 * F.cbrt(F.greatest(n - 15, F.lit(0)).cast("double")) - 1.8)


def tm_term(d: Column, n: Column) -> Column:
    return 1.0 / (1.0 + F.pow(d / d0(n), F.lit(2)))


def error_of_distance(d: Column, scale: float = 5.0) -> Column:
    return 1.0 / (1.0 + F.pow(d / scale, F.lit(2)))


def distance_of_error(s: Column, scale: float = 5.0) -> Column:
    return scale * F.sqrt(1.0 / s - 1.0)


def periodic_score(x: Column, x0: Column, k: Column, n: Column) -> Column:
    return 0.5 * k * (1 - F.cos(n * (x - x0)))


def power_scaled(p: Column, at: float = 0.23, to: float = 0.5) -> Column:
    """Power that takes ``at`` to ``to``."""
    return F.pow(p, F.lit(math.log(to) / math.log(at)))


def strength(d: Column, least: float = 2.0) -> Column:
    return F.when(d.isNull() | (d < 0), 0.0).otherwise(least / F.greatest(d, F.lit(least)))


def is_number(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def rounded_text(values: Column, digits: int = 4) -> Column:
    return F.concat_ws(" ", F.transform(values, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))))


def rotated(values: Column, by: int = 1) -> Column:
    """The last ``by`` elements first."""
    return F.when(F.size(values) <= by, values).otherwise(F.concat(F.slice(values, -by, by), F.slice(values, F.lit(1), F.size(values) - by)))


def half_shifted(values: Column) -> Column:
    """Mean of each element and the one before it, cyclically."""
    return F.zip_with(values, rotated(values), lambda x, y: (x + y) / 2)


def centred_potential(prob: Column, reference: Column, floor: float = 1e-12) -> Column:
    """Negative log of probability against reference, less its mean."""
    raw = F.zip_with(prob, reference, lambda p, r: -F.log(F.greatest(p, F.lit(floor)) / F.greatest(r, F.lit(floor))))
    mean = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x) / F.size(raw)
    return F.transform(raw, lambda x: x - mean)


def finite_ideal_reference(edges: list[float], alpha: float = 1.61) -> list[float]:
    """Reference shares of distance bins: the last edge's share scaled by (r / r_last) ** alpha and bin width."""
    mid = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    wide = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return [(m / mid[-1]) ** alpha * w / wide[-1] for m, w in zip(mid, wide, strict=True)]


def potential(prob: Column, reference: list[float], low: float = -30.0, high: float = 30.0, floor: float = 1e-12) -> Column:
    """-ln(p / (p_last * reference)), within bounds."""
    ref = F.array(*[F.lit(x) for x in reference])
    last = F.element_at(prob, -1)
    raw = lambda p, r: -F.log(F.greatest(p, F.lit(floor)) / F.greatest(last * r, F.lit(floor)))
    return F.zip_with(prob, ref, lambda p, r: F.least(F.lit(high), F.greatest(F.lit(low), raw(p, r))))


def spread(mid: list[float], prob: Column) -> Column:
    """Struct of mean, deviation, and deviations below and above the mean of a binned distribution."""
    m = F.array(*[F.lit(float(x)) for x in mid])
    total = lambda f: F.aggregate(F.zip_with(m, prob, f), F.lit(0.0), lambda s, x: s + x)
    weight = F.aggregate(prob, F.lit(0.0), lambda s, x: s + x)
    mean = total(lambda x, p: x * p) / weight
    side = lambda low: (
        F.aggregate(F.zip_with(m, prob, lambda x, p: F.when((x <= mean) if low else (x > mean), p * F.pow(x - mean, F.lit(2))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x),
        F.aggregate(F.zip_with(m, prob, lambda x, p: F.when((x <= mean) if low else (x > mean), p).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x),
    )
    (a, wa), (b, wb) = side(True), side(False)
    var = total(lambda x, p: p * F.pow(x - mean, F.lit(2))) / weight
    return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), F.sqrt(F.when(wa > 0, a / wa).otherwise(0.0)).alias("below"), F.sqrt(F.when(wb > 0, b / wb).otherwise(0.0)).alias("above"))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def inner(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def angle(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Angle at b, in radians."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner(u, v) / F.sqrt(inner(u, u) * inner(v, v)))))


def dihedral(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    """Signed angle between the planes abc and bcd, in radians."""
    u, v, w = minus(b, a), minus(c, b), minus(d, c)
    n, m = cross(u, v), cross(v, w)
    return F.atan2(inner(cross(n, m), v) / F.sqrt(inner(v, v)), inner(n, m))


def virtual_atom(n: list[Column], ca: list[Column], c: list[Column], k: tuple[float, float, float] = (-0.58273431, 0.56802827, -0.54067466)) -> list[Column]:
    """The side-chain carbon that an ideal residue has. Fixed values: ``k``."""
    b, v = minus(ca, n), minus(c, ca)
    a = cross(b, v)
    return [k[0] * x + k[1] * y + k[2] * z + o for x, y, z, o in zip(a, b, v, ca, strict=True)]
