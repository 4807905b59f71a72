"""Column expressions over profiles: arrays of doubles in fraction order. "Undefined" is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 72


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, also where f uses it inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def fill_zero(a: Column) -> Column:
    """Nulls and NaNs become zeros."""
    return F.transform(a, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def support(a: Column) -> Column:
    """How many values are positive."""
    return F.size(F.filter(a, lambda x: x > 0))


def impute_gap(a: Column) -> Column:
    """A zero between two values that aren't zero becomes their mean; gaps of several stay."""

    def fill(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after = F.get(v, i - 1), F.get(v, i + 1)
            inside = (x == 0) & (i > 0) & (i < F.size(v) - 1) & (before != 0) & (after != 0)
            return F.when(inside, (before + after) / 2).otherwise(x)

        return F.transform(v, one)

    return let(a, fill)


def truncate(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def resample(a: Column, points: int = POINTS) -> Column:
    """Linear interpolation to ``points`` values on a grid without its end point; past the last value it stays level."""

    def at_points(v: Column) -> Column:
        size = F.size(v)

        def one(j: Column) -> Column:
            at = j * size / F.lit(float(points))
            i = F.floor(at).cast("int")
            low, high = F.get(v, i), F.get(v, i + 1)
            return F.when(i >= size - 1, F.get(v, size - 1)).otherwise(low + (high - low) * (at - i))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), one)

    return let(a, at_points)


def minmax(a: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """Scaled to lower..upper; a constant profile becomes all zeros."""

    def scaled(v: Column) -> Column:
        def by(ends: Column) -> Column:
            low, high = ends["low"], ends["high"]
            return F.transform(v, lambda x: F.when(high == low, F.lit(0.0)).otherwise(lower + (x - low) * (upper - lower) / (high - low)))

        return let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), by)

    return let(a, scaled)


def smooth(a: Column, sigma: float = 1.0) -> Column:
    """Gaussian kernel of radius 4 sigma, normalised; beyond its ends the profile is reflected, end values repeated."""
    import math

    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]

    def smoothed(v: Column) -> Column:
        size = F.size(v)

        def one(x: Column, i: Column) -> Column:
            parts = []
            for k, weight in zip(range(-radius, radius + 1), kernel, strict=True):
                at = F.pmod(i + k, 2 * size)
                parts.append(F.get(v, F.when(at < size, at).otherwise(2 * size - 1 - at)) * (weight / sum(kernel)))
            return sum(parts[1:], parts[0])

        return F.transform(v, one)

    return let(a, smoothed)


def argmax(a: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def local_maxima(a: Column) -> Column:
    """Positions of inner values above both neighbours, from 0."""

    def found(v: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(1), F.size(v) - 2), lambda i: (F.get(v, i) > F.get(v, i - 1)) & (F.get(v, i) > F.get(v, i + 1)))
        return F.when(F.size(v) >= 3, inner).otherwise(F.array().cast("array<int>"))

    return let(a, found)


def abs_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def peak_shift(p: Column, q: Column) -> Column:
    """Smallest distance between a peak of one and a peak of the other; NULL without peaks."""
    return let(q, lambda others: F.array_min(F.transform(p, lambda x: F.array_min(F.transform(others, lambda y: F.abs(x - y))))))


def common_peak(p: Column, q: Column) -> Column:
    """The last position that both have as a peak."""
    return F.array_max(F.array_intersect(p, q))


def cosine(a: Column, b: Column) -> Column:

    def of(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        square = lambda x: x * x
        return F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), F.sqrt(total(F.transform(a, square))) * F.sqrt(total(F.transform(b, square))))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def pearson(a: Column, b: Column) -> Column:
    """NULL if either is constant."""

    def centred(a: Column) -> Column:
        return let(a, lambda v: let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)))

    constant = (F.array_min(a) == F.array_max(a)) | (F.array_min(b) == F.array_max(b))
    return F.when(~constant, cosine(centred(a), centred(b)))


def fwhm(a: Column, fraction: float = 2.0) -> Column:
    """Positions from the first to the last value above maximum / fraction; NULL if there is none."""

    def over(v: Column) -> Column:
        at = let(F.array_max(v) / fraction, lambda level: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) > level))
        return let(at, lambda x: F.array_max(x) - F.array_min(x))

    return let(a, over)


def mean_if_positive(a: Column) -> Column:
    return F.when(total(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def renormalize(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return (to_high - to_low) * (x - low) / (high - low) + to_low


def power_scale(x: Column, first: Column, second: Column, factor: float) -> Column:
    return F.pow(F.try_divide(x - second, first - second), F.lit(factor))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct members over the length of the longer list."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b)))


def normalize(a: Column, points: int = POINTS, keep: int | None = None, sigma: float | None = None) -> Column:
    """Gaps filled, cut, smoothed, resampled and scaled, in this order."""
    a = impute_gap(a)
    a = truncate(a, keep) if keep else a
    a = smooth(a, sigma) if sigma else a
    return minmax(resample(a, points))


def features(shift: Column, cor: Column, dif: Column) -> Column:
    """[shift] + cor + dif with undefined values as zeros."""
    return fill_zero(F.concat(F.array(shift.cast("double")), cor, dif))


def null_share(a: Column) -> Column:
    return F.try_divide(F.size(F.filter(a, lambda x: x.isNull() | F.isnan(x))).cast("double"), F.size(a))
