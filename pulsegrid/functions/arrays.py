"""Segment kernels on array<double> columns, as higher-order functions.

Each takes a Column of a segment's values in order and gives a double; order-free statistics of very long channels
are better taken by grouped aggregates over exploded rows (see plans/segment_queries.py).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seven taps of a Gaussian of unit deviation, not normalised to sum 1.
GAUSSIAN7 = tuple(math.exp(-(k**2) / 2) / math.sqrt(2 * math.pi) for k in range(-3, 4))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x).cast("double"))


def moments(x: Column) -> Column:
    """struct(n, m1, m2, m3, m4): mean and central moments."""
    n = F.size(x).cast("double")
    with_mean = F.array(F.try_divide(total(x), n))
    central = lambda m, p: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - m, F.lit(p))) / n
    return F.get(F.transform(with_mean, lambda m: F.struct(n.alias("n"), m.alias("m1"), central(m, 2).alias("m2"), central(m, 3).alias("m3"), central(m, 4).alias("m4"))), F.lit(0))


def quantile(x: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(x)
    at = (F.size(x) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
    return a + (b - a) * (at - low)


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: b - a)


def haar_approximation(x: Column) -> Column:
    """Pair sums over root two; an odd last value is paired with itself."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")), lambda i: (F.get(x, 2 * i) + F.coalesce(F.get(x, 2 * i + 1), F.get(x, 2 * i))) / math.sqrt(2))


def convolved(x: Column) -> Column:
    """Gaussian smoothing by seven taps, same length, zeros beyond the ends."""
    return F.transform(x, lambda _, i: sum((F.coalesce(F.get(x, i + k), F.lit(0.0)) * GAUSSIAN7[k + 3] for k in range(-3, 4)), F.lit(0.0)))


def sign_changes(x: Column) -> Column:
    """Share of neighbours whose signs differ, to or from zero included."""
    signs = F.transform(x, lambda v: F.signum(v))
    return F.try_divide(F.size(F.filter(differences(signs), lambda d: d != 0)).cast("double"), F.size(x).cast("double"))


def mean_gradient(x: Column) -> Column:
    """Mean of central differences, one-sided at the ends."""
    n = F.size(x)
    inner = F.transform(x, lambda _, i: F.when(i == 0, F.get(x, F.lit(1)) - F.get(x, F.lit(0))).when(i == n - 1, F.get(x, n - 1) - F.get(x, n - 2)).otherwise((F.get(x, i + 1) - F.get(x, i - 1)) / 2))
    return F.when(n > 1, mean(inner))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits over exactly equal values: runs of the sorted values, so n log n however many differ."""
    n, start = F.size(x), F.struct(F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    term = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0)
    step = lambda a, v: F.when(a["v"] == v, F.struct(a["v"].alias("v"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(v.alias("v"), F.lit(1.0).alias("run"), (a["sum"] + term(a["run"])).alias("sum")))
    total_ = F.aggregate(F.array_sort(x), start, step, lambda a: a["sum"] + term(a["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total_ / n).otherwise(0.0)


def convolution_stats(x: Column) -> dict[str, Column]:
    """The 21 statistics of a smoothed segment, by name, in their fixed order."""
    m, n = moments(x), F.size(x).cast("double")
    top, low = F.array_max(x), F.array_min(x)
    sum_sq = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    rms = F.sqrt(sum_sq / n)
    max_abs = F.array_max(F.transform(x, lambda v: F.abs(v)))
    centred = F.get(F.transform(F.array(mean(x)), lambda mu: F.transform(x, lambda v: v - mu)), F.lit(0))
    return {
        "mean": m["m1"],
        "std": F.sqrt(m["m2"]),
        "max": top,
        "min": low,
        "ptp": top - low,
        "max_abs": max_abs,
        "sum_sq": sum_sq,
        "zero_cross_rate": sign_changes(x),
        "slope": mean_gradient(x),
        "ptb": top - low,
        "skew": F.try_divide(m["m3"], F.pow(m["m2"], F.lit(1.5))),
        "kurtosis": F.try_divide(m["m4"], m["m2"] * m["m2"]) - 3,
        "rms": rms,
        "iq_rng": quantile(x, 0.75) - quantile(x, 0.25),
        "mean_ad": total(F.transform(centred, lambda v: F.abs(v))) / n,
        "mean_abs": total(F.transform(x, lambda v: F.abs(v))) / n,
        "area_pos": total(F.filter(x, lambda v: v > 0)),
        "area_neg": total(F.filter(x, lambda v: v < 0)),
        "mean_cross_rate": sign_changes(centred),
        "entropy": entropy(x),
        "crest_factor": F.try_divide(max_abs, rms),
    }


def simpson(x: Column, dx: float) -> Column:
    """Composite Simpson area; for an even number of points the last interval takes the parabola through the last three."""
    n = F.size(x)
    odd = F.when(n % 2 == 1, n).otherwise(n - 1)
    weigh = lambda v, i: v * F.when((i == 0) | (i == odd - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    core = total(F.transform(F.slice(x, F.lit(1), odd), weigh)) / 3
    tail = 5 / 12 * F.get(x, n - 1) + 2 / 3 * F.get(x, n - 2) - 1 / 12 * F.get(x, n - 3)
    return F.when(n == 1, 0.0).when(n == 2, (F.get(x, F.lit(0)) + F.get(x, F.lit(1))) / 2 * dx).when(n % 2 == 1, core * dx).otherwise((core + tail) * dx)


def morphology(x: Column, dx: float) -> dict[str, Column]:
    """Absolute area, relative area in percent, area of absolute differences."""
    area = simpson(F.transform(x, lambda v: F.abs(v)), dx)
    delta = differences(x)
    return {"abs_area": area, "relative_area": F.try_divide(100 * simpson(delta, dx), area), "diff_area": simpson(F.transform(delta, lambda v: F.abs(v)), dx)}
