"""Statistics on aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the labels, largest first; a value above the bound gets the label.
CORRELATION_STRENGTH = ((0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate"), (0.2, "Weak"))
BALANCE_STRENGTH = ((0.7, "Strong"), (0.4, "Moderate"))
SILHOUETTE_QUALITY = ((0.7, "Excellent"), (0.5, "Good"), (0.25, "Fair"))
HHI_BANDS = ((0.1, "Low"), (0.18, "Moderate"))
SIGNIFICANCE_LEVEL = 0.05
SIGNIFICANT_T = 2.0


def label_above(value: Column, bounds: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """Label of the first bound the value exceeds; null for a null value."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        label = label.when(value > bound, name)
    return label.otherwise(otherwise)


def label_below(value: Column, bounds: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    """Label of the first bound the value stays below; null for a null value."""
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        label = label.when(value < bound, name)
    return label.otherwise(otherwise)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; null when either side is constant."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), spread)


def coefficient_of_variation(value: Column) -> Column:
    """Sample deviation in percent of the mean; null unless the mean is positive."""
    mean = F.avg(value)
    return F.when(mean > 0, F.stddev_samp(value) / mean * 100)


def correlation_t(r: Column, n: Column) -> Column:
    """t of a correlation over n points; null for a perfect correlation."""
    rest = 1 - r * r
    return F.when((n > 2) & (rest > 1e-12), r * F.sqrt((n - 2) / rest))


def student_t(n1: Column, mean1: Column, var1: Column,
              n2: Column, mean2: Column, var2: Column) -> Column:
    """Two-sample t with pooled variance, side 1 minus side 2; null when nothing varies."""
    pooled = ((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)
    return F.try_divide(mean1 - mean2, F.sqrt(pooled * (1 / n1 + 1 / n2)))


# ln(G(z + 1/2) / G(z)) - ln(z) / 2 as a series in 1 / z, with its odd powers.
_HALF_STEP = ((1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432))
#: The series is used this far to the right, where it is good to the last bit.
_SHIFT = 20
#: Steps of the continued fraction: more than the square root of any number of periods needs.
_STEPS = 500


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each worked out once however often it is used."""
    bound = F.array(F.struct(*(v.alias(name) for name, v in values.items())))
    return F.get(F.transform(bound, body), F.lit(0))


def _log_beta_half(h: Column) -> Column:
    """ln B(h, 1/2). The quotient of gamma functions is taken ``_SHIFT`` to the right and brought
    back by their recurrence."""
    z = h + _SHIFT
    series = 0.5 * F.log(z)
    for power, factor in _HALF_STEP:
        series = series + factor * F.pow(z, F.lit(-power))
    back = F.aggregate(
        F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0),
        lambda total, k: total + F.log((h + k) / (h + k + 0.5)))
    return F.lit(0.5 * math.log(math.pi)) - series - back


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of Abramowitz & Stegun 26.5.8, in the modified Lentz scheme, as a fold
    over its odd and even terms in turn; a fold that has settled is left as it is."""
    def nonzero(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        m = F.floor((n + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        moved = _let(
            lambda v: _let(
                lambda w: F.struct(
                    w["c"].alias("c"), w["d"].alias("d"), (s["value"] * w["c"] * w["d"]).alias("value"),
                    (F.abs(w["c"] * w["d"] - 1) <= 1e-15).alias("settled")),
                c=nonzero(v["c"]), d=1 / nonzero(v["d"])),
            c=1 + F.when(n % 2 == 1, even).otherwise(odd) / s["c"],
            d=1 + F.when(n % 2 == 1, even).otherwise(odd) * s["d"])
        return F.when(s["settled"], s).otherwise(moved)

    first = 1 / nonzero(1 - (a + b) * x / (a + 1))
    start = F.struct(
        F.lit(1.0).alias("c"), first.alias("d"), first.alias("value"), F.lit(False).alias("settled"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * _STEPS)), start, step, lambda s: s["value"])


def p_value(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t, two-sided: the regularised incomplete beta I_x(df/2, 1/2) at
    x = df / (df + t^2). Null in, null out; accurate for tiny p as well."""
    def of_test(s: Column) -> Column:
        # The fraction converges fast left of the mean of the beta distribution; right of it the
        # mirrored fraction does.
        x, rest = s["df"] / (s["df"] + s["t"] * s["t"]), s["t"] * s["t"] / (s["df"] + s["t"] * s["t"])
        return _let(of_sides, h=s["df"] / 2, x=x, rest=rest, mirrored=x > (s["df"] / 2 + 1) / (s["df"] / 2 + 2.5))

    def of_sides(s: Column) -> Column:
        return _let(
            tail, h=s["h"], mirrored=s["mirrored"],
            a=F.when(s["mirrored"], 0.5).otherwise(s["h"]), b=F.when(s["mirrored"], s["h"]).otherwise(0.5),
            at=F.when(s["mirrored"], s["rest"]).otherwise(s["x"]),
            beyond=F.when(s["mirrored"], s["x"]).otherwise(s["rest"]))

    def tail(s: Column) -> Column:
        front = F.exp(s["a"] * F.log(s["at"]) + s["b"] * F.log(s["beyond"]) - _log_beta_half(s["h"])) / s["a"]
        share = front * _beta_fraction(s["a"], s["b"], s["at"])
        one_sided = F.when(s["mirrored"], 1 - share).otherwise(share)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), one_sided))

    def of_pair(s: Column) -> Column:
        known = s["t"].isNotNull() & (s["df"] > 0)
        return F.when(known, F.when(s["t"] == 0, 1.0).otherwise(of_test(s)))

    return _let(of_pair, t=t.cast("double"), df=df.cast("double"))


def significance(enough: Column, p: Column) -> Column:
    return (
        F.when(~enough, "Insufficient data")
        .when(p < SIGNIFICANCE_LEVEL, "Significant")
        .otherwise("Not significant")
    )
